"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text.

Two multinomials over hashed word uni- and bigrams are compared: one of trusted
documents (half of those that the labels call good), one of the whole corpus. A
document's score is the mean log ratio of its n-grams. Rows below a threshold
found from the other labelled rows fail. All rows of either table count; the same
input always gives the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import BLANKS, arrow_rows, in_arrow, stored

#: log2 of the number of hash buckets; the model is two such vectors.
BUCKET_BITS = 14
#: Characters counted as symbols, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: What a labelled row is for.
UNTRUSTED, FITTED, HELD_OUT = 0, 1, 2


def buckets(words: list[bytes]) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words."""
    own = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
    mixed = np.concatenate([own, pairs]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if len(words) > WINDOW:
        flat = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        spans = [flat[a:b] for a, b in zip((ends - lengths)[: 1 - WINDOW].tolist(), ends[WINDOW - 1 :].tolist())]
        if len(set(spans)) < len(spans):
            seen: dict[bytes, int] = {}
            twice = np.zeros(len(words) + 1, np.int64)
            for i, span in enumerate(spans):
                first = seen.setdefault(span, i)
                if first != i:
                    for start in (first, i):
                        twice[start] += 1
                        twice[start + WINDOW] -= 1
            repeated = int((np.cumsum(twice) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass(frozen=True)
class Model:
    """Log ratio per bucket, and the least mean ratio that passes."""

    ratio: np.ndarray
    threshold: float

    def score(self, words: list[bytes]) -> float:
        return float(self.ratio[buckets(words)].mean()) if words else 0.0


def _half(doc_id: Column) -> Column:
    """Which half of the trusted ones a document is in (0: fitted); that depends on its id alone."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint"), F.lit(1)), F.lit(2))


def _roles(labels: DataFrame) -> DataFrame:
    """``(__id, __role)`` of every labelled document."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality"))
    return named.select("__id", F.when(F.col("__quality") != 1, UNTRUSTED).when(_half(F.col("__id")) == 0, FITTED).otherwise(HELD_OUT).alias("__role"))


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, __role)`` of every row of ``docs``, with the role ``FITTED`` where it is that.

    The half that is never fitted to is told by its ids and stays where it is
    read. Only the texts of the other half meet their labels, in one exchange by
    id; labels are not broadcast, since they grow with the documents.
    """
    texts = docs.select("doc_id", "text")
    may_fit = F.coalesce(_half(F.col("doc_id")) == 0, F.lit(False)) & F.col("doc_id").isNotNull()
    fitted = _roles(labels).where(F.col("__role") == FITTED).hint("shuffle_hash")
    met = texts.where(may_fit).join(fitted, F.col("doc_id") == F.col("__id"), "left").select("text", "__role")
    return texts.where(~may_fit).select("text", F.lit(UNTRUSTED).alias("__role")).unionByName(met)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Count all documents, half of the trusted ones apart; every score passes as yet.

    Each text is counted once. What comes to the driver is two count vectors.
    """
    marked = _marked(docs, labels)
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pair of count vectors per task, emitted once."""
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for text, role in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = np.bincount(buckets((text or "").encode("utf-8", "replace").split()), minlength=size)
                    counts[0] += found
                    if role == FITTED:
                        counts[1] += found
        trusted, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(trusted, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[trusted, bucket])], names=["trusted", "bucket", "n"])

    counted = marked.transform(in_arrow, count, "trusted int, bucket int, n bigint")
    totals = np.zeros((2, size))
    for row in counted.groupBy("trusted", "bucket").agg(F.sum("n").alias("n")).collect():  # 2 * 2**BUCKET_BITS rows at most
        totals[row["trusted"], row["bucket"]] = row["n"]
    raw = (totals[0] + 0.5) / (totals[0].sum() + 0.5 * size)
    trusted = (totals[1] + size * raw) / (totals[1].sum() + size)  # a bucket without trusted counts leans on the corpus
    return Model(np.log(trusted / raw), float("-inf"))


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """Least score that passes, from the scores of all labelled rows that the model was not fitted to.

    ``scored`` has doc_id and score. The threshold lies six standard deviations of
    the held-out trusted rows below their mean, yet not below the midpoint to the
    mean of the untrusted rows; without one of the kinds every score passes. What
    comes to the driver is the moments of two groups.
    """
    roles = _roles(labels).where(F.col("__role") != FITTED)
    judged = scored.select("doc_id", "score").join(roles, F.col("doc_id") == F.col("__id"))
    moments = judged.groupBy((F.col("__role") == HELD_OUT).cast("int").alias("trusted")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    found = {r["trusted"]: r for r in moments.collect()}
    if len(found) < 2 or found[0]["mean"] >= found[1]["mean"]:
        return float("-inf")
    middle = (found[0]["mean"] + found[1]["mean"]) / 2
    return round(max(middle, found[1]["mean"] - 6 * found[1]["sd"]), 6)


def _fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``score`` and ``kept`` of every row of ``docs``.

    A null or empty text has no words, fails the base rule and scores 0. Repeated
    rows are judged alike and all returned; a null doc_id is passed through and
    matches no label. Labels that repeat an id count with their highest quality.
    Empty tables give no rows (documents) or let every score pass (labels). Other
    columns are not read.
    """
    model = fit(docs, labels)

    def make():
        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                n, chars, symbols, lines, repeated = base_counts(text or "", words)
                yield {
                    "doc_id": doc_id, "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeated,
                    "base_failed": _fails(n, repeated), "score": model.score(words),
                }

        return step

    report = stored(arrow_rows(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double",
    ), "scores")
    return report.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold(report, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps; columns pass through."""
    fitted = fit(docs, labels)

    def make():
        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield {"doc_id": doc_id, "score": fitted.score(_words(text))}

        return step

    scored = arrow_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, score double")
    model = Model(fitted.ratio, threshold(scored, labels))

    def good(text: str | None) -> bool:
        words = _words(text)
        if _fails(len(words), 0) or model.score(words) < model.threshold:
            return False
        return not _fails(len(words), base_counts(text, words)[-1])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([good(text) for text in texts], pa.bool_()))

    return docs.transform(in_arrow, run, docs.schema)

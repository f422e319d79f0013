"""Passages of equal words that occur more than once, whatever blanks stand between the words.

In every window of ``words`` words the ``SEED`` words with the smallest hash are its
anchor, so equal windows have equal anchors; the windows around one anchor form a
block. Blocks whose anchor occurs once in all documents drop out. Of the others,
blocks found twice as a whole are repeated as a whole and need no closer look;
one copy of each different block of an anchor is taken apart, and its windows are
counted. Blocks and windows are equal when a 128-bit hash of their words is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import forget, in_arrow, repeated_rows, stored
from hourmark.llm.suffixes import _DOWN, _FACTOR, _INVERSE, _UP, _powers, window_minima

WORDS, SEED = 51, 8
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\t\n\x0b\x0c\r ")] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word, and the byte after its last."""
    edges = np.diff(np.concatenate([[True], _BLANK[np.frombuffer(data, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def _spaced(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """First and after-last bytes of the words, the words with one blank between them, and where each begins and ends there."""
    begins, ends = word_bounds(data)
    stop = np.cumsum(ends - begins + 1) - 1
    return begins, ends, b" ".join(data.split()), stop - (ends - begins), stop


def _runs_of_windows(spaced: bytes, start: np.ndarray, stop: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchors_of`` a text whose words are found already."""
    if len(start) < words:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2
    flat = np.frombuffer(spaced, np.uint8)
    long = len(flat) > len(_UP)
    up, down = (_powers(_FACTOR, len(flat)), _powers(_INVERSE, len(flat))) if long else (_UP, _DOWN)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    first = start[: len(start) - seed + 1]
    h = (sums[stop[seed - 1 :]] - sums[first]) * down[first]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    low = np.uint64((1 << 32) - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    anchor = (window_minima(keys, words - seed + 1) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[new]], new, np.append(new[1:], len(anchor)) - 1


def anchors_of(data: bytes, words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (seed hash, first window, last window) of every run of windows with one anchor; windows by their first word."""
    return _runs_of_windows(*_spaced(data)[2:], words, seed)


def _hash_pairs(pieces: Iterable[bytes]) -> np.ndarray:
    """A row per piece: the two halves of its 128-bit hash as signed longs."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), ">i8").astype(np.int64).reshape(-1, 2)


def _rows(ids: pa.RecordBatch, owner: list[np.ndarray], columns: list[list[np.ndarray]], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    """The columns, with the first two of ``ids`` at the rows that own them."""
    rows = pa.array(np.concatenate(owner))
    return pa.RecordBatch.from_arrays([ids.column(0).take(rows), ids.column(1).take(rows), *[pa.array(np.concatenate(c)).cast(t) for c, t in zip(columns, kinds)]], names=names)


_BLOCK = {"doc_id": pa.int64(), "th": pa.int64(), "h": pa.int64(), "x": pa.int64(), "y": pa.int64(), "a": pa.int32(), "b": pa.int32(), "begin": pa.int32(), "end": pa.int32()}


def _blocks_of(part: pa.RecordBatch, words: int) -> pa.RecordBatch | None:
    """The blocks of some texts; each text is taken apart into words once."""
    kinds = list(_BLOCK.values())[2:]
    owner, columns = [], [[] for _ in kinds]
    for n, text in enumerate(part.column(2).to_pylist()):
        begins, ends, flat, start, stop = _spaced(text.encode("utf-8", "replace"))
        h, a, b = _runs_of_windows(flat, start, stop, words, SEED)
        if not len(h):
            continue
        last = b + words - 1
        pairs = _hash_pairs(flat[u:v] for u, v in zip(start[a].tolist(), stop[last].tolist()))
        owner.append(np.full(len(h), n))
        for column, values in zip(columns, (h.view(np.int64), pairs[:, 0], pairs[:, 1], a, b, begins[a], ends[last])):
            column.append(values)
    return _rows(part, owner, columns, kinds, list(_BLOCK)) if owner else None


def _blocks(docs: DataFrame, words: int) -> DataFrame:
    """Every block: its anchor's hash, two hashes of its words, first and last window, first byte and the byte after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                if (found := _blocks_of(batch.slice(k, 128), words)) is not None:
                    yield found

    return docs.select("doc_id", "th", "text").transform(in_arrow, run, "doc_id bigint, th bigint, h bigint, x bigint, y bigint, a int, b int, begin int, end int")


def _windows(texts: DataFrame, words: int) -> DataFrame:
    """``(doc_id, th, x, y, begin, end, at, lone)``: the windows of the listed blocks; lone where the block is found once."""
    names = ["doc_id", "th", "x", "y", "begin", "end", "at", "lone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.bool_()]
        for batch in batches:
            owner, columns, held = [], [[] for _ in kinds], 0
            for n, (text, blocks) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                begins, ends, flat, start, stop = _spaced(text.encode("utf-8", "replace"))
                every = np.concatenate([np.arange(x["a"], x["b"] + 1) for x in blocks])
                single = np.repeat([x["n"] == 1 for x in blocks], [x["b"] + 1 - x["a"] for x in blocks])
                for k in range(0, len(every), 20_000):  # a long text in several pieces
                    at, lone = every[k : k + 20_000], single[k : k + 20_000]
                    last = at + words - 1
                    pairs = _hash_pairs(flat[u:v] for u, v in zip(start[at].tolist(), stop[last].tolist()))
                    owner.append(np.full(len(at), n))
                    for column, values in zip(columns, (pairs[:, 0], pairs[:, 1], begins[at], ends[last], at, lone)):
                        column.append(values)
                    held += len(at)
                    if held >= 20_000:
                        yield _rows(batch, owner, columns, kinds, names)
                        owner, columns, held = [], [[] for _ in kinds], 0
            if owner:
                yield _rows(batch, owner, columns, kinds, names)

    return texts.transform(in_arrow, run, "doc_id bigint, th bigint, x bigint, y bigint, begin int, end int, at int, lone boolean")


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, th, spans)``: what covers the windows of ``words`` words of ``docs(doc_id, th, text)`` that are found elsewhere too.

    A span has its bytes (``begin`` to ``end``) and its words (``at`` to ``upto``); spans may overlap.
    """
    every = stored(_blocks(docs, words), "word-blocks")
    chosen, seeds = repeated_rows(every, ["h"], "word-seeds")
    blocks = stored(chosen, "repeated-seeds")
    forget(every, seeds)
    different = stored(blocks.groupBy("h", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "a", "b")).alias("r")), "different-blocks")
    several, seeds = repeated_rows(different, ["h"], "several-blocks")
    listed = several.groupBy(F.col("r.doc_id").alias("__id"), F.col("r.th").alias("__th")).agg(F.collect_list(F.struct("r.a", "r.b", "n")).alias("blocks"))
    texts = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("doc_id", "th", "text", "blocks")
    # rows equal in doc_id and text give their windows twice, but none of those is lone
    windows = stored(_windows(texts, words), "word-windows")
    del texts, listed, several
    forget(different, seeds)
    again, windowed = repeated_rows(windows, ["x", "y"], "window-counts")
    copied, counted = repeated_rows(blocks, ["h", "x", "y"], "block-counts")
    single = again.where("lone").select("doc_id", "th", F.struct("begin", "end", "at", (F.col("at") + words).alias("upto")).alias("s"))
    whole = copied.select("doc_id", "th", F.struct("begin", "end", F.col("a").alias("at"), (F.col("b") + words).alias("upto")).alias("s"))
    spans = stored(single.unionByName(whole).groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans")), "passage-spans")
    forget(windows, windowed, blocks, counted)
    return spans


def covered_words(passages: DataFrame) -> DataFrame:
    """``(doc_id, th, passage_words)``: words of each text that lie in a span of ``repeated_passages``."""
    ranges = F.array_sort(F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["upto"].alias("upto"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("until"))
    # each range adds what reaches beyond those before it
    total = F.aggregate(ranges, begin, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["upto"] - F.greatest(s["at"], acc["until"]))).cast("bigint").alias("n"), F.greatest(acc["until"], s["upto"]).alias("until")
    ))["n"]
    return passages.select("doc_id", "th", total.alias("passage_words"))

"""Removal of long repeated strings by sorting suffixes in distributed, front-coded runs.

Only suffixes that can matter are sorted. In every window of ``length`` bytes the
``SEED``-byte string with the smallest hash is its anchor, so equal windows have
their anchor at the same place, and the windows of one anchor are neighbours:
they form a block. Blocks whose seed occurs once in all documents hold no
repeated window and drop out.

The others go through a merge sort. A map task sorts the suffixes that start at
the anchors, writes each as the length it shares with the one before and the
rest, and exchanges these front-coded runs by ranges of the seed's hash. An owner
task merges its runs with a loser tree whose entries carry their common prefix
with the last winner: known prefixes are never compared again. The merge yields
the common prefixes of neighbours; with those of the text left of the anchors
they tell, for each offset, which windows are equal. All is decided on bytes;
hashes only select and deal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import forget, in_arrow, repeated_rows, stored

LENGTH, SEED = 400, 128
#: Bytes of text anchored together; positions fit 20 bits of the sort key.
PART_BYTES = 1 << 18
#: Blocks an owner task merges at a time, and distinct blocks of one seed beyond which windows are dealt singly.
OWNED, HOT_SEED = 3_000, 12_000
#: Texts handled at a time, and bytes of keys a task sorts at a time.
SOME, SORTED_BYTES = 128, 12 << 20

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_FACTOR, 1 << 20), _powers(_INVERSE, 1 << 20)


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``seed`` bytes of ``data`` (at most 2**20 bytes)."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    h = (sums[seed:] - sums[:-seed]) * _DOWN[: len(data) - seed + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of aligned stretches."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks_of(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text number, seed hash, first window, last window, anchor) of every block, a part at a time."""
    parts: list[tuple[int, int, bytes]] = []
    held = 0

    def anchored() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p[2]) for p in parts])
        flat = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        hashes = seed_hashes(flat, seed)
        low = np.uint64((1 << 20) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the leftmost
        anchor = (window_minima(keys, length - seed + 1) & low).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        start = np.arange(len(anchor))
        valid = start + length <= (begins + sizes)[owner]
        start, anchor, owner = start[valid], anchor[valid], owner[valid]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        part, a, b, p = owner[first], start[first], start[last], anchor[first]
        move = np.array([p_[1] for p_ in parts])[part] - begins[part]
        # anchors have small hashes; spread them again, for an even deal
        spread = (hashes[p] ^ (hashes[p] >> np.uint64(29))) * np.uint64(_FACTOR)
        spread = (spread ^ (spread >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.array([p_[0] for p_ in parts])[part], spread, a + move, b + move, p + move

    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PART_BYTES):
            part = text[at : at + PART_BYTES + length - 1]
            if held + len(part) > 2 * PART_BYTES:
                yield anchored()
                parts, held = [], 0
            parts.append((number, at, part))
            held += len(part)
    if parts:
        yield anchored()


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(x), len(y))
    if x[known:end] == y[known:end]:
        return end
    low, high = known, end  # x[:low] == y[:low], x[:high] != y[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def front_code(keys: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted keys as common prefixes with the key before, and rests."""
    shared = [0] * len(keys)
    for k in range(1, len(keys)):
        shared[k] = common_prefix(keys[k - 1], keys[k])
    return shared, [key[s:] for key, s in zip(keys, shared)]


class LoserTree:
    """Merges front-coded sorted runs; yields (run, key, common prefix with the key before).

    Every waiting head knows its common prefix with the last winner. Of two heads
    the one that shares more comes first; only equal ones are compared, from
    there on, and the loser learns what it shares with the new winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]) -> None:
        self.runs, self.n = runs, len(runs)
        self.keys: list[bytes | None] = [b""] * self.n
        self.shared = [0] * self.n
        self.losers = [-1] * self.n
        for run in range(self.n):
            self._advance(run)
        for run in range(self.n):
            self._play(run)

    def _advance(self, run: int) -> None:
        step = next(self.runs[run], None)
        if step is None:
            self.keys[run] = None
        else:
            self.shared[run] = step[0]
            self.keys[run] = self.keys[run][: step[0]] + step[1]

    def _wins(self, x: int, y: int) -> bool:
        """Whether head ``x`` comes before head ``y``; updates what the loser shares."""
        kx, ky = self.keys[x], self.keys[y]
        if kx is None or ky is None:
            return ky is None
        sx, sy = self.shared[x], self.shared[y]
        if sx != sy:
            return sx > sy
        both = common_prefix(kx, ky, sx)
        first = len(kx) == both or (len(ky) > both and kx[both] < ky[both])
        self.shared[y if first else x] = both
        return first

    def _play(self, run: int) -> None:
        """Carry ``run`` up from its leaf; a node without a loser yet keeps it."""
        winner, node = run, (run + self.n) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if not self._wins(winner, other):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        while self.n and self.keys[run := self.losers[0]] is not None:
            yield run, self.keys[run], self.shared[run]
            self._advance(run)
            self._play(run)


def equal_windows(
    right: np.ndarray, left_order: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, copies: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (block, anchor offset) of windows that occur more than once.

    Blocks are in suffix order; ``right`` holds their common prefixes with the
    block before, ``left`` the same for the text left of the anchors in the order
    ``left_order``. A block has windows for the offsets ``low`` to ``high``. Two
    windows at one offset are equal when both parts fall into the same classes.
    """
    n = len(right)
    blocks, offsets = [], []
    side = np.empty(n, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        active = np.flatnonzero((low <= offset) & (offset <= high))
        if not len(active):
            continue
        side[left_order] = np.cumsum(left < offset)
        pair = np.cumsum(right < length - offset)[active] * (n + 1) + side[active]
        _, inverse = np.unique(pair, return_inverse=True)
        found = active[np.bincount(inverse, copies[active])[inverse] > 1]
        blocks.append(found.astype(np.int32))
        offsets.append(np.full(len(found), offset, np.int32))
    return (np.concatenate(blocks), np.concatenate(offsets)) if blocks else (np.empty(0, np.int32),) * 2


_RUN = "bucket bigint, h array<bigint>, bh array<bigint>, shared array<int>, rest array<binary>, before array<binary>, windows array<int>, copies array<bigint>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SOME):
            yield batch.slice(start, SOME)


def _block_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """``(doc_id, th, h, bh, a, b, p)``: every block with the hashes of its seed and of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, hashes, texts = batch.column(0), batch.column(1), [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            for number, h, a, b, p in blocks_of(texts, length, seed):
                bh = [_block_hash(texts[n][x : y + length]) for n, x, y in zip(number.tolist(), a.tolist(), b.tolist())]
                rows = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), pa.array(h.view(np.int64)), pa.array(bh, pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(p.astype(np.int32))],
                    names=["doc_id", "th", "h", "bh", "a", "b", "p"],
                )

    return docs.transform(in_arrow, run, "doc_id bigint, th bigint, h bigint, bh bigint, a int, b int, p int")


def _with_blocks(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each text with the lists of its blocks; texts without one drop out."""
    lists = blocks.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "bh", "a", "b", "p")).alias("blocks")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "blocks")
    return texts.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("doc_id", "th", "text", "blocks")


def _single_windows(texts: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Blocks of hot seeds as one block per window, keyed by the window's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            for doc_id, th, text, blocks in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = text.encode("utf-8", "replace")
                starts = sorted({i for x in blocks for i in range(x["a"], x["b"] + 1)})
                keys = [_block_hash(data[i : i + length]) for i in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(keys, pa.int64()), *[pa.array(starts, pa.int32())] * 3],
                    names=["doc_id", "th", "h", "bh", "a", "b", "p"],
                )

    return _with_blocks(texts, hot).transform(in_arrow, run, "doc_id bigint, th bigint, h bigint, bh bigint, a int, b int, p int")


def _runs(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Front-coded sorted runs: per task and bucket, every distinct block once with its number of copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            by_bucket: dict[int, list] = {}
            for row in sorted(held.values(), key=lambda r: (r[2], r[3][::-1])):
                by_bucket.setdefault((row[0] + (1 << 63)) * buckets >> 64, []).append(row)
            held.clear()
            for bucket, rows in by_bucket.items():
                shared, rest = front_code([r[2] for r in rows])
                columns = [[bucket], [[r[0] for r in rows]], [[r[1] for r in rows]], [shared], [rest], [[r[3] for r in rows]], [[r[4] for r in rows]], [[r[5] for r in rows]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        names = ["bucket", "h", "bh", "shared", "rest", "before", "windows", "copies"]
        longs, ints, raw = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())
        kinds = [pa.int64(), longs, longs, ints, raw, raw, ints, longs]
        for batch in _parts(batches):
            for text, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode("utf-8", "replace")
                for x in blocks:
                    a, b, p = x["a"], x["b"], x["p"]
                    # sorted as: seed hash, suffix from the anchor, the text before it read backwards
                    key = (x["h"] + (1 << 63)).to_bytes(8, "big") + data[p : b + length]
                    before = data[a:p]
                    row = held.get((key, before))
                    if row is None:
                        held[key, before] = [x["h"], x["bh"], key, before, b - a, 1]
                        size += len(key) + len(before)
                    else:
                        row[5] += 1
            if size > SORTED_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return texts.select("text", "blocks").transform(in_arrow, run, _RUN)


def _merged(runs: pa.Table, length: int) -> pa.Table:
    """One bucket: merge its runs, find the repeated windows of every distinct block."""
    columns = {name: runs.column(name).to_pylist() for name in runs.column_names}
    at = [0] * runs.num_rows
    blocks: list[list] = []  # h, bh, before, windows, copies
    right: list[int] = []
    previous = None
    tree = LoserTree([iter(zip(s, r)) for s, r in zip(columns["shared"], columns["rest"])])
    newest: dict[tuple[bytes, int], int] = {}
    for run, key, shared in tree:
        k = at[run]
        at[run] += 1
        if key != previous:
            newest.clear()
            previous = key
        same = (columns["before"][run][k], columns["windows"][run][k])
        if same in newest:
            blocks[newest[same]][4] += columns["copies"][run][k]
            continue
        newest[same] = len(blocks)
        blocks.append([columns["h"][run][k], columns["bh"][run][k], *same, columns["copies"][run][k]])
        # the first eight bytes are the seed's hash; across seeds nothing is shared
        right.append(max(0, shared - 8) if shared >= 8 and len(newest) == 1 else 0 if len(newest) == 1 else len(key) - 8)
    n = len(blocks)
    backwards = [b[2][::-1] for b in blocks]
    order = sorted(range(n), key=lambda i: (blocks[i][0], backwards[i]))
    left = [0] * n
    for k in range(1, n):
        i, j = order[k - 1], order[k]
        left[k] = common_prefix(backwards[i], backwards[j]) if blocks[i][0] == blocks[j][0] else -1
    if n:
        left[0] = -1
    high = np.array([len(b[2]) for b in blocks], np.int64)
    low = high - np.array([b[3] for b in blocks], np.int64)
    found, offset = equal_windows(np.array(right), np.array(order), np.array(left), low, high, np.array([b[4] for b in blocks], np.float64), length)
    start = high.astype(np.int32)[found] - offset
    by = np.lexsort((start, found))
    found, start = found[by], start[by]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(found)) - 1 if len(found) else first
    owner = found[first].tolist()
    return pa.table({
        "h": pa.array([blocks[i][0] for i in owner], pa.int64()), "bh": pa.array([blocks[i][1] for i in owner], pa.int64()),
        "first": pa.array(start[first].astype(np.int32)), "last": pa.array(start[last].astype(np.int32)),
    })


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot_seed: int = HOT_SEED) -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: the texts that may hold repeats, and their repeated byte ranges.

    ``docs`` has doc_id, th (a hash of the text) and text. ``spans`` holds, per
    (doc_id, th), an array of (begin, end) that cover every repeated string of
    ``length`` bytes; ranges may overlap.
    """
    anchors = stored(_anchors(docs, length, seed), "anchors")
    chosen, counted = repeated_rows(anchors, ["h"], "seeds")  # blocks whose seed occurs more than once
    repeated = stored(chosen, "blocks")
    forget(anchors, counted)
    texts = stored(_with_blocks(docs, repeated).select("doc_id", "th", "text"), "texts")
    # a seed with very many different blocks would meet in one task: its windows are dealt one by one
    hot = stored(repeated.groupBy("h").agg(F.approx_count_distinct("bh").alias("n")).where(F.col("n") > hot_seed).select("h"), "hot")
    if hot.limit(1).count():
        windows = stored(_single_windows(texts, repeated.join(hot, "h", "left_semi"), length), "windows")
        single, counted = repeated_rows(windows, ["h"], "window-counts")
        refined = stored(repeated.join(hot, "h", "left_anti").unionByName(single), "refined")
        forget(repeated, windows, counted)
        repeated = refined
    count = repeated.count()
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // OWNED))
    runs = _runs(_with_blocks(texts, repeated), buckets, length)
    ranges = stored(runs.groupBy("bucket").applyInArrow(lambda table: _merged(table, length), "h bigint, bh bigint, first int, last int"), "ranges")
    del runs
    forget(hot)
    spans = stored(repeated.join(ranges, ["h", "bh"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("a") + F.col("first")).alias("begin"), (F.col("a") + F.col("last") + length).alias("end"))).alias("spans")), "spans")
    forget(repeated, ranges)
    return texts, spans


def kept_ranges(spans: list[dict], size: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Maximal removed ranges, and what lies between them."""
    removed: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if removed and begin <= removed[-1][1]:
            removed[-1][1] = max(removed[-1][1], end)
        else:
            removed.append([begin, end])
    edges = [0, *[e for r in removed for e in r], size]
    return [tuple(r) for r in removed], [(x, y) for x, y in zip(edges[::2], edges[1::2]) if x < y]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def cut_texts(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot_seed: int = HOT_SEED, words: int = 0) -> DataFrame:
    """``(doc_id, th, n_removed, n_spans, kept_sha256, kept)`` of the texts that lose bytes, each once; ``kept`` is binary.

    With ``words``, passages of that many equal words are cut as well.
    """
    texts, spans = repeated_spans(_keyed(docs), length, seed, hot_seed)
    held = texts
    if words:
        from hourmark.llm.passages import repeated_passages

        texts = _keyed(docs)
        passages = repeated_passages(texts, words)
        ranges = F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))
        both = spans.unionByName(passages.withColumn("spans", ranges))
        joined = stored(both.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "both-spans")
        forget(spans, passages, *([] if texts is held else [held]))
        spans = joined
    lists = spans.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "spans")
    whole = texts.dropDuplicates(["doc_id", "th"]).join(lists, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("doc_id", "th", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in _parts(batches):
            rows = []
            for doc_id, th, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = text.encode("utf-8", "replace")
                removed, left = kept_ranges(found, len(data))
                kept = b"".join(data[x:y] for x, y in left)
                rows.append((doc_id, th, len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return whole.transform(in_arrow, run, "doc_id bigint, th bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def repeat_report(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot_seed: int = HOT_SEED, words: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``words`` passage_words as well.

    A byte is removed when a string of ``length`` bytes that covers it starts
    anywhere else too, in the same text or another; strings are judged on the
    input and never cross texts. ``passage_words`` counts the words that lie in a
    passage of ``words`` equal words found elsewhere too, however few bytes it has.
    A null or empty text has no bytes and no words. Rows that
    repeat another's text lose all of it when it is long enough. Repeated rows
    and null doc_ids are kept, a row per input row. An empty table gives no rows.
    Other columns are not read. ``length`` exceeds ``seed``.
    """
    cut = cut_texts(docs, length, seed, hot_seed).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "n_removed", "n_spans", "kept_sha256")
    own = _keyed(docs).select("doc_id", "th", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("whole"))
    joined = own.join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").drop("__id", "__th")
    none = F.lit(0).cast("bigint")
    shown = ["doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    if words:
        from hourmark.llm.passages import covered_words, repeated_passages

        passages = covered_words(repeated_passages(_keyed(docs), words)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "passage_words")
        joined = joined.join(passages, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
        shown.append(F.coalesce("passage_words", none).alias("passage_words"))
    return joined.select(*shown)


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, words: int = 0) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (and ``n_chars`` counted anew, if there).

    With ``words``, so are passages of that many words that occur elsewhere too, whatever their length in bytes.

    Every row stays, also one that loses all its text. A character of which only
    some bytes are cut goes whole. Other columns pass through.
    """
    cut = cut_texts(docs.select("doc_id", "text"), length, seed, words=words).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "kept")

    @F.pandas_udf("string")
    def decoded(data):
        return data.map(lambda x: None if x is None else x.decode("utf-8", "ignore"))

    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    new = cut.select("__id", "__th", decoded("kept").alias("__text"))
    joined = docs.join(new, docs["doc_id"].eqNullSafe(new["__id"]) & (th == new["__th"]), "left")
    text = F.coalesce(new["__text"], docs["text"])
    kinds = dict(docs.dtypes)
    shown = [text.alias(c) if c == "text" else F.coalesce(F.length(text).cast(kinds[c]), docs[c]).alias(c) if c == "n_chars" else docs[f"`{c}`"] for c in docs.columns]
    return joined.select(*shown)

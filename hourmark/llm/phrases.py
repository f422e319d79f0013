"""Phrase collocations from a weighted de Bruijn graph of word sequences.

Nodes are three words in a row, edges four: an edge joins two overlapping nodes
and weighs as often as its four words occur. Tasks build the graph of each
stretch of text and hand it on compacted: a chain of first-seen edges of one
weight, through nodes with one edge in and one out, is a single row with all its
words. The words that end a piece go beside it. Shorter counts are never taken from the
text: a node's count is the flow out of it plus the pieces that end in it, and
so on down to single words and to the total.

A phrase matters only if it occurs ``least`` times. Two scans before count phrases by
hash: the first those of one and two words, the second longer ones, but only where
each two neighbouring words passed the first. Tasks send the hashes on in blocks and
the tasks that own a block count it, so there are as many counters as the texts need, in
blocks of fixed size. One bit per few counters comes back; in the last scan a piece
ends, for counting, wherever the next word would make the phrase surely rarer.
Counters never count too few, so every count that matters is exact however full
they are; full ones only let more edges through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.llm.common import in_arrow, stored

#: Words of an edge, least count of a candidate, share (in fifths) at which a longer one takes its place, phrases kept per language.
LONGEST, LEAST, TOP = 4, 30, 2000
#: Bytes of text for each counter, and as powers of two: counters at least, blocks at least, counters of a block and bits sent back at most.
TEXT, FEWEST, BLOCKS, BLOCK, MARKS = 4, 16, 8, 24, 28
#: Words of a stretch whose graph is held at a time (three of their numbers fit 64 bits), rows of a batch.
STRETCH, ROWS = 1 << 19, 100_000

_STOP = b"."  # stands between pieces
_FOLD = bytes(_STOP[0] if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def _dense(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, int]:
    """Small numbers for pairs of small numbers."""
    found, inverse = np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)
    return inverse, len(found)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit hash per word; languages differ."""
    salt = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
    return np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def prefix_hashes(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Hashes of the phrases of 1 to ``size`` words that start at each word; those past the end are left out."""
    h = _mixed(hashes)
    yield h
    for k in range(1, size):
        if len(hashes) <= k:
            return
        h = _mixed(h[: len(hashes) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
        yield h


def compact_graph(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of the graph whose edges start at the positions ``at`` (rising) of a stretch: first word, last word, weight.

    ``ids`` are word numbers. A chain goes on through a node with one edge in and
    one out of equal weight.
    """
    none = np.empty(0, np.int64)
    if not len(at):
        return none, none, none
    # both nodes of every edge, numbered together
    ends = np.concatenate([at, at + 1])
    two, _ = _dense(ids[ends], ids[ends + 1])
    three, nodes = _dense(two, ids[ends + 2])
    tail, head = three[: len(at)], three[len(at) :]
    edge, edges = _dense(tail, ids[at + LONGEST - 1])
    _, place = np.unique(edge, return_index=True)
    weight = np.bincount(edge, minlength=edges)
    out, into = np.bincount(tail[place], minlength=nodes), np.bincount(head[place], minlength=nodes)
    unary = (out == 1) & (into == 1)
    order = np.argsort(at[place])
    place, weight = place[order], weight[order]
    begin = at[place]
    follows = np.zeros(len(begin), bool)
    follows[1:] = (begin[1:] == begin[:-1] + 1) & unary[tail[place[1:]]] & (weight[1:] == weight[:-1])
    start = np.flatnonzero(~follows)
    stop = np.append(start[1:], len(begin)) - 1
    return begin[start], begin[stop] + LONGEST - 1, weight[start]


def room(ids: np.ndarray, stop: int, starts: int) -> np.ndarray:
    """Words from each of the first ``starts`` positions to the end of its piece, up to four; ``stop`` stands between pieces."""
    left = np.zeros(starts, np.int64)
    alive = np.ones(starts, bool)
    for k in range(LONGEST):
        part = ids[k : k + starts]
        alive[len(part) :] = False
        alive[: len(part)] &= part != stop
        left += alive
    return left


class Sketch:
    """Counters that stop at 255: never too low up to there."""

    def __init__(self, bits: int) -> None:
        self.counts = np.zeros(1 << bits, np.uint8)

    def add(self, cells: np.ndarray) -> None:
        cell, times = np.unique(cells, return_counts=True)
        self.counts[cell] = np.minimum(self.counts[cell] + times, 255)

    def often(self, least: int, bits: int) -> bytes:
        """``2**bits`` packed bits, each for some counters in a row: whether one of them reaches ``least``."""
        return np.packbits((self.counts >= least).reshape(1 << bits, -1).any(axis=1)).tobytes()


def sketch_bits(size: int) -> int:
    """Counters for ``size`` bytes of text as a power of two: about one per phrase and scan, however large the texts."""
    return max(FEWEST, (size // TEXT).bit_length())


def _parts(bits: int) -> tuple[int, int]:
    """Of ``2**bits`` counters: blocks and bits sent back, as powers of two."""
    return min(bits - 3, max(BLOCKS, bits - BLOCK)), min(bits, max(FEWEST, bits - 3), MARKS)


def _sent(cells: np.ndarray, bits: int) -> pa.RecordBatch:
    """(block, its counters to raise) of all blocks in use, as packed differences in rising order."""
    pack = zstandard.ZstdCompressor(level=1)
    inner = np.uint64(bits - _parts(bits)[0])
    cells = np.sort(cells)
    blocks = cells >> inner
    begin = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] + np.uint64(1)))
    steps = np.diff(cells, prepend=cells[:1])
    steps[begin] = cells[begin] & ((np.uint64(1) << inner) - np.uint64(1))
    bounds = [*begin.tolist(), len(cells)]
    steps = steps.astype("<u4").view(np.uint8).reshape(-1, 4)
    packed = [pack.compress(np.ascontiguousarray(steps[a:b].T)) for a, b in zip(bounds, bounds[1:])]
    return pa.RecordBatch.from_arrays([pa.array(blocks[begin].astype(np.int32)), pa.array(packed, pa.binary())], names=["block", "cells"])


def _received(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, np.ndarray, pa.Array, int, int]]:
    """(lang, word numbers, words, number between pieces, starts) of about ``size`` words each, twice that at most."""
    held: dict[str, tuple[list[bytes], list[int]]] = {}

    def whole(lang: str) -> Iterator[tuple[str, np.ndarray, pa.Array, int, int]]:
        data = b" ".join(held.pop(lang)[0])
        text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
        found = pc.ascii_split_whitespace(text).values
        for begin in range(0, len(found), 2 * size):  # a very long text is cut; the words after the cut are looked at, not counted
            part = found.slice(begin, 2 * size + LONGEST).dictionary_encode()
            words = part.dictionary
            yield lang, part.indices.to_numpy().astype(np.int64), words, pc.index(words, pa.scalar(_STOP.decode(), words.type)).as_py(), min(2 * size, len(found) - begin)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data = ((text.as_py() or b"").translate(_FOLD).replace(_STOP, b" . ") + b" .").lstrip(b" ")
            parts, count = held.setdefault(lang, ([], [0]))
            parts.append(data)
            count[0] += data.count(b" ") + 1
            if count[0] >= size:
                yield from whole(lang)
    for lang in list(held):
        yield from whole(lang)


def _passed(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether each phrase may be frequent enough, by the leading bits of its hash."""
    cell = (hashes >> np.uint64(64 - (8 * len(packed)).bit_length() + 1)).astype(np.int64)
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def _two(hashes: list[np.ndarray], left: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether a phrase of two words that may be frequent enough starts at each place."""
    two = np.zeros(len(left) + LONGEST, bool)
    at = np.flatnonzero(left >= 2)
    two[at] = _passed(hashes[1][at], packed)
    return two


def _often(texts: DataFrame, short: Broadcast | None, bits: int, least: int, stretch: int) -> np.ndarray:
    """Which phrases of ``texts(lang, text)`` may occur ``least`` times, as packed bits by hash: ``2**MARKS / 8`` bytes at most.

    Without ``short`` of one and two words; with it, the bits of those, of three and four.
    """
    spread, marks = _parts(bits)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lang, ids, words, stop, starts in _stretches(batches, stretch):
            own = word_hashes(words, lang)
            left = room(ids, stop, len(ids))
            hashes = list(prefix_hashes(own[ids], LONGEST))
            if short is None:
                times = np.bincount(ids[:starts], minlength=len(own))
                times[stop : stop + 1 if stop >= 0 else 0] = 0
                yield np.repeat(_mixed(own), np.minimum(times, least))  # more would not change what it is sent for
                yield hashes[1][np.flatnonzero(left[:starts] >= 2)] if len(ids) > 1 else own[:0]
            elif len(ids) > 2:
                two = _two(hashes, left, short.value)
                three = two[:starts] & two[1 : starts + 1]
                yield hashes[2][np.flatnonzero(three)]
                yield hashes[3][np.flatnonzero(three & two[2 : starts + 2])] if len(ids) > 3 else own[:0]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes in hashed(batches):
            if len(hashes):
                yield _sent(hashes >> np.uint64(64 - bits), bits)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, at, waiting = None, None, []

        def raised() -> None:
            if waiting:
                sketch.add(np.concatenate(waiting))
                waiting.clear()

        def marked() -> pa.RecordBatch:
            raised()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sketch.often(least, marks - spread)], pa.binary())], names=["block", "often"])

        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != at:
                    if at is not None:
                        yield marked()
                    sketch, at = Sketch(bits - spread), block
                waiting.append(_received(cells.as_py()))
                if sum(map(len, waiting)) >= STRETCH:
                    raised()
        if at is not None:
            yield marked()

    blocks = texts.transform(in_arrow, sketched, "block int, cells binary").repartition("block").sortWithinPartitions("block")
    size = (1 << marks - spread) // 8
    packed = np.zeros((1 << marks) // 8, np.uint8)
    for block, often in blocks.transform(in_arrow, added, "block int, often binary").collect():  # of a bounded size, however large the texts
        packed[block * size : (block + 1) * size] = np.frombuffer(often, np.uint8)
    return packed


def _kept(own: np.ndarray, ids: np.ndarray, left: np.ndarray, starts: int, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """From each of the first ``starts`` places, how many words may be a phrase that is frequent enough."""
    hashes = list(prefix_hashes(own[ids], LONGEST))
    kept = (_passed(_mixed(own), short)[ids[:starts]] & (left[:starts] > 0)).astype(np.int64)
    if len(hashes) > 1:
        two = _two(hashes, left, short)
        kept += (kept == 1) & two[:starts]
        follows = two[1 : starts + 1]
        for k in range(2, len(hashes)):
            at = np.flatnonzero((kept == k) & (left[:starts] > k) & follows)
            kept[at] += _passed(hashes[k][at], long)
            follows = two[k : starts + k]
    return kept


def _spelled(words: pa.Array, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The texts of the ``size`` words from ``first`` on in ``ids``."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = ids[np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words.take(pa.array(flat))), pa.scalar(" ", words.type))


def _ends(ids: np.ndarray, kept: np.ndarray, stop: int, words: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(word numbers in a row, words of each, counts) of the pieces that end with fewer than four words, by their number of words."""
    for size in range(LONGEST):
        at = np.flatnonzero((kept == size) & (ids[: len(kept)] != stop))
        key = np.zeros(len(at), np.int64)
        for k in range(size):
            key = key * words + ids[at + k]
        key, weight = np.unique(key, return_counts=True)
        flat = np.empty((len(key), size), np.int64)
        for k in range(size - 1, -1, -1):
            key, flat[:, k] = np.divmod(key, words)
        yield flat.ravel(), size, weight


def _chains(texts: DataFrame, short: Broadcast, long: Broadcast, stretch: int) -> DataFrame:
    """``(lang, words, size, weight)``: compacted chains of edges, and the ends of pieces with fewer than four words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, words, stop, starts in _stretches(batches, stretch):
            kept = _kept(word_hashes(words, lang), ids, room(ids, stop, len(ids)), starts, short.value, long.value)
            first, last, weight = compact_graph(ids, np.flatnonzero(kept == LONGEST))
            found = [(ids, first, last + 1 - first, weight)]
            found += [(flat, np.arange(len(times)) * size, np.full(len(times), size), times) for flat, size, times in _ends(ids, kept, stop, len(words))]
            for flat, first, size, weight in found:
                for k in range(0, len(first), ROWS):
                    part = slice(k, k + ROWS)
                    spelled = _spelled(words, flat, first[part], size[part]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(spelled), pa.string()), spelled, pa.array(size[part], pa.int32()), pa.array(weight[part], pa.int64())], names=["lang", "words", "size", "weight"])

    return texts.transform(in_arrow, run, "lang string, words string, size int, weight bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """``(lang, gram, f)``: the exact count of every phrase of 1 to 4 words found ``least`` times or more, and of all words as gram ''.

    ``bits`` fixes the number of counters, which else follows the size of the texts.
    """
    if not 1 <= least <= 255:
        raise ValueError("least is 1 to 255: the sketch's counters end there")
    if bits is not None and not 3 <= bits <= 40:
        raise ValueError("the sketch has 8 counters at least, 2**40 at most")
    if not 1 <= stretch <= STRETCH:
        raise ValueError(f"a stretch has 1 to {STRETCH} words")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    if bits is None:
        bits = sketch_bits(texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)
    context = docs.sparkSession.sparkContext
    short = context.broadcast(_often(texts, None, bits, least, stretch))
    long = context.broadcast(_often(texts, short, bits, least, stretch))
    chains = _chains(texts, short, long, stretch)
    # most rows are no chains and stay as they are, unsplit
    unrolled = F.transform(F.sequence(F.lit(1), F.col("size") - (LONGEST - 1)), lambda i: F.array_join(F.slice(F.split("words", " "), i, LONGEST), " "))
    grams = F.when(F.col("size") <= LONGEST, F.array("words")).otherwise(unrolled)
    edges = chains.select("lang", F.explode(grams).alias("gram"), "weight").groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    # flow: what starts with a phrase goes through its node, the edges that leave it and the pieces that end in it alike
    words = F.split("gram", " ")
    size = F.when(F.col("gram") == "", 0).otherwise(F.size(words))
    prefixes = F.transform(F.sequence(F.lit(0), size), lambda k: F.array_join(F.slice(words, 1, k), " "))
    flow = edges.select("lang", F.explode(prefixes).alias("gram"), "weight").groupBy("lang", "gram").agg(F.sum("weight").alias("f"))
    return flow.where((F.col("f") >= least) | (F.col("gram") == ""))


def _decimal(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int | None = None, stretch: int = STRETCH) -> DataFrame:
    """The best collocations per language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text. Texts are lower-cased in A-Z, cut into pieces at
    ``[.,;:!?]`` and line ends, and into words at blanks and tabs. A null lang is
    ``und``, a null text is empty; a lang without words, and an empty table, give no
    rows. Repeated rows count each time. Ties go by count, then by the phrase's
    bytes. Very long texts are handled in stretches. Columns beyond the two are not
    read. ``a`` is the phrase's count, ``l`` and ``r`` those of the parts at its
    lowest-scoring cut, ``n`` the language's words; the score is
    ``floor(2000000 a / (l + r))``. A phrase within a longer one that is found at
    least 4/5 as often is left out.
    """
    counts = stored(phrase_counts(docs, least, bits, stretch), "phrase-counts")
    total = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    words = F.split("gram", " ")
    sized = counts.where("gram <> ''").select("lang", "gram", "f", words.alias("words"), F.size(words).alias("size"))
    longer = sized.where("size > 2")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("size") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    around = longer.select("lang", F.explode(inner).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("around"))
    free = sized.where("size > 1").join(around, ["lang", "gram"], "left").where(F.col("around").isNull() | (5 * _decimal(F.col("around")) < 4 * _decimal(F.col("f"))))
    cuts = free.select("lang", "gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "words", "size")
    cuts = cuts.select("lang", "gram", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    part = lambda name, count: sized.select("lang", F.col("gram").alias(name), F.col("f").alias(count))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = both.withColumn("score", F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    flat = best.select("lang", F.col("gram").alias("phrase"), "x.a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share first, so no task meets all phrases of a language
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = flat.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    near = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    placed = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return placed.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

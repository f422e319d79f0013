"""SimHash near-duplicates found in BK-trees.

Distinct fingerprints are dealt to shards by the bits of several blocks: with
``blocks`` blocks and radius ``r``, fingerprints at most ``r`` bits apart agree
in ``blocks - r`` blocks or more, so every choice of that many blocks is one key.
Each shard is one BK-tree: the children of a node are keyed by their integer
Hamming distance to it, and a search with radius ``r`` follows only the edges
``d - r .. d + r``. All trees of a partition are built and searched together,
level by level, in NumPy. Trees stay with the tasks that own their shard: their
number and size grow with the data, so they are not broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import arrow_rows, components, in_arrow, stored

BITS = 64


def simhash(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: lower and split know ASCII only
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), 65536):
        hashes = np.fromiter([digest(flat[a:b], 42) for a, b in zip(starts[k : k + 65536], ends[k : k + 65536])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits in a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterable[dict]:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fp = simhash(text, shingle)
                yield {"doc_id": doc_id, "fp": fp - (1 << 64) if fp >> 63 else fp}

        return step

    return arrow_rows(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, fp bigint")


class Forest:
    """BK-trees over 64-bit values, one per group; a group's values are distinct."""

    def __init__(self, groups: np.ndarray, values: np.ndarray) -> None:
        n = len(values)
        self.values, self.groups = values, groups
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n, np.int64)
        # the first value of a group is its root; all others travel down together
        order = np.argsort(groups, kind="stable")
        begins = np.ones(n, bool)
        begins[1:] = groups[order][1:] != groups[order][:-1]
        self.roots = order[begins]
        at = np.empty(n, np.int64)
        at[order] = self.roots[np.cumsum(begins) - 1]
        travelling = np.flatnonzero(at != np.arange(n))
        while len(travelling):
            distance = np.bitwise_count(values[travelling] ^ values[at[travelling]]).astype(np.int64)
            slot = at[travelling] * (BITS + 1) + distance
            _, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = travelling[first]
            self.parent[child], self.edge[child] = at[child], distance[first]
            at[travelling] = child[inverse]
            travelling = travelling[at[travelling] != travelling]
        # children of a node in edge order, as one sorted list of slots
        held = np.flatnonzero(self.parent >= 0)
        slots = self.parent[held] * (BITS + 1) + self.edge[held]
        by = np.argsort(slots)
        self.slots, self.children = slots[by], held[by]

    def within(self, radius: int, step: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(i, j)``, i > j, of values of one group at most ``radius`` bits apart, piece by piece."""
        n = len(self.values)
        order = np.argsort(self.groups, kind="stable")
        begins = np.ones(n, bool)
        begins[1:] = self.groups[order][1:] != self.groups[order][:-1]
        root_of = np.empty(n, np.int64)
        root_of[order] = self.roots[np.cumsum(begins) - 1]
        waiting = [(np.arange(k, min(n, k + 20_000)), root_of[k : k + 20_000]) for k in range(0, n, 20_000)]
        while waiting:
            query, node = waiting.pop()
            if len(query) > 2 * step:
                waiting += [(query[k : k + step], node[k : k + step]) for k in range(0, len(query), step)]
                continue
            distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
            near = (distance <= radius) & (node < query)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.slots, node * (BITS + 1) + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.slots, node * (BITS + 1) + np.minimum(distance + radius, BITS), "right")
            count = high - low
            if count.any():
                again = np.repeat(np.arange(len(query)), count)
                within = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                waiting.append((query[again], self.children[low[again] + within]))


def spanning(groups: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same components as all pairs within ``radius``: at most one less than the values."""
    n = len(values)
    label = np.arange(n)
    kept_a, kept_b = [], []
    for a, b in Forest(groups, values).within(radius):
        while len(a):
            la, lb = label[a], label[b]
            open_ = la != lb
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            if not len(a):
                break
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            roots, first = np.unique(high, return_index=True)  # each root hooks onto one lower root
            kept_a.append(a[first])
            kept_b.append(b[first])
            label[roots] = low[first]
            while not np.array_equal(label, jumped := label[label]):
                label = jumped
    empty = np.empty(0, np.int64)
    return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (empty, empty)


def block_keys(fp: Column, blocks: int, radius: int) -> Column:
    """Array of shard keys: one for each choice of ``blocks - radius`` blocks, hashed with the choice."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(signed).cast("bigint"))))
    return F.array(*keys)


def near_links(values: DataFrame, radius: int = 4, blocks: int | None = None, shard_limit: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs ``fp`` of ``values`` that span their components.

    Two values link when at most ``radius`` of their bits differ. Only spanning
    links of each shard are returned, never all pairs. ``blocks`` is chosen so
    that shards of spread-out values stay small; it changes no result. A shard
    of more than ``shard_limit`` values is dealt to several tasks: its values are
    cut into chunks by hash and every pair of chunks gets a tree of its own, so
    a task's memory is bounded and no pair is missed.
    """
    if blocks is None:
        n = values.count()
        blocks = radius + 2
        while n > 64 << (BITS * (blocks - radius) // blocks) and blocks < radius + 5:
            blocks += 1
    keyed = values.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("key"))
    full = keyed.groupBy("key").count().where(F.col("count") > shard_limit)
    full = stored(full.select("key", F.ceil(F.col("count") / shard_limit).cast("int").alias("chunks")), "shards")
    if full.limit(1).count():
        own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
        keyed = (
            keyed.join(full, "key", "left").withColumn("own", own)
            .select("fp", "key", "own", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("other"))
            .select("fp", F.when(F.col("own").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"))
        )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards arrive together and sorted; trees are built for some 100,000 values at a time."""
        keys, fps, held = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, fps, held
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            if cut:
                a, b = spanning(key[:cut], fp[:cut], radius)
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            held += batch.num_rows
            if held > 100_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    dealt = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.transform(in_arrow, link, "a bigint, b bigint")


def near_components(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Words are runs of non-blank characters after lower-casing A-Z; a text of
    fewer words than ``shingle`` is one shingle, one without words (null and
    empty too) has fingerprint zero and links like any other. Rows link at
    ``radius`` or fewer differing bits; ``component_id`` is the smallest doc_id
    reachable, the row's own included. A null doc_id keeps its row and never
    names a component unless it is alone (then null). Repeated rows share their
    fingerprint and are all returned; rows that share a doc_id but not a text are
    separate. An empty table gives no rows. Other columns are not read.
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    least = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(least.select("fp"), radius), "components")
    labelled = stored(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labels")
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "root").join(named, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that lead their component: those whose doc_id is the component's.

    Columns pass through unchanged. Rows without a doc_id are kept. Rows that
    repeat a doc_id are judged by it: the id stays if it leads any component.
    """
    found = near_components(docs.select("doc_id", "text"), shingle, radius)
    losers = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads")).where("NOT leads").select(F.col("doc_id").alias("__lost"))
    return docs.join(losers, docs["doc_id"] == losers["__lost"], "left_anti")

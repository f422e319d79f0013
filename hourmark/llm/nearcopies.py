"""Near copies: SimHash links by BK-trees, checked by exact Jaccard similarity, and a prefix-filter join for what lies further apart.

SimHash fingerprints of all texts go through the BK-trees of ``simhash``; what they
link and is ``4/5`` alike is one component. Fingerprints of texts that are 4/5 alike
can differ in more bits than any radius that shards well, so the remaining links
between these components are found by a prefix-filter join, and none is lost.

Two sets are ``4/5`` alike only if each has at most a fifth of its shingles
outside the other. So a text with more than a fifth of its shingles found in no
other text has no near copy and drops out at once; that is counted on the third
of the shingles with the smallest hashes, which can only count too few. For the
rest, shingles are ordered from rare to common; near copies share one of the
first ``n - ceil(4n/5) + 1``, and at the first one they share, enough shingles must be
left after it on either side. A large group of near copies is not compared all
with all: first texts meet their neighbours in sorted min-hash sketches, most of
which are links, so the group is one component before any shingle is joined. Then every pair
that could still join two components is compared, so the components are those of all pairs.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.llm import simhash
from hourmark.llm.common import components, forget, in_arrow, stars, stored

SHINGLE = 5
#: Bits in which linked fingerprints may differ.
RADIUS = 4
#: Rounds of neighbours before all open pairs are listed, and open pairs per listed shingle at which that is done sooner.
ROUNDS, OPEN = 10, 0.5
#: Sketches of a text in a round, and neighbours it meets in each.
BANDS, NEIGHBOURS = 20, 3
#: A third of the hashes: those below it as unsigned numbers.
THIRD = (1 << 64) // 3
#: A sixth: pairs are compared on these hashes first.
SIXTH = (1 << 64) // 6


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a shorter text is one shingle, also one without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: lower and split know ASCII only
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(flat)], np.uint64)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter([digest(flat[a:b]) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64, len(starts)))


def _low(docs: DataFrame, size: int) -> DataFrame:
    """``(node, n, h)``: a row per distinct shingle of a text with a hash under ``THIRD``, and the number of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                used = [s[: np.searchsorted(s, np.uint64(THIRD))] for s in sets]
                counts = [len(u) for u in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), counts)), pa.array(np.repeat([len(s) for s in sets], counts).astype(np.int32)),
                        pa.array(np.concatenate(used).view(np.int64)),
                    ],
                    names=["node", "n", "h"],
                )

    return docs.select("node", "text").transform(in_arrow, run, "node bigint, n int, h bigint")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(node, n, few, hs)``: the shingles of each text, their number, and those under ``SIXTH``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.int64())
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingles(t, size) for t in part.column(1).to_pylist()]
                few = [s[: np.searchsorted(s, np.uint64(SIXTH))].view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(few, lists), pa.array([s.view(np.int64) for s in sets], lists)], names=["node", "n", "few", "hs"]
                )

    return docs.select("node", "text").transform(in_arrow, run, "node bigint, n int, few array<bigint>, hs array<bigint>")


def _sketches(sets: DataFrame, k: int) -> DataFrame:
    """``(node, n, band, x)``: the bytes of ``x`` are from the least of the shingles under eight hash functions, other ones for each band and ``k``."""
    factors = np.random.default_rng(k).integers(0, 1 << 63, 8 * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(hs: np.ndarray) -> np.ndarray:
        least = np.full(len(factors), ~np.uint64(0))
        for start in range(0, len(hs), 1024):
            least = np.minimum(least, (hs.view(np.uint64)[start : start + 1024, None] * factors).min(axis=0))
        return least.astype(np.uint8).view(">i8").astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                xs = [sketch(hs) for hs in part.column(2).to_numpy(zero_copy_only=False)]
                node, n = (np.repeat(part.column(c).to_numpy(), BANDS) for c in (0, 1))
                bands = np.tile(np.arange(BANDS, dtype=np.int32), len(xs))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(bands), pa.array(np.concatenate(xs))], names=["node", "n", "band", "x"])

    return sets.select("node", "n", "hs").transform(in_arrow, run, "node bigint, n int, band int, x bigint")


def _neighbours(sets: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """Pairs ``(a, b)`` of different roots that are ``NEIGHBOURS`` or fewer places apart in a band, agree in half of its sketch and could be 4/5 alike by size."""
    rows = _sketches(sets, k).join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = Window.partitionBy("band", F.shiftrightunsigned("x", 32)).orderBy("x", "node")
    near = F.array(*(F.lag(F.struct("node", "n", "root"), d).over(by) for d in range(1, NEIGHBOURS + 1)))
    may = lambda o: (o["root"] != F.col("root")) & (5 * F.least(o["n"], F.col("n")) >= 4 * F.greatest(o["n"], F.col("n")))
    found = rows.withColumn("near", near).select("node", F.explode(F.filter("near", may)["node"]).alias("other"))
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets are at least 4/5 alike; 4/9 of both sizes must be in common.

    A sixth of the hashes is compared first: all others could be in common, so no pair is lost.
    """
    side = lambda k, c: sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col(c).alias(f"h{k}")).hint("merge")
    both = lambda of, c: of.join(side("a", c), "a").join(side("b", c), "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    enough = lambda most: 9 * most >= 4 * (F.col("na") + F.col("nb"))
    rest = F.least(F.col("na") - F.size("ha"), F.col("nb") - F.size("hb"))
    may = both(pairs, "few").where(enough(F.col("common") + rest)).select("a", "b")
    return both(may, "hs").where(enough(F.col("common"))).select("a", "b")


def simhash_pairs(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)`` that join all rows of ``marks(node, fp)`` linked by fingerprints at most ``radius`` bits apart."""
    lead = stored(marks.groupBy("fp").agg(F.min("node").alias("lead")), "fp-leaders")
    links = simhash.near_links(lead.select("fp"), radius).distinct()
    of = lambda k: lead.select(F.col("fp").alias(f"f{k}"), F.col("lead").alias(k))
    across = links.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("a"), "fa").join(of("b"), "fb").select("a", "b")
    return marks.join(lead, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).unionByName(across)


def _may_link(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles that share their numbers ``at`` and ``to`` (from 0), and none before, can be 4/5 alike.

    They need ``4/9 (n + m)`` shingles in common. A pair that shares an earlier one is met there.
    """
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - to) >= 4 * (n + m))


def _early(n: Column, i: Column) -> Column:
    """Whether the smaller of two texts that may link can have its shared shingle there; by ``_may_link`` it is in the first ninth."""
    return 9 * i <= n


def _open_pairs(held: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different roots that may link at a shingle of ``held(node, n, i, h, root)``, once for each; ``group(h, main)`` has the largest root."""
    now = held.join(group, "h").withColumn("early", _early(F.col("n"), F.col("i")))
    # of two components one is not the largest of its shingle, and of two texts one is early
    meets = F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    one = now.where("root <> main").select("h", F.explode(meets).alias("early"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("i").alias("ia"))
    other = now.select("h", "early", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    pairs = one.join(other, ["h", "early"]).where((F.col("ra") != F.col("rb")) & _may_link(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_links(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links ``(a, b)`` that join the same components as all pairs of ``docs(node, text)`` that are 4/5 alike."""
    named = docs.select(F.col("node").alias("doc_id"), "text")
    prints = stored(simhash.fingerprints(named, size).select(F.col("doc_id").alias("node"), "fp"), "fingerprints")
    lone = _low(docs, size).groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.min("n").alias("n")).where("node = last")
    out = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"), F.max("n").alias("n")).where("5 * lone > n").select("node")
    lonely = stored(out, "lone")
    marks = stored(prints.groupBy("node", "fp").agg(F.count(F.lit(1)).alias("c")).join(lonely.hint("merge"), "node", "left_anti"), "marks")  # tables by node grow with the texts: none goes through the driver
    del lone, out, named
    forget(prints)
    left = docs.join(lonely.hint("merge"), "node", "left_anti")
    twice = marks.where("c > 1").select("node").hint("merge")
    left = left.join(twice, "node", "left_anti").unionByName(left.join(twice, "node", "left_semi").dropDuplicates(["node"]))
    sets = stored(_sets(left, size), "sets")
    del left, twice
    forget(lonely)
    links = stored(_alike(simhash_pairs(marks), sets), "links")
    forget(marks)
    listed = sets.select("node", "n", F.explode("hs").alias("h"))
    counted = listed.join(listed.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h")
    ordered = counted.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("all"))
    first = ordered.select("node", "n", F.posexplode(F.expr("slice(all, 1, n - (4 * n + 4) div 5 + 1)")).alias("i", "x"))
    postings = first.where("x.df > 1").select("node", "n", "i", F.col("x.h").alias("h"))
    shared = postings.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(_early(F.col("n"), F.col("i"))).alias("early")).where("m > 1 AND early").select("h")
    postings = stored(postings.join(shared, "h"), "postings")
    del counted, ordered, first, shared, listed
    gc.collect()
    docs.sparkSession._jvm.System.gc()  # the shuffles of these tables go
    total = postings.count()
    before = None
    for k in range(ROUNDS + 1):
        roots = stars(links, "near")  # all that earlier links joined
        forget(links, shuffles=False)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        last, read = k == ROUNDS, [roots]
        if k or last:
            held = stored(postings.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
            of_root = held.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
            group = of_root.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root"))["root"].alias("main")).where("roots > 1").select("h", "main")
            group = stored(group, "groups")
            read += [held, group]
            pairs = _open_pairs(held, group)
            open_ = pairs.count()
            if not open_:
                break
            # listed when few, or when a round no longer makes them fewer
            last = last or open_ <= OPEN * total or (before is not None and 10 * open_ > 9 * before)
            before = open_
            del of_root, held, group
        pairs = pairs.distinct() if last else _neighbours(sets, roots, k)
        more = stored(links.unionByName(_alike(pairs, sets)), "links")
        del pairs
        gc.collect()
        forget(*read)
        links = more
        if last:
            break
    return links


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per component of near copies stays: that with the smallest doc_id.

    Words are those of ``simhash``; texts link when their sets of ``size``-word
    shingles have a Jaccard similarity of 0.8 or more. A row without a doc_id
    stays if it has no near copy with one. Columns pass through unchanged; rows
    equal in doc_id and text share their fate. An empty table gives no rows.
    """
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    links = near_links(docs.select(node.alias("node"), "text"), size)
    roots = stored(components(links, "near"), "near-roots")
    named = docs.select(node.alias("node"), "doc_id").join(roots.hint("merge"), "node").select("root", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node").alias("key"))
    first = named.groupBy("root").agg(F.min("key")["node"].alias("kept"))
    lost = roots.join(first, "root").where("node <> kept").select(F.col("node").alias("__lost"))
    return docs.join(lost, node == lost["__lost"], "left_anti")

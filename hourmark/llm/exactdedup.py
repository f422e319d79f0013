"""Exact de-duplication with an extendible-hash index on shared files (built-in functions only).

The directory maps hash prefixes to buckets. It starts with one bucket and is
doubled while a bucket holds more distinct keys than its capacity; only the
overfull buckets split, the others keep their shorter prefix. Copies are counted
before they travel, then owner tasks take ranges of buckets: there texts whose hash collides
are chained, told apart by their bytes, and each chain entry picks the row that stays. The
index goes to the shared folder ordered by bucket, and every row finds its group by
the bucket that the directory names for its hash, the hash and the chain entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.llm.common import stored

#: Distinct keys a bucket holds before it splits, the deepest directory, and the parts in which copies of one text are counted.
CAPACITY, MOST_BITS, PARTS = 4096, 40, 16


def normalised(text: str = "text") -> Column:
    """The text without the six blank characters; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _prefix(key: Column, bits: Column) -> Column:
    """The leading ``bits`` bits of a signed 64-bit hash, as a number from 0."""
    return F.call_function("shiftrightunsigned", key, F.lit(64) - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(depth, prefix)`` of every bucket for the distinct longs ``h`` of ``keys``.

    A round counts the keys below each prefix that is still open, closes those
    within capacity and doubles the directory for the rest. Equal keys are
    counted once, so copies never split a bucket.
    """
    distinct = stored(keys.select("h").distinct(), "keys")
    buckets = None
    open_, depth = distinct.select("h"), 0
    while True:
        level = F.lit(depth)
        prefix = _prefix(F.col("h"), level) if depth else F.lit(0).cast("bigint")
        counted = stored(open_.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "directory")
        full = counted.where(F.col("n") > capacity)
        last = depth >= MOST_BITS or not full.limit(1).count()
        closed = (counted if last else counted.where(F.col("n") <= capacity)).select(level.alias("depth"), "prefix")
        buckets = closed if buckets is None else buckets.union(closed)
        if last:
            return stored(buckets, "buckets")
        open_ = distinct.join(full.select("prefix"), F.col("prefix") == prefix, "left_semi")
        # doubling by as many bits as the fullest bucket needs at least
        most = full.agg(F.max("n")).first()[0]
        depth += max(1, (most // capacity).bit_length() - 1)


def _start(depth: Column, prefix: Column) -> Column:
    """A bucket's prefix, left-aligned in 64 bits."""
    return F.when(depth == 0, F.lit(0)).otherwise(F.call_function("shiftleft", prefix, F.lit(64) - depth)).cast("bigint")


def _in_order(key: Column) -> Column:
    """A signed hash so that it sorts as an unsigned number."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def bucketed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (narrow, with a hash ``h``) and the ``bucket`` and ``depth`` that the directory names for each; others drop out."""
    levels = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # at most MOST_BITS values
    if not levels:
        return rows.select("*", F.lit(0).cast("bigint").alias("bucket"), F.lit(0).alias("depth"))
    slots = F.array(*[F.struct(F.lit(d).alias("depth"), (_prefix(F.col("h"), F.lit(d)) if d else F.lit(0).cast("bigint")).alias("prefix")) for d in levels])
    placed = rows.select("*", F.explode(slots).alias("_slot")).select(*rows.columns, "_slot.depth", "_slot.prefix")
    return placed.join(buckets, ["depth", "prefix"]).select(*rows.columns, _start(F.col("depth"), F.col("prefix")).alias("bucket"), "depth")


def _owner_bounds(buckets: DataFrame, owners: int) -> list[int]:
    """First bucket of every owner but the first, in sorted order: neighbouring buckets, about as many for each."""
    ordered = buckets.select(_in_order(_start(F.col("depth"), F.col("prefix"))).alias("at"))
    cuts = ordered.agg(F.percentile_approx("at", F.array(*[F.lit(k / owners) for k in range(1, owners)]), 10_000).alias("c")).first()["c"] if owners > 1 else []
    return sorted(set(cuts or []))


def hash_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index and its directory. The index has one row per distinct normalised text of ``docs``.

    Columns: bucket (its prefix, left-aligned), depth, h, chain (place among the
    texts of one hash), sha (of the normalised text), n (rows with that text), most
    (code points of the row that stays) and keep_id (its doc_id).
    """
    points = F.length(F.coalesce(F.col("text"), F.lit("")))
    best = F.struct((-points).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = docs.select(F.xxhash64(normalised()).alias("h"), normalised().alias("body"), best.alias("best"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    # copies collapse before the exchange; a text with very many comes as PARTS entries
    entries = stored(rows.groupBy("h", "body", "part").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best")).drop("part"), "entries")
    buckets = directory(entries, capacity)
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _owner_bounds(buckets, owners)
    # an owner takes the keys between two bounds; grouping by hash and bytes keeps that deal
    owner = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= _in_order(F.col("h")))) if bounds else F.lit(0)
    owned = entries.withColumn("owner", owner).repartitionByRange(owners, "owner", "h")
    chosen = owned.groupBy("owner", "h", "body").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    sha = F.sha2(F.encode("body", "UTF-8"), 256)
    chain = F.row_number().over(Window.partitionBy("owner", "h").orderBy("sha")) - 1
    chained = chosen.select("owner", "h", sha.alias("sha"), "n", (-F.col("best.order")).alias("most"), F.col("best.doc_id").alias("keep_id")).withColumn("chain", chain).drop("owner")
    placed = bucketed(stored(chained, "chains"), buckets).select("bucket", "depth", "h", "chain", "sha", "n", "most", "keep_id")
    return stored(placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain"), "index"), buckets


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every blank character; null
    counts as empty. Of equal texts the row with the most code points in its own
    text stays, then the smallest doc_id; a null doc_id only stays when no other
    is left (keep_id is null, the row is kept). Rows that repeat a doc_id and a
    length within a group count in group_size and share one verdict. An empty
    table gives no rows. Other columns are not read.
    """
    index, buckets = hash_index(docs, capacity)
    sha = F.sha2(F.encode(normalised(), "UTF-8"), 256)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("points"), F.xxhash64(normalised()).alias("h"), sha.alias("sha"))
    looked_up = bucketed(stored(own, "documents"), buckets).drop("depth")
    return looked_up.join(index.drop("depth"), ["bucket", "h", "sha"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay; columns pass through.

    A row that repeats doc_id and text stays with its twin; a null doc_id stays when
    no row with one has its text. An empty table gives no rows.
    """
    found = exact_groups(docs.select("doc_id", "text"), capacity)
    lost = found.where("NOT kept").select(F.col("doc_id").alias("__lost"), F.col("text_sha256").alias("__sha")).distinct()
    stays = found.where("kept").select(F.col("doc_id").alias("__lost"), F.col("text_sha256").alias("__sha"))
    gone = lost.join(stays, (lost["__lost"].eqNullSafe(stays["__lost"])) & (lost["__sha"] == stays["__sha"]), "left_anti")
    sha = F.sha2(F.encode(normalised(), "UTF-8"), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__lost"]) & (sha == gone["__sha"]), "left_anti")

"""Sharding along a Hilbert curve over several metadata dimensions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import ranked


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve; each dimension lies in [0, 2**bits).

    Skilling's transposition on an array: undo the excess rotation per bit and
    dimension, Gray-encode, then interleave. At most 63 bits in all.
    """
    n = len(dims)
    if n * bits > 63:
        raise ValueError("dimensions times bits must stay below 64")
    steps = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        q, p = s["q"], s["q"] - 1
        first, own = F.element_at(x, 1), F.element_at(x, s["i"] + 1)
        is_set = own.bitwiseAND(q) != 0
        t = F.when(is_set, p).otherwise(first.bitwiseXOR(own).bitwiseAND(p))
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(t)).when((j == s["i"]) & ~is_set, v.bitwiseXOR(t)).otherwise(v))

    def once(value: Column, use) -> Column:
        """``use(value)`` with the value computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    masks = [1 << b for b in range(bits - 1, 0, -1)] or [1]
    flips = F.array(*[F.lit(q).cast("bigint") for q in masks])
    places = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j), v, lambda a, w: a.bitwiseXOR(w)))

    def flipped(x: Column) -> Column:
        flip = F.aggregate(flips, F.lit(0).cast("bigint"), lambda t, q: F.when(F.element_at(x, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return once(flip, lambda f: F.transform(x, lambda v: v.bitwiseXOR(f)))

    def interleaved(x: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("bigint"), lambda a, s: a * 2 + F.when(F.element_at(x, s["i"] + 1).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    start = F.array(*[d.cast("bigint") for d in dims])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    return once(once(once(turned, gray), flipped), interleaved)


def half_octave(size: Column) -> Column:
    """Two steps per power of two of a positive size, in integers: 0 to 119."""
    exponent = F.length(F.bin(size)) - 1
    half = F.call_function("shiftright", size, F.greatest(exponent - 1, F.lit(0))).bitwiseAND(1)
    return (exponent * 2 + F.when(exponent > 0, half).otherwise(0)).cast("bigint")


def hilbert_shards(docs: DataFrame, shards: int = 40, bits: int = 6) -> DataFrame:
    """Every row's place when rows are sorted on a Hilbert curve and cut into equal runs.

    Dimensions: size in half octaves, source and language hashed to ``2**bits``
    cells each. A run of the curve is compact in all of them, so files written by
    shard prune on any. Law ``rows``: shard counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law,
    shard, slot (gapless from 0 in the shard), grown_shard (null), curve (the
    index). Ties on the curve are ordered by text hash, then doc_id, so equal
    texts of one source, language are neighbours; repeated rows get slots of
    their own. A null text counts no bytes and has CRC 0; null source, language
    or doc_id are values like others (nulls first). An empty table gives no rows;
    fewer rows than shards leave shards empty. Other columns are not read.

    One range exchange of narrow rows; a hot source is split, as the sort key
    ends in the document itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 16
    cell = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    step = F.least(F.greatest(half_octave(F.col("size")) - 8, F.lit(0)), F.lit((1 << bits) - 1))
    keyed = (
        docs.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("__text"), cell("source").alias("__s"), cell("lang").alias("__l"))
        .withColumn("__z", step)
        .select("doc_id", "size", "text_crc32", "__text", hilbert_index([F.col("__z"), F.col("__s"), F.col("__l")], bits).alias("curve"))
    )
    placed = ranked(keyed, ["curve", "__text", "doc_id"], "hilbert")
    shard = F.expr(f"(__rank * {shards}) div __total")
    # the first rank of shard s is ceil(s * total / shards)
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("__rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )

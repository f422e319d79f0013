"""Merkle manifest of a document table: per-source trees under one root, a proof for every row.

A level of the tree is never a table of nodes. Each aligned block of ``SPAN``
consecutive nodes of a source keeps its level as one hex string; the parents are
the hashes of fixed-width substrings of it, and the siblings of a node are the
substrings that flank it in its run. A block rises two levels at once, and the
roots of the blocks are the nodes of the next round, until each source has one
root; the sources' roots then go through the same rounds as one group. Rows,
blocks and sources are all dealt evenly: a source with most of the rows only has
more blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.llm.common import ranked, stored

#: Children of a node, nodes of a block (two levels), and hex digits of a digest.
FAN, SPAN, WIDTH = 16, 256, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(data: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(data, 256)


def leaf(values: list[Column]) -> Column:
    """Digest of the values in order: ``-`` for null, else the UTF-8 length, a colon and the value."""
    shown = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]))


def _block_levels(nodes: DataFrame, keys: list[str], entry: Column) -> DataFrame:
    """``(keys, n, block, m, entries, low, mid, root)``: the nodes of each aligned block and the levels above them.

    ``nodes`` has keys, pos (from 0), n (nodes of the group) and h. ``low`` holds
    the digests of the block's ``m`` nodes, ``mid`` those of their runs; groups of
    one node rise no level, groups of up to ``FAN`` one, all others two.
    """
    block = F.expr(f"pos div {SPAN}").alias("block")
    blocks = nodes.groupBy(*keys, "n", block).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    low = blocks.withColumn("m", F.size("entries")).withColumn("low", F.array_join(F.transform("entries", lambda e: e["h"]), ""))
    runs = F.sequence(F.lit(0), F.expr(f"(m - 1) div {FAN}"))
    mid = F.array_join(F.transform(runs, lambda r: digest(F.substring(F.col("low"), r * (FAN * WIDTH) + 1, FAN * WIDTH))), "")
    two = low.withColumn("mid", F.when(F.col("n") > 1, mid))
    return two.withColumn("root", F.when(F.col("n") <= 1, F.col("low")).when(F.col("n") <= FAN, F.col("mid")).otherwise(digest(F.col("mid"))))


def _flanks(level: Column, at: Column, begin: Column, end: Column) -> Column:
    """The digests beside number ``at`` of a level among numbers ``begin`` to ``end`` (exclusive), left and right."""
    left = F.substring(level, begin * WIDTH + 1, (at - begin) * WIDTH)
    right = F.substring(level, (at + 1) * WIDTH + 1, (end - at - 1) * WIDTH)
    return F.struct(left.alias("l"), right.alias("r"))


def _own_steps(at: Column) -> Column:
    """The one or two steps from node ``at`` of a block up to the block's root, none for a group of one node."""
    run = F.floor(at / FAN).cast("int")
    runs = F.floor((F.col("m") - 1) / FAN).cast("int") + 1
    low = _flanks(F.col("low"), at, run * FAN, F.least(F.col("m"), (run + 1) * FAN))
    mid = _flanks(F.col("mid"), run, F.lit(0), runs)
    none = F.array().cast("array<struct<l:string,r:string>>")
    return F.when(F.col("n") <= 1, none).when(F.col("n") <= FAN, F.array(low)).otherwise(F.array(low, mid))


def _paths(nodes: DataFrame, keys: list[str], rounds: int) -> tuple[DataFrame, DataFrame]:
    """``(paths, roots)``: per node the steps (left and right siblings) to its group's root, and each group's root."""
    if rounds == 0:
        none = F.array().cast("array<struct<l:string,r:string>>")
        return nodes.select(*keys, "pos", none.alias("path")), nodes.select(*keys, F.col("h").alias("root"))
    blocks = stored(_block_levels(nodes, keys, F.struct("pos", "h")), "merkle-levels")
    above, roots = _paths(_upper_nodes(blocks, keys), keys, rounds - 1)
    steps = _with_steps(blocks, above, keys).select(*keys, "n", "m", "low", "mid", "steps", F.explode("entries").alias("e"))
    at = F.expr(f"cast(e.pos % {SPAN} as int)")
    return steps.select(*keys, F.col("e.pos").alias("pos"), F.concat(_own_steps(at), "steps").alias("path")), roots


def _upper_nodes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.select(*keys, F.col("block").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("root").alias("h"))


def _equal(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"__{k}"])
    return same


def _with_steps(blocks: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks with the ``steps`` from each one's root to its group's root."""
    other = above.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("pos").alias("__block"), F.col("path").alias("steps"))
    return blocks.join(other, _equal(keys, blocks, other) & (blocks["block"] == other["__block"]))


def _rounds(most: int) -> int:
    """Rounds of two levels that bring ``most`` nodes down to one."""
    rounds = 0
    while most > 1:
        most, rounds = -(-most // SPAN), rounds + 1
    return rounds


def tree_manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text, nulls marked.
    Leaves of a source ascend by doc_id (null first, ties by leaf); sources ascend
    bytewise, null first. ``folded_root`` starts from the leaf of the tampered row
    where 5 divides the CRC-32 of the decimal doc_id (its text with A-Z
    lower-cased), else from the leaf itself, and takes the original siblings.

    Null doc_ids are never tampered with; a null or empty text is hashed as such.
    Repeated rows have equal leaves and a proof each. A lone row is its own root
    with an empty proof. An empty table gives no rows. Texts of any length are
    hashed where they are read and never exchanged. Columns beyond the five are
    not read.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    lowered = F.translate("text", UPPER, UPPER.lower())
    tampered = F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", leaf(fields).alias("h"),
        F.when(tampered & (lowered != F.col("text")), leaf([*fields[:-1], lowered])).alias("changed"),
    )
    placed = ranked(rows, ["source", "doc_id", "h"], "merkle-leaves")
    groups = stored(placed.groupBy("source").agg(F.min("__rank").alias("start"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    facts = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    begun = groups.select(F.col("source").alias("__source"), "start", "n")
    nodes = placed.join(begun, placed["source"].eqNullSafe(begun["__source"])).withColumn("pos", F.col("__rank") - F.col("start"))
    blocks = stored(_block_levels(nodes, ["source"], F.struct("pos", "h", "doc_id", "changed")), "merkle-blocks")
    rounds = _rounds(facts[0] or 0)
    upper = _upper_nodes(blocks, ["source"])
    above, subroots = _paths(upper, ["source"], max(0, rounds - 1))
    subroots = stored(subroots, "merkle-subroots")

    numbered = ranked(subroots, ["source"], "merkle-order").select(F.lit(0).alias("g"), "source", F.col("__rank").alias("pos"), F.col("__total").alias("n"), F.col("root").alias("h"))
    tops, roots = _paths(numbered.drop("source"), ["g"], _rounds(facts[1]))
    top = numbered.select("g", F.col("source").alias("__source"), "pos", F.col("h").alias("subroot")).join(tops, ["g", "pos"]).join(roots, "g")
    top = stored(top.select("__source", "subroot", "root", F.col("path").alias("last")), "merkle-tops")
    known = above.join(top, above["source"].eqNullSafe(top["__source"])).select("source", "pos", F.struct(F.concat("path", "last").alias("steps"), "subroot", "root").alias("path"))

    whole = _with_steps(blocks.drop("root"), known, ["source"]).select("n", "m", "low", "mid", "steps", F.explode("entries").alias("e"))
    path = F.concat(_own_steps(F.expr(f"cast(e.pos % {SPAN} as int)")), F.col("steps.steps"))
    proven = whole.select("e.doc_id", F.col("e.h").alias("leaf"), F.coalesce("e.changed", "e.h").alias("shown"), "steps.subroot", "steps.root", path.alias("path"))
    folded = F.aggregate("path", F.col("shown"), lambda h, step: digest(F.concat(step["l"], h, step["r"])))
    proof = digest(F.array_join(F.transform("path", lambda step: F.concat(step["l"], step["r"])), ""))
    done = proven.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Small helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourmark.session import checkpoint_dir, ship_package

#: A word is a run of characters other than these six.
BLANKS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def forget(*tables: DataFrame, shuffles: bool = True) -> None:
    """Remove the folders of ``stored`` tables that nothing reads any more, and the shuffles of what wrote them.

    Only for tables whose readers are stored themselves. The shuffle files go when
    the driver drops its references to their plans, hence the collection; ``shuffles`` off leaves them to Spark.
    """
    spark = tables[0].sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in tables:
        where = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        where.getFileSystem(conf).delete(where, True)
    if shuffles:
        jvm.System.gc()


def repeated_rows(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, counts)``: the rows of a stored table whose keys occur more than once, and ``counts(keys, n)`` of those keys.

    A key with at least a fourth of a task's share of all rows is hot; there are at most four
    per task, whatever the data, so their list is broadcast and their rows stay where
    they are. All others are joined by key. Null keys are left out.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name)
    share = rows.count() / (4 * tasks)
    hot = F.broadcast(counted.where(F.col("n") >= share).select(*keys))
    rest = counted.where(F.col("n") < share).select(*keys)
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(rest, keys, "left_semi")), counted


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` on workers that have this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_rows(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], schema: str, rows: int = 512
) -> DataFrame:
    """Run a row maker per Arrow batch; ``make`` builds it once per task.

    Output batches hold at most ``rows`` rows, so long texts do not pile up.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                found = list(step(batch.slice(start, rows)))
                for k in range(0, len(found), 50_000):
                    yield pa.RecordBatch.from_pylist(found[k : k + 50_000], schema=out_schema)

    return in_arrow(df, run, schema)


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` sorted by ``keys`` with a gapless global ``__rank`` from 0, and its row count ``__total``.

    The sort deals by range; only one total per partition meets in one place.
    """
    ordered = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    kept = stored(ordered, name)
    sizes = kept.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total")
    )
    return kept.join(F.broadcast(offsets), "__pid").withColumn("__rank", F.col("__before") + F.col("__nth")).drop("__pid", "__nth", "__before")


def stars(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)`` that is not the smallest of its component; root is that smallest node.

    Alternates large-star and small-star steps until the edges no longer change.
    A round is one query of three exchanges, written to the shared folder, so lineage
    stays short; its rows tell whether they moved, so the end is seen by a scan. The driver's
    memory grows with queries and exchanges, hence few of both. Hubs are kept as rows that
    can spill, never as one array. Tables grow with the data, so none is broadcast.
    A ``stored`` table of edges is read as it is, and left.
    """
    now = edges if hasattr(edges, "_stored_at") else stored(edges.select("a", "b"), name)
    own = None if now is edges else now
    now = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    by_node = Window.partitionBy("u").orderBy("v", "moved")
    while True:
        # a node's smaller neighbours take the larger ones over; edges point from larger to smaller nodes
        least = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        large = now.select("u", "v").join(least.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        placed = large.select("u", "v", "moved", F.row_number().over(by_node).alias("nth"), F.first("v").over(by_node.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("m"))
        hooked = F.col("v") != F.col("m")
        small = placed.where((F.col("nth") == 1) | hooked).select(F.when(hooked, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"), (hooked | F.col("moved")).alias("moved"))
        now = stored(small, name)
        if own is not None:
            forget(own)  # garbage of past rounds would widen the driver's heap
        own = now
        # without a move every node had one smaller neighbour left, which had none
        if now.where("moved").isEmpty():
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            out._stored_at = now._stored_at
            return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; root is the smallest node of its component."""
    below = stars(edges, name)
    return below.union(below.select(F.col("root").alias("node"), "root").distinct())

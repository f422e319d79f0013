"""Feature sinks, archive compaction, table registration and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_yearly(df: DataFrame, path: str, day: str, order: Sequence[str], partitions: int | None = None) -> None:
    """Parquet by year of the local day, ordered inside each file (no global sort)."""
    dated = df.withColumn("year", F.year(day))
    spread = dated.repartition(partitions, "year", day) if partitions else dated.repartition("year", day)
    spread.sortWithinPartitions("year", *order).write.mode("overwrite").partitionBy("year").parquet(path)


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def save_table(df: DataFrame, name: str, buckets: int | None = None, keys: Sequence[str] = (), order: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Table in the session's catalogue, managed or below ``path``; read back, so plans see its buckets.

    Bucketing on a key lets later joins and windows on it skip the shuffle. Each
    bucket is one file, sorted by ``keys`` and ``order``.
    """
    writer = (df.repartition(buckets, *keys) if buckets else df).write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, *keys).sortBy(*keys, *order)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_clock_table(df: DataFrame, name: str, keys: Sequence[str], ts: str, buckets: int, path: str | None = None) -> DataFrame:
    """Hourly series bucketed by key and clock hour: lags of whole days stay within a bucket."""
    return save_table(df.withColumn("clock_hour", F.hour(ts)), name, buckets, [*keys, "clock_hour"], [ts], path)


def compact_archive(rows: DataFrame, path: str, keys: Sequence[str] = ("run_init_utc", "valid_time_utc")) -> None:
    """Write an archive by run date; duplicate run/valid rows fail the write."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in rows.columns if c not in keys])).alias("_r"))
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate run / valid-time rows")))
    unique = counted.filter(single).select(*keys, "_r.*").withColumn("run_date", F.to_date("run_init_utc"))
    unique.repartition("run_date").sortWithinPartitions("run_date", *keys).write.mode("overwrite").partitionBy("run_date").parquet(path)


def requested_runs(start: str, end: str, run_hours: Sequence[int], spark) -> DataFrame:
    """Every requested run between two dates (inclusive)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("_d"))
    hour = F.explode(F.array(*[F.lit(h) for h in run_hours]))
    return days.withColumn("_h", hour).select((F.col("_d").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("_h"))).alias("run_init_utc"))


def month_windows(start: str, end: str, spark) -> DataFrame:
    """Calendar-month windows clipped to ``[start, end]``."""
    first = F.trunc(F.lit(start).cast("date"), "month")
    months = spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    return months.select(
        F.greatest("m", F.lit(start).cast("date")).alias("window_start"),
        F.least(F.last_day("m"), F.lit(end).cast("date")).alias("window_end"),
    )

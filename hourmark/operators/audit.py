"""Source and archive audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_audit(df: DataFrame, ts: str, columns: Sequence[str]) -> DataFrame:
    """Rows, first and last stamp, duplicate stamps and missing values per column."""
    stamps = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns])
    wide = stamps.agg(
        F.sum("_n").alias("rows"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
        F.sum(F.col("_n") - 1).alias("duplicate_stamps"), *[F.sum(f"_{c}").alias(f"missing_{c}") for c in columns],
    )
    pairs = ", ".join(f"'{c}', missing_{c}" for c in columns)
    return wide.selectExpr(
        "rows", "first_time", "last_time", "duplicate_stamps", f"stack({len(columns)}, {pairs}) as (column_name, missing)"
    )


def zero_days(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Series days whose maximum is exactly zero."""
    return df.groupBy(*keys, day).agg(F.max(value).alias("_m")).filter(F.col("_m") == 0).select(*keys, day)


def shared_zero_days(zeros: DataFrame, day: str, at_least: int = 2) -> DataFrame:
    return zeros.groupBy(day).agg(F.count(F.lit(1)).alias("profiles")).filter(F.col("profiles") >= at_least)


def monthly_coverage(df: DataFrame, source: str, ts: str, sources: Sequence[str]) -> DataFrame:
    """Rows per month and source as columns, on a full month spine."""
    month = F.trunc(F.to_date(ts), "month")
    counts = df.groupBy(month.alias("month")).agg(
        *[F.count_if(F.col(source) == s).alias(f"rows_{s}") for s in sources]
    )
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return spine.join(counts, "month", "left").na.fill(0)


def step_histogram(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Histogram of steps between consecutive distinct stamps of a series.

    The lag runs inside (series, hour); an hour's first stamp takes the last
    stamp of an earlier hour from a window with one row per hour, so a busy
    series is spread over its hours.
    """
    rows = df.select(*keys, F.col(ts).alias("_t")).distinct().withColumn("_h", F.date_trunc("hour", "_t"))
    inside = rows.withColumn("_p", F.lag("_t").over(Window.partitionBy(*keys, "_h").orderBy("_t")))
    ends = rows.groupBy(*keys, "_h").agg(F.max("_t").alias("_end"))
    edges = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_h"))).drop("_end")
    stepped = inside.join(edges, [*keys, "_h"]).withColumn(
        "step_seconds", F.unix_timestamp("_t") - F.unix_timestamp(F.coalesce("_p", "_before"))
    )
    return stepped.filter(F.col("step_seconds").isNotNull()).groupBy(*keys, "step_seconds").agg(F.count(F.lit(1)).alias("rows"))


def location_quality(df: DataFrame, location: str, day: str, variables: Sequence[str], usable: str) -> DataFrame:
    """Per location: rows, missing values, availability rate and complete-day bounds."""
    missing = [F.count_if(F.col(v).isNull()).alias(f"missing_{v}") for v in variables]
    daily = df.groupBy(location, day).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(usable)).alias("_ok"), F.bool_and(F.col(usable)).alias("_all"), *missing
    )
    return daily.groupBy(location).agg(
        F.sum("_n").alias("rows"), *[F.sum(f"missing_{v}").alias(f"missing_{v}") for v in variables],
        (F.sum("_ok") / F.sum("_n")).alias("availability_rate"), F.count_if("_all").alias("complete_days"),
        F.min(F.when(F.col("_all"), F.col(day))).alias("first_complete_day"), F.max(F.when(F.col("_all"), F.col(day))).alias("last_complete_day"),
    )


def archive_metadata(df: DataFrame, run: str, location: str, variables: Sequence[str]) -> DataFrame:
    """Rows, distinct runs and locations, null counts per variable.

    Aggregated per (run, location) first, so the distinct counts run on few rows.
    """
    pre = df.groupBy(run, location).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(v).isNull()).alias(f"_{v}") for v in variables]
    )
    return pre.agg(
        F.sum("_n").alias("rows"), F.count_distinct(run).alias("runs"), F.count_distinct(location).alias("locations"),
        *[F.sum(f"_{v}").alias(f"null_{v}") for v in variables],
    )


def common_stamps(frames: Sequence[DataFrame], ts: str) -> DataFrame:
    """Stamps present in every source: count and bounds."""
    out = frames[0].select(ts)
    for other in frames[1:]:
        out = out.intersect(other.select(ts))
    return out.distinct().agg(F.count(F.lit(1)).alias("common"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"))


def file_manifest(spark: SparkSession, folder: str, ts: str, groups: int = 64) -> DataFrame:
    """One row per Parquet file below ``folder``: size, time of change, SHA-256, rows and time bounds.

    Bytes are hashed where they lie; rows and bounds are counted per file from the
    one column ``ts``. ``part`` deals the files to the groups of the tree above.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    stored = files.select(F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    counted = spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = stored.withColumn("path", plain("path")).join(counted.withColumn("path", plain("path")), "path", "left")
    return both.withColumns({"rows": F.coalesce("rows", F.lit(0)), "part": F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int")})


def manifest_tree(files: DataFrame) -> DataFrame:
    """Digests of the groups of a file manifest, and of all groups as part -1.

    A group's digest covers its files by path, the top one the groups by number:
    equal tops mean equal files, and unequal groups say where to look. Groups
    hold a share of the files; their number is fixed, so the top stays small.
    """
    line = F.concat_ws(" ", "path", "sha256", F.col("rows").cast("string"))
    groups = files.groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda g: g["digest"]), "\n")
    top = groups.agg(F.lit(-1).alias("part"), F.sum("files").alias("files"), F.sum("rows").alias("rows"), F.sha2(joined, 256).alias("digest"))
    return groups.unionByName(top)


def changed_files(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """``(path, change)`` of files that were altered, added or removed since the manifest.

    The listing alone settles files whose size and time of change are as recorded;
    only the others are read and hashed.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    listed = found.select(F.col("path").alias("_where"), plain("path").alias("path"), F.col("length"), F.col("modificationTime"))
    both = listed.join(known.select("path", "bytes", "modified", "sha256"), "path", "full_outer")
    touched = both.filter(F.col("_where").isNotNull() & F.col("bytes").isNotNull() & ((F.col("length") != F.col("bytes")) | (F.col("modificationTime") != F.col("modified"))))
    suspects = [r["_where"] for r in touched.select("_where").collect()]  # paths of touched files only
    gone = both.filter(F.col("_where").isNull()).select("path", F.lit("removed").alias("change"))
    new = both.filter(F.col("bytes").isNull()).select("path", F.lit("added").alias("change"))
    out = gone.unionByName(new)
    if suspects:
        again = spark.read.format("binaryFile").load(suspects).select(plain("path").alias("path"), F.sha2("content", 256).alias("now"))
        altered = again.join(known.select("path", "sha256"), "path").filter("now <> sha256")
        out = out.unionByName(altered.select("path", F.lit("altered").alias("change")))
    return out


def manifest(df: DataFrame, ts: str, name: str) -> DataFrame:
    """Lineage row: rows, columns, time bounds and an order-free content hash."""
    columns = sorted(df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"),
        # a sum, not an exclusive or: a pair of equal rows must not cancel
        F.pmod(F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")), F.lit(1 << 62).cast("decimal(38,0)")).cast("bigint").alias("content_hash"),
    ).select(F.lit(name).alias("dataset"), F.lit(len(columns)).alias("columns"), "rows", "first_time", "last_time", "content_hash")

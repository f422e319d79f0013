"""Provider JSON payloads to rows. Nested arrays are zipped and inlined in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourmark.sources.readers import parse_utc


def hourly_schema(variables: Sequence[str], suffixes: Sequence[str] = ("",)) -> T.StructType:
    doubles = [T.StructField(v + s, T.ArrayType(T.DoubleType())) for v in variables for s in suffixes]
    return T.StructType([T.StructField("hourly", T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *doubles]))])


def run_record_schema(variables: Sequence[str], multi: bool = False) -> T.StructType:
    response: T.DataType = hourly_schema(variables)
    fields = [T.StructField(n, T.StringType()) for n in ("run_init_utc", "available_at_utc", "status")]
    if multi:
        location = T.StructType([T.StructField("location_id", T.StringType())])
        fields.append(T.StructField("locations", T.ArrayType(location)))
        response = T.ArrayType(response)
    return T.StructType([*fields, T.StructField("response", response)])


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file, schema declared."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _hours(hourly: Column, variables: Sequence[str], rename: Mapping[str, str]) -> Column:
    """Zip the parallel arrays; a series of the wrong length fails the query."""
    n = F.size(hourly["time"])
    aligned = F.lit(True)
    for v in variables:
        aligned = aligned & (F.size(hourly[v]) == n)
    zipped = F.arrays_zip(hourly["time"].alias("time"), *[hourly[v].alias(rename[v]) for v in variables])
    return F.when(F.coalesce(aligned, F.lit(False)) & (n > 0), zipped).otherwise(
        F.raise_error(F.lit("hourly arrays are missing or not aligned to the time axis"))
    )


def run_rows(records: DataFrame, variables: Sequence[str], prefix: str = "weather_forecast_", keep: Sequence[str] = ()) -> DataFrame:
    """Archive records of one location each to one row per run and valid hour; ``keep`` names columns to carry along."""
    rename = {v: prefix + v for v in variables}
    available = records.filter(F.coalesce("status", F.lit("available")) == "available")
    rows = available.select(*keep, "run_init_utc", "available_at_utc", F.inline(_hours(F.col("response.hourly"), variables, rename)))
    return rows.select(
        *keep, parse_utc(F.col("run_init_utc")).alias("run_init_utc"), parse_utc(F.col("available_at_utc")).alias("available_at_utc"),
        parse_utc(F.col("time")).alias("valid_time_utc"), *rename.values(),
    )


def multi_location_rows(records: DataFrame, variables: Sequence[str], prefix: str = "weather_forecast_") -> DataFrame:
    """Requested locations zipped with their responses, then hours."""
    rename = {v: prefix + v for v in variables}
    available = records.filter(F.coalesce("status", F.lit("available")) == "available")
    same = F.size("locations") == F.size("response")
    zipped = F.when(same, F.arrays_zip(F.col("locations").alias("l"), F.col("response").alias("r"))).otherwise(
        F.raise_error(F.lit("responses do not match the requested locations"))
    )
    per_location = available.select("run_init_utc", "available_at_utc", F.inline(zipped))
    rows = per_location.select(
        "run_init_utc", "available_at_utc", F.col("l.location_id").alias("location_id"), F.inline(_hours(F.col("r.hourly"), variables, rename))
    )
    return rows.select(
        parse_utc(F.col("run_init_utc")).alias("run_init_utc"), parse_utc(F.col("available_at_utc")).alias("available_at_utc"),
        "location_id", parse_utc(F.col("time")).alias("valid_time_utc"), *rename.values(),
    )


def lead_rows(responses: DataFrame, variables: Sequence[str], leads: Mapping[str, int], location: str | None = None) -> DataFrame:
    """Monthly fixed-lead payload: ``{variable}{suffix}`` arrays to ``fcst{lead}_*`` columns with availability."""
    names = {v + s: f"weather_fcst{lead}_{v}" for s, lead in leads.items() for v in variables}
    keep = [location] if location else []
    rows = responses.select(*keep, F.inline(_hours(F.col("hourly"), list(names), names)))
    ts = parse_utc(F.col("time"))
    return rows.select(
        *keep, ts.alias("valid_time_utc"), *names.values(),
        *[(ts - F.make_dt_interval(F.lit(0), F.lit(h))).alias(f"weather_fcst{h}_available_at_utc") for h in leads.values()],
    )


def epoch_price_rows(responses: DataFrame, axis: str = "unix_seconds", price: str = "price", out: str = "day_ahead_price_eur_per_mwh") -> DataFrame:
    """Parallel epoch-second and price arrays to rows."""
    rows = responses.select(F.inline(F.arrays_zip(F.col(axis).alias("t"), F.col(price).alias(out))))
    return rows.select(F.timestamp_seconds("t").alias("valid_time_utc"), out)


SERIES_SCHEMA = T.StructType(
    [
        T.StructField("xAxisValues", T.ArrayType(T.LongType())),
        T.StructField("name", T.ArrayType(T.StructType([T.StructField("en", T.StringType())]))),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ]
)


def series_rows(items: DataFrame, names: Mapping[str, str], payload: Sequence[str] = ()) -> DataFrame:
    """Series objects sharing one epoch-millisecond axis to one wide row per stamp.

    ``items`` has one row per series, in payload order with the axis on the
    first (``position`` 0); ``payload`` identifies the document. Series are
    found by their English name; a missing one fails the query.
    """
    keys = list(payload)
    axis = items.filter(F.col("position") == 0).select(*keys, F.col("xAxisValues").alias("_axis"))
    wanted = items.withColumn("_name", F.col("name")[0]["en"]).filter(F.col("_name").isin(list(names)))
    joined = wanted.join(axis, keys) if keys else wanted.withColumn("_axis", axis.scalar())
    aligned = F.when(F.size("data") == F.size("_axis"), F.arrays_zip(F.col("_axis").alias("t"), F.col("data").alias("v"))).otherwise(
        F.raise_error(F.lit("a series is not aligned to the time axis"))
    )
    rows = joined.select(*keys, "_name", F.inline(aligned))
    wide = rows.groupBy(*keys, F.timestamp_millis("t").alias("valid_time_utc")).agg(
        F.count_distinct("_name").alias("_n"), *[F.max(F.when(F.col("_name") == n, F.col("v"))).alias(c) for n, c in names.items()]
    )
    complete = F.when(F.col("_n") == len(names), F.lit(True)).otherwise(F.raise_error(F.lit("payload lacks a required series")))
    return wide.filter(complete).drop("_n")

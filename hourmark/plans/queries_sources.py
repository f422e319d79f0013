"""Queries for scans, sources and sinks (A-*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourmark.functions.calendar import hours
from hourmark.operators import audit, contracts, features
from hourmark.operators.pointintime import run_schedule
from hourmark.plans import series as S
from hourmark.plans.catalog import query
from hourmark.sources import payloads, readers, sinks


@query(
    "a01_csv_scan", "o_orderkey:i valid_time_utc:t o_totalprice:f",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE valid_time_utc END AS valid_time_utc, o_totalprice FROM order_clock",
)
def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV written and read back with a declared schema; bad stamps become null."""
    out = S.scratch(spark)
    text = F.date_format("valid_time_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = S.order_clock(spark, path).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "not a time").otherwise(text).alias("valid_time_utc"), "o_totalprice"
    )
    sinks.write_csv_gz(rows, out)
    schema = T.StructType().add("o_orderkey", "long").add("valid_time_utc", "string").add("o_totalprice", "double")
    return readers.read_csv(spark, out, schema, ["valid_time_utc"])


@query("a02_parquet_scan", "event_id:i ts:t value:f", "SELECT event_id, ts, value FROM events")
def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan with zone-less stamps normalised to instants."""
    return readers.read_table(spark, f"{path}/events.parquet").select("event_id", "ts", "value")


@query("a03_projected_scan", "site_id:s rows:i value:f", "SELECT event_type AS site_id, count(*) AS rows, avg(value) AS value FROM events GROUP BY 1")
def projected_scan(spark: SparkSession, path: str) -> DataFrame:
    """Only the two named columns reach the scan."""
    rows = readers.read_table(spark, f"{path}/events.parquet", ["event_type", "value"])
    return rows.groupBy(F.col("event_type").alias("site_id")).agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("value"))


def _iso(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _hour_arrays(fields: dict[str, F.Column]) -> F.Column:
    """Aggregated hours of one document as parallel arrays (a document holds at most days of hours)."""
    items = F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return F.struct(*[items[n].alias(n) for n in fields])


@query(
    "a04_run_archive_json", "location_id:s run_init_utc:t available_at_utc:t valid_time_utc:t forecast_value:f",
    "SELECT location_id, run_init_utc, available_at_utc, valid_time_utc, forecast AS forecast_value FROM forecast_archive"
    " WHERE hour(run_init_utc) <> 18",
)
def run_archive_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per location and run, unavailable runs skipped, hours inlined."""
    out = S.scratch(spark)
    runs = S.forecast_archive(spark, path).groupBy("location_id", "run_init_utc", "available_at_utc").agg(
        _hour_arrays({"time": _iso("valid_time_utc"), "value": F.col("forecast")}).alias("hourly")
    )
    runs.select(
        "location_id", _iso("run_init_utc").alias("run_init_utc"), _iso("available_at_utc").alias("available_at_utc"),
        F.when(F.hour("run_init_utc") == 18, "unavailable").otherwise("available").alias("status"),
        F.struct("hourly").alias("response"),
    ).write.json(out)
    records = spark.read.schema(payloads.run_record_schema(["value"]).add("location_id", "string")).json(out)
    return payloads.run_rows(records, ["value"], prefix="forecast_", keep=["location_id"])


@query(
    "a05_multi_location_json", "location_id:s run_init_utc:t available_at_utc:t valid_time_utc:t forecast_value:f",
    "SELECT location_id, run_init_utc, available_at_utc, valid_time_utc, forecast AS forecast_value FROM forecast_archive",
)
def multi_location_json(spark: SparkSession, path: str) -> DataFrame:
    """One record per run with parallel location and response arrays."""
    out = S.scratch(spark)
    per_location = S.forecast_archive(spark, path).groupBy("run_init_utc", "available_at_utc", "location_id").agg(
        _hour_arrays({"time": _iso("valid_time_utc"), "value": F.col("forecast")}).alias("hourly")
    )
    docs = per_location.groupBy("run_init_utc", "available_at_utc").agg(
        F.array_sort(F.collect_list(F.struct("location_id", F.struct("hourly").alias("r")))).alias("_l")
    )
    docs.select(
        _iso("run_init_utc").alias("run_init_utc"), _iso("available_at_utc").alias("available_at_utc"),
        F.transform("_l", lambda x: F.struct(x["location_id"].alias("location_id"))).alias("locations"), F.col("_l.r").alias("response"),
    ).write.json(out)
    records = spark.read.schema(payloads.run_record_schema(["value"], multi=True)).json(out)
    return payloads.multi_location_rows(records, ["value"], prefix="forecast_")


@query(
    "a06_series_payload", "valid_time_utc:t da_price:f id_price:f",
    "SELECT valid_time_utc, da_price, id_price FROM market",
)
def series_payload(spark: SparkSession, path: str) -> DataFrame:
    """Named series over one epoch-millisecond axis per day document, pivoted by name."""
    hourly = S.market(spark, path)
    items = F.array_sort(F.collect_list(F.struct((F.unix_millis("valid_time_utc")).alias("t"), "da_price", "id_price", "pv_kwh")))
    docs = hourly.groupBy("delivery_date_local").agg(items.alias("_i"))
    named = lambda text: F.array(F.struct(F.lit(text).alias("en")))
    series = F.array(
        *[
            F.struct(F.lit(p).alias("position"), named(label).alias("name"), F.col(f"_i.{c}").alias("data"), (F.col("_i.t") if p == 0 else F.lit(None)).alias("xAxisValues"))
            for p, (label, c) in enumerate([("Solar", "pv_kwh"), ("Day Ahead Auction", "da_price"), ("Intraday Continuous", "id_price")])
        ]
    )
    rows = docs.select("delivery_date_local", F.inline(series))
    names = {"Day Ahead Auction": "da_price", "Intraday Continuous": "id_price"}
    return payloads.series_rows(rows, names, ["delivery_date_local"])


@query(
    "a07_fixed_lead_payload", "location_id:s valid_time_utc:t fcst24:f fcst48:f fcst24_available_at:t fcst48_available_at:t",
    "SELECT site_id AS location_id, valid_time_utc, value AS fcst24, value + 1 AS fcst48, valid_time_utc - INTERVAL 24 HOUR AS fcst24_available_at,"
    " valid_time_utc - INTERVAL 48 HOUR AS fcst48_available_at FROM site_hours",
)
def fixed_lead_payload(spark: SparkSession, path: str) -> DataFrame:
    """Daily documents with ``_previous_day1/2`` arrays to per-lead columns."""
    out = S.scratch(spark)
    docs = S.site_hours(spark, path).groupBy(F.col("site_id").alias("location_id"), F.to_date("valid_time_utc").alias("day")).agg(
        _hour_arrays({"time": _iso("valid_time_utc"), "value_previous_day1": F.col("value"), "value_previous_day2": F.col("value") + 1}).alias("hourly")
    )
    docs.drop("day").write.json(out)
    schema = T.StructType([T.StructField("location_id", T.StringType()), *payloads.hourly_schema(["value"], ["_previous_day1", "_previous_day2"]).fields])
    rows = payloads.lead_rows(spark.read.schema(schema).json(out), ["value"], {"_previous_day1": 24, "_previous_day2": 48}, "location_id")
    return rows.select(
        "location_id", "valid_time_utc", F.col("weather_fcst24_value").alias("fcst24"), F.col("weather_fcst48_value").alias("fcst48"),
        F.col("weather_fcst24_available_at_utc").alias("fcst24_available_at"), F.col("weather_fcst48_available_at_utc").alias("fcst48_available_at"),
    )


@query("a08_epoch_price_payload", "valid_time_utc:t price:f", "SELECT valid_time_utc, da_price AS price FROM market WHERE da_price IS NOT NULL")
def epoch_price_payload(spark: SparkSession, path: str) -> DataFrame:
    """Directory of documents with parallel epoch-second and price arrays."""
    out = S.scratch(spark)
    hourly = S.market(spark, path).filter(F.col("da_price").isNotNull())
    items = F.array_sort(F.collect_list(F.struct(F.unix_seconds("valid_time_utc").alias("unix_seconds"), F.col("da_price").alias("price"))))
    hourly.groupBy("delivery_date_local").agg(items.alias("_i")).select(
        F.col("_i.unix_seconds").alias("unix_seconds"), F.col("_i.price").alias("price")
    ).write.json(out)
    docs = spark.read.schema("unix_seconds array<long>, price array<double>").json(out)
    return payloads.epoch_price_rows(docs, out="price")


@query(
    "a09_archive_compaction", "run_date:d rows:i locations:i value:f",
    "SELECT CAST(run_init_utc AS DATE) AS run_date, count(*) AS rows, count(DISTINCT location_id) AS locations, avg(forecast) AS value FROM forecast_archive GROUP BY 1",
)
def archive_compaction(spark: SparkSession, path: str) -> DataFrame:
    """Unique run/location/valid rows written by run date and read back."""
    out = S.scratch(spark)
    sinks.compact_archive(S.forecast_archive(spark, path), out, ("run_init_utc", "location_id", "valid_time_utc"))
    return spark.read.parquet(out).groupBy("run_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("location_id").alias("locations"), F.avg("forecast").alias("value")
    )


@query(
    "a10_missing_runs", "run_init_utc:t available_at_utc:t status:s",
    """SELECT run_init_utc, run_init_utc + INTERVAL 6 HOUR AS available_at_utc,
         CASE WHEN run_init_utc IN (SELECT date_trunc('hour', ts) FROM events) THEN 'cached' ELSE 'missing' END AS status
       FROM (SELECT d + to_hours(h) AS run_init_utc FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events),
             (VALUES (0), (6), (12), (18)) AS r(h))""",
)
def missing_runs(spark: SparkSession, path: str) -> DataFrame:
    """Requested six-hourly runs; a run is cached when its hour has readings."""
    hourly = S.settle(S.pooled_hours(spark, path).select("valid_time_utc"))
    bounds = hourly.agg(F.to_date(F.min("valid_time_utc")).alias("a"), F.to_date(F.max("valid_time_utc")).alias("b"))
    schedule = run_schedule(bounds.select(F.explode(F.sequence("a", "b")).alias("day")), "day", (0, 6, 12, 18))
    cached = hourly.withColumnRenamed("valid_time_utc", "run_init_utc")
    found = schedule.join(cached, "run_init_utc", "left_semi").withColumn("status", F.lit("cached"))
    return found.unionByName(schedule.join(cached, "run_init_utc", "left_anti").withColumn("status", F.lit("missing")))


@query(
    "a10_run_status_counts", "window_start:d window_end:d status:s runs:i",
    """WITH b AS (SELECT min(ts)::DATE + 4 AS first, max(ts)::DATE + 11 AS last FROM events), s AS (SELECT d + to_hours(h) AS run, first, last FROM (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS d, first, last FROM b), (VALUES (0), (12)) AS r(h)),
       c AS (SELECT run, first, last, CASE WHEN run IN (SELECT date_trunc('hour', ts) FROM events) THEN 'cached' ELSE 'missing' END AS status FROM s)
       SELECT greatest(date_trunc('month', run)::DATE, first) AS window_start, least(last_day(run::DATE), last) AS window_end, status, count(*) AS runs
       FROM c GROUP BY ALL""",
)
def run_status_counts(spark: SparkSession, path: str) -> DataFrame:
    """Requested runs per calendar-month window and status, from the fifth day of the readings to eleven days after the last."""
    hourly = S.settle(S.pooled_hours(spark, path).select("valid_time_utc"))
    bounds = hourly.agg(F.date_add(F.to_date(F.min("valid_time_utc")), 4).cast("string"), F.date_add(F.to_date(F.max("valid_time_utc")), 11).cast("string")).first()
    requested = sinks.requested_runs(bounds[0], bounds[1], (0, 12), spark)
    have = hourly.select(F.col("valid_time_utc").alias("run_init_utc"), F.lit("cached").alias("status"))
    labelled = requested.join(have, "run_init_utc", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    windows = sinks.month_windows(bounds[0], bounds[1], spark).withColumn("month", F.trunc("window_start", "month"))
    monthly = labelled.withColumn("month", F.trunc(F.to_date("run_init_utc"), "month")).join(windows, "month")
    return monthly.groupBy("window_start", "window_end", "status").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "a11_range_clip", "valid_time_utc:t available_at_utc:t value:f",
    "SELECT valid_time_utc, valid_time_utc - INTERVAL 24 HOUR AS available_at_utc, value FROM pooled_hours WHERE valid_time_utc BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20 12:00:00'",
)
def range_clip(spark: SparkSession, path: str) -> DataFrame:
    """Clip to a window (pushed to the scan as raw-stamp bounds) and derive availability."""
    raw = S.readings(spark, path).filter((F.col("ts") >= "2024-01-03") & (F.col("ts") < "2024-01-20 13:00:00"))
    hourly = raw.groupBy(F.date_trunc("hour", "ts").alias("valid_time_utc")).agg(F.avg("value").alias("value"))
    return hourly.withColumn("available_at_utc", F.col("valid_time_utc") - hours(24))


@query(
    "a12_parquet_sink", "year:i rows:i o_totalprice:f",
    "SELECT year(CAST(valid_time_utc AS DATE)) AS year, count(*) AS rows, avg(o_totalprice) AS o_totalprice FROM order_clock GROUP BY 1",
)
def parquet_sink(spark: SparkSession, path: str) -> DataFrame:
    """Year-partitioned Parquet written, then read back by partition."""
    out = S.scratch(spark)
    sinks.write_yearly(S.order_clock(spark, path).withColumn("day", F.to_date("valid_time_utc")), out, "day", ["day", "o_orderkey"])
    return spark.read.parquet(out).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.avg("o_totalprice").alias("o_totalprice"))


@query("a13_csv_sink", "site_id:s valid_time_utc:t value:f", "SELECT site_id, valid_time_utc, value FROM site_hours")
def csv_sink(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV round trip of the hourly table."""
    out = S.scratch(spark)
    sinks.write_csv_gz(S.site_hours(spark, path).select("site_id", _iso("valid_time_utc").alias("valid_time_utc"), "value"), out)
    schema = T.StructType().add("site_id", "string").add("valid_time_utc", "string").add("value", "double")
    return readers.read_csv(spark, out, schema, ["valid_time_utc"])


@query("a14_sql_tables", "site_id:s hours:i peak:f", "SELECT site_id, count(*) AS hours, max(value) AS peak FROM site_hours GROUP BY 1")
def sql_tables(spark: SparkSession, path: str) -> DataFrame:
    """The hourly result registered as a SQL view and queried."""
    sinks.register(S.site_hours(spark, path), "hourmark_site_hours")
    return spark.sql("SELECT site_id, count(*) AS hours, max(value) AS peak FROM hourmark_site_hours GROUP BY site_id")


@query(
    "a14_bucketed_lags", "site_id:s valid_time_utc:t value:f value_lag_1d:f value_lag_7d:f value_lag_14d:f",
    "SELECT s.site_id, s.valid_time_utc, s.value, " + ", ".join(f"l{k}.value AS value_lag_{k}d" for k in (1, 7, 14)) + " FROM site_hours s "
    + " ".join(f"LEFT JOIN site_hours l{k} ON l{k}.site_id = s.site_id AND l{k}.valid_time_utc = s.valid_time_utc - INTERVAL {k} DAY" for k in (1, 7, 14)),
)
def bucketed_lags(spark: SparkSession, path: str) -> DataFrame:
    """The hourly series stored as a table bucketed by site and clock hour; its daily lags need no exchange."""
    name = f"hourmark_hours_{uuid.uuid4().hex}"
    stored = sinks.save_clock_table(S.site_hours(spark, path), name, ["site_id"], "valid_time_utc", 8, S.scratch(spark))
    return features.clock_lags(stored, ["site_id"], "valid_time_utc", ["value"], [1, 7, 14])


@query(
    "a15_file_manifest", "part:i files:i rows:i",
    "SELECT -1 AS part, count(DISTINCT CAST(valid_time_utc AS DATE)) AS files, count(*) AS rows FROM site_hours",
)
def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The hourly series written as a file per day; the top of its manifest tree counts every file and row."""
    out = S.scratch(spark)
    S.site_hours(spark, path).withColumn("day", F.to_date("valid_time_utc")).repartition("day").write.partitionBy("day").parquet(out)
    return audit.manifest_tree(audit.file_manifest(spark, out, "valid_time_utc")).filter("part = -1")


@query(
    "a15_manifest", "dataset:s columns:i rows:i first_time:t last_time:t",
    "SELECT 'site_hours' AS dataset, 4 AS columns, count(*) AS rows, min(valid_time_utc) AS first_time, max(valid_time_utc) AS last_time FROM site_hours",
)
def manifest(spark: SparkSession, path: str) -> DataFrame:
    return audit.manifest(S.site_hours(spark, path), "valid_time_utc", "site_hours")


@query(
    "a16_location_dimension", "location_id:s nation:s region:s customers:i",
    """SELECT 'loc_' || n_nationkey AS location_id, n_name AS nation, r_name AS region, count(*) AS customers
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def location_dimension(spark: SparkSession, path: str) -> DataFrame:
    """Checked location dimension joined to counts aggregated before the join."""
    dim = S.table(spark, path, "nation").join(S.table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat(F.lit("loc_"), "n_nationkey").alias("location_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
    counts = S.table(spark, path, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return counts.join(dim, F.col("c_nationkey") == F.col("n_nationkey"))


@query("a16_location_contract", "rule:s violations:i",
       "SELECT 'null_n_name' AS rule, count(*) FILTER (WHERE n_name IS NULL) AS violations FROM nation UNION ALL SELECT 'null_n_regionkey', count(*) FILTER (WHERE n_regionkey IS NULL) FROM nation"
       " UNION ALL SELECT 'duplicate_n_nationkey', count(*) FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)")
def location_contract(spark: SparkSession, path: str) -> DataFrame:
    nation = S.table(spark, path, "nation")
    return contracts.rule_counts(nation, contracts.null_rules(["n_name", "n_regionkey"])).unionByName(
        contracts.duplicate_count(nation, ["n_nationkey"])
    )

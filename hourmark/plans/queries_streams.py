"""Queries that drain a file stream of the event table (S-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.plans import series as S
from hourmark.plans.catalog import query
from hourmark.streaming import streams


def _events(spark: SparkSession, path: str) -> DataFrame:
    raw = streams.read_parquet_stream(spark, path, f"{path}/events.parquet", "events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    out = S.scratch(spark)
    streams.run_to_parquet(stream, f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows")


@query(
    "s01_hourly_stream", "site_id:s valid_time_utc:t power_mean_w:f intervals:i",
    "SELECT site_id, valid_time_utc, value AS power_mean_w, n AS intervals FROM site_hours WHERE valid_time_utc + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def hourly_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streamed hours equal the batch hours that the watermark has closed."""
    rows = _events(spark, path).select(F.col("event_type").alias("site_id"), "ts", "value")
    return _drain(spark, streams.hourly_stream(rows, ["site_id"], "ts", "value"))


@query("s02_deduplicated_stream", "event_id:i", "SELECT DISTINCT event_id FROM events")
def deduplicated_stream(spark: SparkSession, path: str) -> DataFrame:
    """A source delivered twice comes out once."""
    rows = _events(spark, path).select("event_id", "ts")
    return _drain(spark, streams.deduplicated_stream(rows.unionByName(_events(spark, path).select("event_id", "ts")), ["event_id"], "ts"))


@query(
    "s02_keep_last_stream", "event_id:i ts:t value:f",
    """WITH r AS (SELECT event_id, ts, value FROM events UNION ALL SELECT event_id, ts + INTERVAL 5 MINUTE, value + 1 FROM events WHERE event_id % 3 = 0)
      SELECT event_id, max(ts) AS ts, arg_max(value, ts) AS value FROM r GROUP BY event_id HAVING date_trunc('millisecond', max(ts)) + INTERVAL 1 HOUR < date_trunc('millisecond', (SELECT max(ts) FROM r)) - INTERVAL 1 HOUR""",
)
def keep_last_stream(spark: SparkSession, path: str) -> DataFrame:
    """A third of the records is corrected five minutes later; the correction comes out, once no newer one can come."""
    rows = _events(spark, path).select("event_id", "ts", "value")
    corrected = _events(spark, path).filter("event_id % 3 = 0").select("event_id", (F.col("ts") + F.expr("INTERVAL 5 MINUTE")).alias("ts"), (F.col("value") + 1).alias("value"))
    return _drain(spark, streams.keep_last_stream(rows.unionByName(corrected), ["event_id"], "ts"))


@query(
    "s03_joined_error_stream", "window_start:t rows:i mae:f",
    """SELECT date_trunc('day', ts) AS window_start, count(*) AS rows, avg(abs(event_id % 7 - 3)) AS mae FROM events
      GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 HOUR FROM events)""",
)
def joined_error_stream(spark: SparkSession, path: str) -> DataFrame:
    """Daily mean absolute error of two streams, actuals and forecasts issued half an hour before."""
    actuals = _events(spark, path).select("event_id", "ts", "value")
    forecasts = _events(spark, path).select("event_id", (F.col("ts") - F.expr("INTERVAL 30 MINUTE")).alias("issued"), (F.col("value") + F.col("event_id") % 7 - 3).alias("forecast"))
    return _drain(spark, streams.joined_error_stream(actuals, forecasts, ["event_id"], "ts", "issued", "value", "forecast"))


@query(
    "s03_error_stream", "window_start:t rows:i mae:f",
    """WITH p AS (SELECT event_type, hour(ts) AS h, avg(value) AS prediction FROM events GROUP BY ALL)
      SELECT date_trunc('day', ts) AS window_start, count(*) AS rows, avg(abs(value - prediction)) AS mae FROM events e JOIN p ON p.event_type = e.event_type AND p.h = hour(ts)
      GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def error_stream(spark: SparkSession, path: str) -> DataFrame:
    """Daily mean absolute error of streamed actuals against static hourly predictions."""
    predictions = S.settle(
        S.readings(spark, path).groupBy(F.col("site_id").alias("event_type"), F.hour("ts").alias("h")).agg(F.avg("value").alias("prediction"))
    )
    actuals = _events(spark, path).select("event_type", "ts", "value").withColumn("h", F.hour("ts"))
    return _drain(spark, streams.error_stream(actuals, predictions, ["event_type", "h"], "ts", "value", "prediction"))

"""Energy-style series derived from the event, order and line-item tables.

Every derivation is one scan with a map-side combined aggregation, so the work
grows with the raw table while the hourly result stays small. A series a query
reads more than once is settled to the checkpoint folder first, so the raw
scan runs once and a lost executor does not repeat it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions.calendar import hours, local_date, local_hour
from hourmark.operators.features import same_clock_history
from hourmark.params import LOCAL_TZ, QUANTILE_LEVELS, quantile_column
from hourmark.plans.catalog import sql_view
from hourmark.session import checkpoint_dir
from hourmark.sources.readers import read_table

SITES = ("click", "error", "purchase", "signup", "view")
PRICE_TYPES = ("purchase", "click", "error")
PV_TYPES = ("view", "signup", "click")
WORKING = tuple(range(6, 22))


def berlin(ts: str) -> str:
    """SQL: UTC stamp to Berlin wall clock."""
    return f"timezone('{LOCAL_TZ}', timezone('UTC', {ts}))"


def to_utc(local: str) -> str:
    """SQL: Berlin wall clock to UTC stamp."""
    return f"timezone('UTC', timezone('{LOCAL_TZ}', {local}))"


def settle(df: DataFrame) -> DataFrame:
    """Write a small reused series to the checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_day(df: DataFrame, day: str, share: tuple[int, int]) -> Column:
    """The day that lies ``share`` (a fraction) of the way from the first to the last one, as a scalar."""
    first, last = F.min(day), F.max(day)
    return df.agg(F.date_add(first, F.floor(F.datediff(last, first) * F.lit(share[0]) / F.lit(share[1])).cast("int")).alias("cut")).scalar()


def cut_day_sql(source: str, share: tuple[int, int], day: str = "delivery_date_local") -> str:
    return f"(SELECT min({day}) + CAST((max({day}) - min({day})) * {share[0]} // {share[1]} AS INTEGER) FROM {source})"


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder for written tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, path: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{path}/{name}.parquet", columns or None)


def readings(spark: SparkSession, path: str) -> DataFrame:
    """Sub-hourly readings: event type as site."""
    return table(spark, path, "events", "event_type", "ts", "value").withColumnRenamed("event_type", "site_id")


sql_view("readings", "SELECT event_type AS site_id, ts, value FROM events")


def site_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hourly mean per site."""
    return (
        readings(spark, path)
        .groupBy("site_id", F.date_trunc("hour", "ts").alias("valid_time_utc"))
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )


sql_view(
    "site_hours",
    "SELECT site_id, date_trunc('hour', ts) AS valid_time_utc, avg(value) AS value, count(*) AS n FROM readings GROUP BY ALL",
)


def pooled_hours(spark: SparkSession, path: str) -> DataFrame:
    return (
        readings(spark, path)
        .groupBy(F.date_trunc("hour", "ts").alias("valid_time_utc"))
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    )


sql_view("pooled_hours", "SELECT date_trunc('hour', ts) AS valid_time_utc, avg(value) AS value, count(*) AS n FROM readings GROUP BY 1")


def market(spark: SparkSession, path: str) -> DataFrame:
    """Hourly day-ahead price, intraday price, spread and PV energy on the local calendar."""
    hour = F.date_trunc("hour", "ts").alias("valid_time_utc")
    mean_of = lambda types: F.avg(F.when(F.col("site_id").isin(*types), F.col("value")))
    hourly = readings(spark, path).groupBy(hour).agg(
        (mean_of(PRICE_TYPES) - 40.0).alias("da_price"), (F.avg("value") - 40.0).alias("id_price"), mean_of(PV_TYPES).alias("_pv")
    )
    hourly = hourly.dropna(subset=["da_price", "_pv"])  # an hour without every price is a gap, not a null
    local = hourly.withColumns(
        {"delivery_date_local": local_date(F.col("valid_time_utc")), "hour_local": local_hour(F.col("valid_time_utc"))}
    )
    return local.withColumns(
        {
            "spread": F.col("id_price") - F.col("da_price"),
            "pv_kwh": F.when(F.col("hour_local").between(6, 21), F.col("_pv") / 10.0).otherwise(0.0),
        }
    ).drop("_pv")


sql_view(
    "market",
    f"""SELECT *, id_price - da_price AS spread, CASE WHEN hour_local BETWEEN 6 AND 21 THEN pv / 10.0 ELSE 0.0 END AS pv_kwh
    FROM (SELECT *, CAST({berlin('valid_time_utc')} AS DATE) AS delivery_date_local, hour({berlin('valid_time_utc')}) AS hour_local
      FROM (SELECT date_trunc('hour', ts) AS valid_time_utc,
              avg(value) FILTER (WHERE event_type IN ('purchase', 'click', 'error')) - 40.0 AS da_price,
              avg(value) - 40.0 AS id_price,
              avg(value) FILTER (WHERE event_type IN ('view', 'signup', 'click')) AS pv
            FROM events GROUP BY 1) WHERE da_price IS NOT NULL AND pv IS NOT NULL)""",
)

VALUES = ("da_price", "id_price", "spread", "pv_kwh")


def points(hourly: DataFrame) -> DataFrame:
    """Market rows beside their persistence forecast (same clock hour, day before)."""
    return same_clock_history(
        hourly, hourly, [], "delivery_date_local", "hour_local", VALUES, (1,), names="{value}_point"
    )


sql_view(
    "points",
    "SELECT m.*, p.da_price AS da_price_point, p.id_price AS id_price_point, p.spread AS spread_point, p.pv_kwh AS pv_kwh_point"
    " FROM market m JOIN market p ON p.delivery_date_local = m.delivery_date_local - 1 AND p.hour_local = m.hour_local",
)

Q_OFFSETS = (-30.0, -22.0, -15.0, -9.0, 0.0, 9.0, 15.0, 22.0, 30.0)
Q_COLUMNS = {quantile_column("price", level): level for level in QUANTILE_LEVELS}


def quantile_forecasts(pts: DataFrame) -> DataFrame:
    """Nine price quantiles around the point, wobbling enough to cross now and then."""
    day = F.dayofmonth("delivery_date_local")
    cols = {
        c: F.col("da_price_point") + off + ((F.col("hour_local") * 7 + i * 11 + day) % 13 - 6)
        for i, (c, off) in enumerate(zip(Q_COLUMNS, Q_OFFSETS, strict=True))
    }
    return pts.withColumns(cols)


sql_view(
    "quantile_forecasts",
    "SELECT *, "
    + ", ".join(
        f"da_price_point + ({off}) + ((hour_local * 7 + {i} * 11 + day(delivery_date_local)) % 13 - 6) AS {c}"
        for i, (c, off) in enumerate(zip(Q_COLUMNS, Q_OFFSETS, strict=True))
    )
    + " FROM points",
)


def residuals(pts: DataFrame) -> DataFrame:
    """Working-hour residual library of the three targets, keyed by source day."""
    rows = pts.filter(F.col("hour_local").between(6, 21))
    lib = rows.select(
        F.col("delivery_date_local").alias("source_day"), "hour_local",
        (F.col("pv_kwh") - F.col("pv_kwh_point")).alias("pv_residual"),
        (F.col("da_price") - F.col("da_price_point")).alias("price_residual"),
        (F.col("spread") - F.col("spread_point")).alias("spread_residual"),
    ).dropna()
    whole = lib.groupBy("source_day").agg(F.count_distinct("hour_local").alias("_n")).filter(F.col("_n") == 16)
    return lib.join(whole.select("source_day"), "source_day", "left_semi")


sql_view(
    "residuals_all",
    "SELECT delivery_date_local AS source_day, hour_local, pv_kwh - pv_kwh_point AS pv_residual,"
    " da_price - da_price_point AS price_residual, spread - spread_point AS spread_residual FROM points"
    " WHERE hour_local BETWEEN 6 AND 21 AND pv_kwh - pv_kwh_point IS NOT NULL AND da_price - da_price_point IS NOT NULL"
    " AND spread - spread_point IS NOT NULL",
)
sql_view(
    "residuals",
    "SELECT * FROM residuals_all WHERE source_day IN"
    " (SELECT source_day FROM residuals_all GROUP BY 1 HAVING count(DISTINCT hour_local) = 16)",
)


def forecast_archive(spark: SparkSession, path: str) -> DataFrame:
    """Six-hourly forecast runs per location, published six hours after their start."""
    hourly = site_hours(spark, path).select(
        F.col("site_id").alias("location_id"), (F.col("valid_time_utc") + hours(24)).alias("valid_time_utc"), "value"
    )
    rows = hourly.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    back = F.make_dt_interval(F.lit(0), (F.hour("valid_time_utc") % 6 + F.col("_k") * 6).cast("int"))
    rows = rows.withColumn("run_init_utc", F.col("valid_time_utc") - back)
    lead = F.timestamp_diff("HOUR", F.col("run_init_utc"), F.col("valid_time_utc"))
    return rows.select(
        "location_id", "run_init_utc", (F.col("run_init_utc") + hours(6)).alias("available_at_utc"), "valid_time_utc",
        (F.col("value") + ((F.hour("run_init_utc") + lead) % 7) * 0.1).alias("forecast"),
    )


sql_view(
    "forecast_archive",
    """SELECT location_id, run_init_utc, run_init_utc + INTERVAL 6 HOUR AS available_at_utc, valid_time_utc,
    value + ((hour(run_init_utc) + date_diff('hour', run_init_utc, valid_time_utc)) % 7) * 0.1 AS forecast
    FROM (SELECT location_id, valid_time_utc, value, valid_time_utc - to_hours(hour(valid_time_utc) % 6 + 6 * k) AS run_init_utc
      FROM (SELECT site_id AS location_id, valid_time_utc + INTERVAL 24 HOUR AS valid_time_utc, value FROM site_hours), range(8) AS r(k))""",
)


def layered_forecasts(hourly: DataFrame) -> DataFrame:
    """Market rows with 24 h and 48 h forecast layers; missing cells stay null."""
    from hourmark.operators.features import hour_lags

    out = hour_lags(hourly, [], "valid_time_utc", ["da_price", "pv_kwh"], [24, 48], names="f{lag}_{value}")
    # a layer loses one variable now and then, so completeness matters
    hole = lambda mod, at: (F.hour("valid_time_utc") + F.dayofmonth("valid_time_utc")) % mod == at
    out = out.withColumns(
        {
            "f24_pv_kwh": F.when(~hole(7, 3), F.col("f24_pv_kwh")), "f48_da_price": F.when(~hole(11, 5), F.col("f48_da_price")),
            "f24_available_at": F.col("valid_time_utc") - hours(24), "f48_available_at": F.col("valid_time_utc") - hours(48),
        }
    )
    return out


sql_view(
    "layered_forecasts",
    """SELECT m.*, a.da_price AS f24_da_price,
      CASE WHEN (hour(m.valid_time_utc) + day(m.valid_time_utc)) % 7 <> 3 THEN a.pv_kwh END AS f24_pv_kwh,
      CASE WHEN (hour(m.valid_time_utc) + day(m.valid_time_utc)) % 11 <> 5 THEN b.da_price END AS f48_da_price, b.pv_kwh AS f48_pv_kwh,
      m.valid_time_utc - INTERVAL 24 HOUR AS f24_available_at, m.valid_time_utc - INTERVAL 48 HOUR AS f48_available_at
    FROM market m LEFT JOIN market a ON a.valid_time_utc = m.valid_time_utc - INTERVAL 24 HOUR
    LEFT JOIN market b ON b.valid_time_utc = m.valid_time_utc - INTERVAL 48 HOUR""",
)


def order_clock(spark: SparkSession, path: str) -> DataFrame:
    """Orders as a multi-year hourly clock: day plus an hour derived from the key."""
    rows = table(spark, path, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    hour = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return rows.withColumn("valid_time_utc", F.col("o_orderdate") + hour)


sql_view("order_clock", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, o_orderdate + to_hours(o_orderkey % 24) AS valid_time_utc FROM orders")

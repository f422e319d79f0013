"""Whole feature tables on derived sources: canonical table, PV, price, intraday, multi-site, spatial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import features
from hourmark.plans import datasets as D
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_joins import _window_sql
from hourmark.plans.series import berlin, to_utc

VARS = ("temperature_2m", "shortwave_radiation")
OUTAGES = ("2024-01-10",)
SOURCES = {"actual": "error", "temperature_2m": "click", "shortwave_radiation": "signup"}

sql_view("src_pv", "SELECT ts AS valid_time_utc, value AS p1, value / 2 AS p2, CASE WHEN value > 300 THEN 'spike' ELSE 'usable' END AS pv_quality_status FROM events WHERE event_type = 'view'")
sql_view(
    "src_weather",
    "SELECT date_trunc('hour', ts) AS valid_time_utc, avg(value) FILTER (WHERE event_type = 'click') AS temperature_2m, avg(value) FILTER (WHERE event_type = 'signup') AS shortwave_radiation FROM events GROUP BY 1",
)
sql_view("src_prices", "SELECT valid_time_utc, da_price AS price FROM market UNION ALL SELECT valid_time_utc + INTERVAL 15 MINUTE, da_price FROM market WHERE delivery_date_local > DATE '2024-01-25'")


def sources(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """PV readings, actual weather, fixed-lead forecasts and prices derived from events."""
    pv = S.readings(spark, path).filter(F.col("site_id") == "view").select(
        F.col("ts").alias("valid_time_utc"), F.col("value").alias("p1"), (F.col("value") / 2.0).alias("p2"),
        F.when(F.col("value") > 300, "spike").otherwise("usable").alias("pv_quality_status"),
    )
    mean_of = lambda s: F.avg(F.when(F.col("site_id") == s, F.col("value")))
    weather = S.settle(
        S.readings(spark, path).groupBy(F.date_trunc("hour", "ts").alias("valid_time_utc")).agg(*[mean_of(SOURCES[v]).alias(v) for v in VARS])
    )
    layers = None
    for d in (1, 2):
        part = weather.select((F.col("valid_time_utc") + C.hours(24 * d)).alias("valid_time_utc"), *[F.col(v).alias(f"{v}_previous_day{d}") for v in VARS])
        layers = part if layers is None else layers.join(part, "valid_time_utc", "full_outer")
    hourly = S.market(spark, path).select("valid_time_utc", F.col("da_price").alias(D.DA_PRICE), "delivery_date_local")
    hourly = S.settle(hourly)
    quarter = hourly.filter(F.col("delivery_date_local") > "2024-01-25").withColumn("valid_time_utc", F.col("valid_time_utc") + F.expr("interval 15 minutes"))
    prices = hourly.unionByName(quarter).drop("delivery_date_local")
    return pv, weather, layers, prices


def canonical(spark: SparkSession, path: str) -> DataFrame:
    pv, weather, layers, prices = sources(spark, path)
    return D.canonical_hourly(pv, weather, layers, prices, "p1", VARS, OUTAGES)


_PUB = to_utc(f"(CAST({berlin('valid_time_utc')} AS DATE) - 1)::TIMESTAMP + INTERVAL 13 HOUR")
sql_view(
    "canonical",
    f"""SELECT *, CAST({berlin('valid_time_utc')} AS DATE) AS delivery_date_local, hour({berlin('valid_time_utc')}) AS hour_local,
      CASE WHEN CAST({berlin('valid_time_utc')} AS DATE) = DATE '2024-01-10' THEN 'suspected_source_outage' ELSE status END AS pv_quality_status FROM (
        SELECT valid_time_utc, a.temperature_2m AS a_t, a.shortwave_radiation AS a_s, f1.temperature_2m AS f24_t, f1.shortwave_radiation AS f24_s, f2.temperature_2m AS f48_t, f2.shortwave_radiation AS f48_s,
          p.price, p.price_at, v.pv, v.n AS pv_intervals, v.status
        FROM src_weather a FULL JOIN (SELECT * REPLACE (valid_time_utc + INTERVAL 24 HOUR AS valid_time_utc) FROM src_weather) f1 USING (valid_time_utc)
        FULL JOIN (SELECT * REPLACE (valid_time_utc + INTERVAL 48 HOUR AS valid_time_utc) FROM src_weather) f2 USING (valid_time_utc)
        FULL JOIN (SELECT valid_time_utc, price, {_PUB} AS price_at FROM (SELECT *, lag(valid_time_utc) OVER (ORDER BY valid_time_utc) AS pr FROM src_prices) WHERE pr IS NULL OR valid_time_utc - pr >= INTERVAL 1 HOUR) p USING (valid_time_utc)
        FULL JOIN (SELECT date_trunc('hour', valid_time_utc) AS valid_time_utc, avg(p1) AS pv, count(*) AS n, CASE WHEN bool_and(pv_quality_status = 'usable') THEN 'usable' ELSE 'excluded' END AS status FROM src_pv GROUP BY 1) v USING (valid_time_utc))""",
)
_ASOF = to_utc("(delivery_date_local - 1)::TIMESTAMP + INTERVAL 11 HOUR")
sql_view(
    "layered_canonical",
    f"""SELECT *, CASE WHEN u24 THEN 24 WHEN u48 THEN 48 END AS lead, CASE WHEN u24 THEN f24_t WHEN u48 THEN f48_t END AS f_t, CASE WHEN u24 THEN f24_s WHEN u48 THEN f48_s END AS f_s FROM
      (SELECT *, {_ASOF} AS as_of_utc, valid_time_utc - INTERVAL 24 HOUR <= {_ASOF} AND f24_t IS NOT NULL AND f24_s IS NOT NULL AS u24, valid_time_utc - INTERVAL 48 HOUR <= {_ASOF} AND f48_t IS NOT NULL AND f48_s IS NOT NULL AS u48 FROM canonical)""",
)


@query("dataset_canonical_hourly", "valid_time_utc:t delivery_date_local:d hour_local:i pv:f pv_intervals:i pv_quality_status:s price:f price_at:t actual:f fcst24:f fcst48:f",
       "SELECT *, a_t AS actual, f24_t AS fcst24, f48_s AS fcst48 FROM canonical")
def canonical_hourly(spark: SparkSession, path: str) -> DataFrame:
    """Four sources on one UTC hour axis with availability times."""
    return canonical(spark, path).withColumnsRenamed(
        {"pv_power_mean_w": "pv", D.DA_PRICE: "price", "day_ahead_price_available_at_utc": "price_at", "weather_actual_temperature_2m": "actual",
         "weather_fcst24_temperature_2m": "fcst24", "weather_fcst48_shortwave_radiation": "fcst48"}
    )


_PV_SPEC = "valid_time_utc:t as_of_utc:t horizon_hours:i week_index:i weather_t:f weather_s:f pv_power_mean_w:f"
sql_view("pv_rows", "SELECT *, dense_rank() OVER (ORDER BY date_trunc('week', " + berlin("valid_time_utc") + ")) - 1 AS week_index FROM layered_canonical WHERE year(delivery_date_local) = 2024 AND pv_quality_status = 'usable' AND pv IS NOT NULL AND f_t IS NOT NULL AND f_s IS NOT NULL")


@query("dataset_day_ahead_pv", _PV_SPEC + " lead:i",
       "SELECT *, date_diff('hour', as_of_utc, valid_time_utc) AS horizon_hours, f_t AS weather_t, f_s AS weather_s, pv AS pv_power_mean_w FROM pv_rows")
def day_ahead_pv(spark: SparkSession, path: str) -> DataFrame:
    rows = D.day_ahead_pv(S.settle(canonical(spark, path)), 2024, VARS)
    return rows.withColumnsRenamed({"weather_forecast_temperature_2m": "weather_t", "weather_forecast_shortwave_radiation": "weather_s", "weather_forecast_lead_hours": "lead"})


@query("dataset_oracle_pv", _PV_SPEC,
       "SELECT *, date_diff('hour', as_of_utc, valid_time_utc) AS horizon_hours, a_t AS weather_t, a_s AS weather_s, pv AS pv_power_mean_w FROM pv_rows WHERE a_t IS NOT NULL AND a_s IS NOT NULL")
def oracle_pv(spark: SparkSession, path: str) -> DataFrame:
    table = S.settle(canonical(spark, path))
    rows = D.oracle_pv(table, D.day_ahead_pv(table, 2024, VARS), VARS)
    return rows.withColumnsRenamed({"weather_actual_temperature_2m": "weather_t", "weather_actual_shortwave_radiation": "weather_s"})


@query(
    "dataset_day_ahead_price", "valid_time_utc:t as_of_utc:t lead:i price_lag_24h:f price_lag_168h:f price_lag_336h:f price_same_hour_4w_mean:f price:f",
    """SELECT c.valid_time_utc, c.as_of_utc, c.lead, a.price AS price_lag_24h, b.price AS price_lag_168h, d.price AS price_lag_336h, list_avg([b.price, d.price, e.price, g.price]) AS price_same_hour_4w_mean, c.price
      FROM layered_canonical c JOIN canonical a ON a.valid_time_utc = c.valid_time_utc - INTERVAL 24 HOUR JOIN canonical b ON b.valid_time_utc = c.valid_time_utc - INTERVAL 168 HOUR LEFT JOIN canonical d ON d.valid_time_utc = c.valid_time_utc - INTERVAL 336 HOUR
      LEFT JOIN canonical e ON e.valid_time_utc = c.valid_time_utc - INTERVAL 504 HOUR LEFT JOIN canonical g ON g.valid_time_utc = c.valid_time_utc - INTERVAL 672 HOUR
      WHERE year(c.delivery_date_local) = 2024 AND c.price IS NOT NULL AND a.price IS NOT NULL AND b.price IS NOT NULL AND c.f_t IS NOT NULL AND c.f_s IS NOT NULL AND a.price_at <= c.as_of_utc AND b.price_at <= c.as_of_utc""",
)
def day_ahead_price(spark: SparkSession, path: str) -> DataFrame:
    rows = D.day_ahead_price(S.settle(canonical(spark, path)), 2024, VARS)
    return rows.withColumnsRenamed({"weather_forecast_lead_hours": "lead", D.DA_PRICE: "price"})


@query(
    "dataset_mpc_pv", "valid_time_utc:t as_of_utc:t horizon_hours:i pv_last_observed_w:f pv_target_lag_24h_w:f pv_target_lag_168h_w:f pv_power_mean_w:f",
    """SELECT c.valid_time_utc, c.valid_time_utc - to_hours(h) AS as_of_utc, h AS horizon_hours, o.pv AS pv_last_observed_w, a.pv AS pv_target_lag_24h_w, b.pv AS pv_target_lag_168h_w, c.pv AS pv_power_mean_w
      FROM canonical c CROSS JOIN range(1, 11) AS r(h) JOIN canonical o ON o.valid_time_utc = c.valid_time_utc - to_hours(h + 1) JOIN canonical a ON a.valid_time_utc = c.valid_time_utc - INTERVAL 24 HOUR JOIN canonical b ON b.valid_time_utc = c.valid_time_utc - INTERVAL 168 HOUR
      WHERE year(c.delivery_date_local) = 2024 AND c.pv_quality_status = 'usable' AND c.pv IS NOT NULL AND o.pv IS NOT NULL AND a.pv IS NOT NULL AND b.pv IS NOT NULL""",
)
def mpc_pv(spark: SparkSession, path: str) -> DataFrame:
    return D.mpc_pv(S.settle(canonical(spark, path)), 2024)


@query(
    "dataset_multisite_pv", "site_id:s valid_time_utc:t pv_power_mean_w:f site_id_p1:i site_id_p2:i",
    """WITH h AS (SELECT date_trunc('hour', valid_time_utc) AS t, count(*) AS n, avg(p1) AS p1, avg(p2) AS p2 FROM src_pv GROUP BY 1 HAVING count(*) = 4)
      SELECT 'p1' AS site_id, valid_time_utc, p1 AS pv_power_mean_w, 1 AS site_id_p1, 0 AS site_id_p2 FROM pv_rows JOIN h ON t = valid_time_utc UNION ALL SELECT 'p2', valid_time_utc, p2, 0, 1 FROM pv_rows JOIN h ON t = valid_time_utc""",
)
def multisite_pv(spark: SparkSession, path: str) -> DataFrame:
    """Two profiles stacked on the shared feature rows."""
    pv, weather, layers, prices = sources(spark, path)
    table = S.settle(D.canonical_hourly(pv, weather, layers, prices, "p1", VARS, OUTAGES))
    return D.multisite_pv(D.day_ahead_pv(table, 2024, VARS), pv, ["p1", "p2"], ["p1", "p2", "p3"])


_REG = "SELECT * FROM market WHERE delivery_date_local IN (SELECT delivery_date_local FROM market GROUP BY 1 HAVING count(*) = 24 AND count(DISTINCT hour_local) = 24)"


@query(
    "dataset_spatial_price", "valid_time_utc:t as_of_utc:t is_holiday_de:i price_prev_day_h07:f price_prev_day_std:f price_recent_7d_std:f price_lag_d14_same_hour:f price_same_hour_4w_mean:f price:f",
    f"""WITH reg AS ({_REG}) SELECT m.valid_time_utc, {to_utc('(m.delivery_date_local - 1)::TIMESTAMP + INTERVAL 11 HOUR')} AS as_of_utc, 0 AS is_holiday_de, p.h07 AS price_prev_day_h07, p.sd AS price_prev_day_std, w.sd AS price_recent_7d_std,
      l14.da_price AS price_lag_d14_same_hour, (l7.da_price + l14.da_price + l21.da_price + l28.da_price) / 4 AS price_same_hour_4w_mean, m.da_price AS price FROM reg m
      JOIN (SELECT delivery_date_local + 1 AS d, max(da_price) FILTER (WHERE hour_local = 7) AS h07, stddev_pop(da_price) AS sd FROM reg GROUP BY 1) p ON p.d = m.delivery_date_local
      JOIN (SELECT t.d, stddev_pop(h.da_price) AS sd FROM (SELECT DISTINCT delivery_date_local AS d FROM reg) t JOIN reg h ON h.delivery_date_local BETWEEN t.d - 7 AND t.d - 1 GROUP BY 1 HAVING count(DISTINCT h.delivery_date_local) = 7) w ON w.d = m.delivery_date_local """
    + " ".join(f"JOIN reg l{k} ON l{k}.delivery_date_local = m.delivery_date_local - {k} AND l{k}.hour_local = m.hour_local" for k in (1, 2, 7, 14, 21, 28)),
)
def spatial_price(spark: SparkSession, path: str) -> DataFrame:
    """Curve features of the last days of the month (28 days of history needed)."""
    prices = S.settle(S.market(spark, path).select("valid_time_utc", F.col("da_price").alias(D.DA_PRICE)))
    return D.spatial_price_features(prices).withColumnRenamed(D.DA_PRICE, "price")


@query(
    "dataset_spatial_weather", "valid_time_utc:t as_of_utc:t " + " ".join(f"spatial_{s}_temperature_2m:f spatial_{s}_lead_hours:i" for s in S.SITES),
    "WITH w AS (SELECT m.valid_time_utc, " + to_utc("(m.delivery_date_local - 1)::TIMESTAMP + INTERVAL 11 HOUR") + " AS as_of_utc, a.site_id, a.value AS v1, b.value AS v2 FROM market m JOIN site_hours a ON a.valid_time_utc = m.valid_time_utc - INTERVAL 24 HOUR JOIN site_hours b ON b.site_id = a.site_id AND b.valid_time_utc = m.valid_time_utc - INTERVAL 48 HOUR),"
    " c AS (SELECT *, CASE WHEN valid_time_utc - INTERVAL 24 HOUR <= as_of_utc THEN 24 WHEN valid_time_utc - INTERVAL 48 HOUR <= as_of_utc THEN 48 END AS lead FROM w)"
    " SELECT valid_time_utc, as_of_utc, " + ", ".join(f"max(CASE lead WHEN 24 THEN v1 WHEN 48 THEN v2 END) FILTER (WHERE site_id = '{s}') AS spatial_{s}_temperature_2m, max(lead) FILTER (WHERE site_id = '{s}') AS spatial_{s}_lead_hours" for s in S.SITES)
    + " FROM c GROUP BY 1, 2 HAVING " + " AND ".join(f"spatial_{s}_temperature_2m IS NOT NULL" for s in S.SITES),
)
def spatial_weather(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-lead layers of each location as columns, chosen at D-1 11:00."""
    hourly = S.settle(S.site_hours(spark, path))
    parts = [
        hourly.select(F.col("site_id").alias("location_id"), (F.col("valid_time_utc") + C.hours(h)).alias("valid_time_utc"), F.col("value").alias(f"weather_fcst{h}_temperature_2m"))
        for h in (24, 48)
    ]
    t = F.col("valid_time_utc")
    weather = parts[0].join(parts[1], ["location_id", "valid_time_utc"]).withColumns(
        {"weather_fcst24_available_at_utc": t - C.hours(24), "weather_fcst48_available_at_utc": t - C.hours(48)}
    )
    rows = S.market(spark, path).select("valid_time_utc", C.decision_time(F.col("delivery_date_local")).alias("as_of_utc"))
    return D.with_spatial_weather(rows, weather, list(S.SITES), ["temperature_2m"])


@query(
    "dataset_intraday_features",
    "as_of_utc:t target_valid_time_utc:t lead_hours:i da_price:f target_minus_day_mean:f intraday_last6_mean:f spread_last6_std:f id_price_lag_2:f id_price_d7:f intraday_last6_mean_minus_d7:f intraday_last6_median:f intraday_last6_mean_ratio_d14:f intraday_ar1_forecast:f target_spread:f",
    f"""WITH reg AS ({_REG}), r AS ({_window_sql()}), r7 AS ({_window_sql(7)}), r14 AS ({_window_sql(14)}), dm AS (SELECT delivery_date_local, avg(da_price) AS m FROM reg GROUP BY 1)
      SELECT d.valid_time_utc AS as_of_utc, t.valid_time_utc AS target_valid_time_utc, t.hour_local - d.hour_local AS lead_hours, t.da_price, t.da_price - dm.m AS target_minus_day_mean, list_avg(r.w) AS intraday_last6_mean, list_stddev_pop(r.ws) AS spread_last6_std, r.w[5] AS id_price_lag_2, t7.id_price AS id_price_d7,
        list_avg(r.w) - list_avg(r7.w) AS intraday_last6_mean_minus_d7, list_median(r.w) AS intraday_last6_median, list_avg(r.w) / list_avg(r14.w) AS intraday_last6_mean_ratio_d14, ar.f AS intraday_ar1_forecast, t.spread AS target_spread
      FROM reg d JOIN reg t ON t.delivery_date_local = d.delivery_date_local AND t.hour_local > d.hour_local JOIN r ON r.as_of_utc = d.valid_time_utc JOIN r7 ON r7.as_of_utc = d.valid_time_utc JOIN r14 ON r14.as_of_utc = d.valid_time_utc JOIN dm ON dm.delivery_date_local = d.delivery_date_local
      JOIN market t1 ON t1.delivery_date_local = t.delivery_date_local - 1 AND t1.hour_local = t.hour_local JOIN market t7 ON t7.delivery_date_local = t.delivery_date_local - 7 AND t7.hour_local = t.hour_local JOIN market t14 ON t14.delivery_date_local = t.delivery_date_local - 14 AND t14.hour_local = t.hour_local
      JOIN LATERAL (SELECT (my - phi * mx) * list_sum([phi ^ j FOR j IN range(0, (t.hour_local - d.hour_local + 1)::INT)]) + phi ^ (t.hour_local - d.hour_local + 1) * r.w[6] AS f
        FROM (SELECT mx, my, least(greatest(list_sum([(r.w[i] - mx) * (r.w[i + 1] - my) FOR i IN range(1, 6)]) / (list_var_pop(r.w[1:5]) * 5), -0.98), 0.98) AS phi FROM (SELECT list_avg(r.w[1:5]) AS mx, list_avg(r.w[2:6]) AS my))) ar ON TRUE""",
)
def intraday_features(spark: SparkSession, path: str) -> DataFrame:
    """Decision-by-target rows with the enriched feature set."""
    return features.intraday_features(S.settle(S.market(spark, path)), [], "v2")


@query("dataset_contract", "rule:s violations:i",
       "SELECT unnest(['late_weather_forecast_available_at_utc', 'target_already_known', 'duplicate_valid_time_utc']) AS rule,"
       " unnest([count(*) FILTER (WHERE hour(valid_time_utc) = 7), count(*) FILTER (WHERE hour(valid_time_utc) = 9), count(*) FILTER (WHERE hour(valid_time_utc) = 8)]) AS violations FROM pv_rows")
def dataset_contract(spark: SparkSession, path: str) -> DataFrame:
    """A damaged copy of the PV table: decisions of one hour made too early, of one too late, rows of one twice; nothing else breaks a rule."""
    rows = S.settle(D.day_ahead_pv(S.settle(canonical(spark, path)), 2024, VARS))
    hour, days = F.hour("valid_time_utc"), F.expr("INTERVAL 10 DAYS")
    rows = rows.withColumn("as_of_utc", F.when(hour == 7, F.col("as_of_utc") - days).when(hour == 9, F.col("as_of_utc") + days).otherwise(F.col("as_of_utc")))
    rows = rows.unionByName(rows.filter(hour == 8))
    return D.dataset_contract(rows, ["valid_time_utc"], ["weather_forecast_available_at_utc"])

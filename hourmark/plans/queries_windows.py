"""Queries for windows, top-k, set operators and reshaping (F-*, G-*, H-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import audit, contracts, features, metrics, ranking, shaping, splits
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_calendar import SEASON_SQL
from hourmark.plans.queries_joins import _decisions
from hourmark.plans.queries_metrics import _ranks, _scored, pts
from hourmark.plans.series import berlin
from hourmark.sources import sinks

LAGS = (168, 336, 504, 672)
_MONTH_SQL = "SELECT s.site_id, s.valid_time_utc, [" + ", ".join(f"l{k}.value" for k in LAGS) + "] AS lags FROM site_hours s " + " ".join(
    f"LEFT JOIN site_hours l{k} ON l{k}.site_id = s.site_id AND l{k}.valid_time_utc = s.valid_time_utc - INTERVAL {k} HOUR" for k in LAGS
)


@query("f01_four_week_mean", "site_id:s valid_time_utc:t lenient_mean:f strict_mean:f",
       f"SELECT site_id, valid_time_utc, list_avg(lags) AS lenient_mean, CASE WHEN list_count(lags) = 4 THEN list_avg(lags) END AS strict_mean FROM ({_MONTH_SQL})")
def four_week_mean(spark: SparkSession, path: str) -> DataFrame:
    """Mean of the same hour of four earlier weeks, skipping or requiring missing weeks."""
    rows = features.hour_lags(S.settle(S.site_hours(spark, path)), ["site_id"], "valid_time_utc", ["value"], LAGS, names="lag{lag}")
    names = [f"lag{k}" for k in LAGS]
    return rows.withColumns({"lenient_mean": features.mean_skipping_nulls(names), "strict_mean": features.strict_mean(names)})


@query(
    "f02_rolling_nights", "reference_day:d night_reference:f",
    """WITH n AS (SELECT delivery_date_local + (hour_local >= 22)::INT + 1 AS d, greatest(avg(da_price), 0) AS p FROM market WHERE hour_local IN (22, 23, 0, 1, 2, 3, 4, 5, 6) GROUP BY 1)
      SELECT d AS reference_day, r AS night_reference FROM (SELECT d, avg(p) OVER w AS r, count(*) OVER w AS c FROM n WINDOW w AS (ORDER BY d ROWS 13 PRECEDING)) WHERE c = 14""",
)
def rolling_nights(spark: SparkSession, path: str) -> DataFrame:
    """Mean of fourteen completed nights (one row per night)."""
    from hourmark.operators.planning import night_reference

    return night_reference(S.market(spark, path), [], "delivery_date_local", "hour_local", "da_price")


@query(
    "f03_last_active_lags",
    "site_id:s delivery_date_local:d decision_hour:i n_lags:i value_lag_mean:f value_lag_std:f value_lag_trend:f value_lag_1:f value_lag_2:f value_lag_3:f lag_1_available:i lag_2_available:i lag_3_available:i",
    f"""WITH a AS (SELECT site_id, CAST({berlin('valid_time_utc')} AS DATE) AS dd, hour({berlin('valid_time_utc')}) AS h, value FROM site_hours WHERE n >= 2),
      r AS (SELECT d.site_id, d.dd, d.h AS dh, a.value, row_number() OVER (PARTITION BY d.site_id, d.dd, d.h ORDER BY a.h DESC) AS rn FROM a d JOIN a ON a.site_id = d.site_id AND a.dd = d.dd AND a.h < d.h)
      SELECT site_id, dd AS delivery_date_local, dh AS decision_hour, count(*) AS n_lags, avg(value) AS value_lag_mean, stddev_pop(value) AS value_lag_std, CASE WHEN count(*) >= 2 THEN regr_slope(value, -rn) ELSE 0 END AS value_lag_trend,
        max(value) FILTER (WHERE rn = 1) AS value_lag_1, max(value) FILTER (WHERE rn = 2) AS value_lag_2, max(value) FILTER (WHERE rn = 3) AS value_lag_3, count(*) FILTER (WHERE rn = 1) AS lag_1_available, count(*) FILTER (WHERE rn = 2) AS lag_2_available, count(*) FILTER (WHERE rn = 3) AS lag_3_available
      FROM r WHERE rn <= 3 GROUP BY ALL""",
)
def last_active_lags(spark: SparkSession, path: str) -> DataFrame:
    """Last three active hours before every decision, newest first, with flags."""
    t = F.col("valid_time_utc")
    hourly = S.settle(S.site_hours(spark, path).filter("n >= 2").select("site_id", C.local_date(t).alias("delivery_date_local"), C.local_hour(t).alias("hour_local"), "value"))
    decisions = hourly.select("site_id", "delivery_date_local", F.col("hour_local").alias("decision_hour"))
    return features.last_active_lags(decisions, hourly, ["site_id"], "delivery_date_local", "hour_local", "decision_hour", ["value"], 3)


@query("f04_average_ranks", "source_day:d variable:s u:f", "SELECT source_day, variable, u FROM rank_library")
def average_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Average rank per (target, hour), mapped into (0, 1), ranked by distributed counting."""
    return _ranks(spark, path)


sql_view("order_weeks", f"SELECT date_trunc('week', {berlin('valid_time_utc')})::DATE AS week_start, min(valid_time_utc) AS first_time, count(*) AS orders FROM order_clock GROUP BY 1")
sql_view("weeks", f"SELECT week_start, row_number() OVER (ORDER BY week_start) - 1 AS week_index, {SEASON_SQL.format(d=berlin('first_time'))} AS season, orders FROM order_weeks")


@query("f05_week_index", "o_orderkey:i week_start:d week_index:i", f"SELECT o_orderkey, week_start, week_index FROM order_clock JOIN weeks ON week_start = date_trunc('week', {berlin('valid_time_utc')})::DATE")
def week_index(spark: SparkSession, path: str) -> DataFrame:
    """Dense index over present local weeks, joined back to the rows."""
    return splits.with_week_index(S.order_clock(spark, path).select("o_orderkey", "valid_time_utc"), "valid_time_utc")


@query("f06_week_season", "week_start:d week_index:i season:s", "SELECT week_start, week_index, season FROM weeks")
def week_season(spark: SparkSession, path: str) -> DataFrame:
    return splits.week_table(S.order_clock(spark, path).select("valid_time_utc"), "valid_time_utc")


@query("f07_price_rank", "delivery_date_local:d hour_local:i price_rank:i",
       "SELECT delivery_date_local, hour_local, row_number() OVER (PARTITION BY delivery_date_local ORDER BY round(da_price / 10), hour_local) AS price_rank FROM market")
def price_rank(spark: SparkSession, path: str) -> DataFrame:
    """Rank with ties broken by the earlier hour."""
    from hourmark.operators.planning import price_ranks

    rows = S.market(spark, path).withColumn("price_score", F.round(F.col("da_price") / 10.0))
    return price_ranks(rows, ["delivery_date_local"], "hour_local")


@query("f08_latest_per_key", "user_id:i event_id:i ts:t value:f",
       "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, path: str) -> DataFrame:
    """Keep-last de-duplication by partial aggregation."""
    return ranking.latest_per_key(S.table(spark, path, "events", "user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


@query("f09_step_difference", "site_id:s step_seconds:i rows:i",
       "SELECT site_id, step AS step_seconds, count(*) AS rows FROM (SELECT site_id, date_diff('second', lag(m) OVER (PARTITION BY site_id ORDER BY m), m) AS step FROM (SELECT DISTINCT event_type AS site_id, date_trunc('minute', ts) AS m FROM events)) WHERE step IS NOT NULL GROUP BY ALL")
def step_difference(spark: SparkSession, path: str) -> DataFrame:
    """Differences of consecutive minute stamps, lagged inside month buckets."""
    rows = S.readings(spark, path).select("site_id", F.date_trunc("minute", "ts").alias("m"))
    return audit.step_histogram(rows, ["site_id"], "m")


@query(
    "f10_trailing_gap", "candidate:s day:d saving:f window_days:i trailing_saving:f",
    """WITH c AS (SELECT site_id, CAST(valid_time_utc AS DATE) AS day, avg(value) AS cost FROM site_hours GROUP BY ALL), p AS (SELECT c.site_id AS candidate, c.day, b.cost - c.cost AS saving FROM c JOIN c b ON b.day = c.day AND b.site_id = 'view' WHERE c.site_id <> 'view')
      SELECT candidate, day, saving, count(*) OVER w AS window_days, avg(saving) OVER w AS trailing_saving FROM p WINDOW w AS (PARTITION BY candidate ORDER BY day ROWS 13 PRECEDING)""",
)
def trailing_gap(spark: SparkSession, path: str) -> DataFrame:
    from hourmark.operators.ledger import trailing_gap as trailing
    from hourmark.plans.queries_joins import paired_days

    return trailing(paired_days(spark, path), ["candidate"], "day", 14)


_PAIRS_SQL = "SELECT d.delivery_date_local, d.hour_local AS decision_hour_local, t.hour_local - d.hour_local AS lead_hours, t.da_price, t.pv_kwh FROM market d JOIN market t ON t.delivery_date_local = d.delivery_date_local AND t.hour_local > d.hour_local"


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    targets = hourly.select("delivery_date_local", F.col("hour_local").alias("target_hour"), "da_price", "pv_kwh")
    return features.decision_targets(_decisions(hourly), targets, [], "delivery_date_local", "decision_hour_local", "target_hour")


@query(
    "f11_trajectories", "delivery_date_local:d decision_hour_local:i remaining_hours:i first_price:f last_pv:f mean_price:f",
    f"SELECT delivery_date_local, decision_hour_local, count(*) AS remaining_hours, arg_min(da_price, lead_hours) AS first_price, arg_max(pv_kwh, lead_hours) AS last_pv, avg(da_price) AS mean_price FROM ({_PAIRS_SQL}) GROUP BY 1, 2",
)
def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """One row per decision holding its future covariates in lead order."""
    rows = features.trajectories(_pairs(spark, path), ["delivery_date_local", "decision_hour_local"], "lead_hours", ["da_price", "pv_kwh"])
    total = F.aggregate("trajectory", F.lit(0.0), lambda acc, v: acc + v["da_price"])
    return rows.withColumns(
        {"first_price": F.col("trajectory")[0]["da_price"], "last_pv": F.element_at("trajectory", -1)["pv_kwh"], "mean_price": total / F.size("trajectory")}
    )


@query("f12_encoder_history", "as_of_utc:t oldest:f newest:f length:i",
       "SELECT as_of_utc, o AS oldest, n AS newest, 12 AS length FROM (SELECT valid_time_utc AS as_of_utc, lag(pv_kwh, 12) OVER w AS o, lag(pv_kwh, 1) OVER w AS n, lag(valid_time_utc, 12) OVER w AS t FROM market WINDOW w AS (ORDER BY valid_time_utc)) WHERE t = as_of_utc - INTERVAL 12 HOUR")
def encoder_history(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-hour encoder arrays ordered old to new."""
    hourly = S.settle(S.market(spark, path))
    rows = features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["pv_kwh"], n=12)
    w = F.col("pv_kwh_window")
    return rows.select("as_of_utc", w[0].alias("oldest"), F.element_at(w, -1).alias("newest"), F.size(w).alias("length"))


@query("f13_trajectory_rows", "delivery_date_local:d decision_hour_local:i lead_hours:i prediction:f",
       f"SELECT delivery_date_local, decision_hour_local, lead_hours, greatest(pv_kwh + (lead_hours - 12) / 4.0, 0) AS prediction FROM ({_PAIRS_SQL})")
def trajectory_rows(spark: SparkSession, path: str) -> DataFrame:
    """Residual trajectories back to non-negative predictions."""
    pairs = _pairs(spark, path).withColumn("residual", (F.col("lead_hours") - 12) / 4.0)
    keys = ["delivery_date_local", "decision_hour_local"]
    arrays = features.trajectories(pairs, keys, "lead_hours", ["pv_kwh", "residual"])
    return features.trajectory_rows(arrays, keys, "trajectory", "pv_kwh", "residual")


@query("g01_daily_extremes", "delivery_date_local:d hour_local:i da_price:f kind:s",
       "SELECT delivery_date_local, hour_local, da_price, 'top' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price DESC, hour_local) AS r FROM market) WHERE r <= 3"
       " UNION ALL SELECT delivery_date_local, hour_local, da_price, 'bottom' FROM (SELECT *, row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price, hour_local) AS r FROM market) WHERE r <= 3")
def daily_extremes(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path).select("delivery_date_local", "hour_local", "da_price"))
    top = ranking.top_n(hourly, ["delivery_date_local"], [F.col("da_price").desc(), F.col("hour_local")], 3).withColumn("kind", F.lit("top"))
    bottom = ranking.top_n(hourly, ["delivery_date_local"], [F.col("da_price"), F.col("hour_local")], 3).withColumn("kind", F.lit("bottom"))
    return top.unionByName(bottom)


@query("g02_largest_days", "day:d value:f", "SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1 ORDER BY value DESC, day LIMIT 20")
def largest_days(spark: SparkSession, path: str) -> DataFrame:
    """Twenty largest days (a distributed top-k, no global sort)."""
    daily = S.table(spark, path, "orders", "o_orderdate", "o_totalprice").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("value"))
    return daily.orderBy(F.col("value").desc(), "day").limit(20)


@query(
    "g03_best_variant", "selected:s baseline_mae:f best_mae:f",
    "WITH m AS (SELECT variant, avg(abs(da_price - prediction)) AS mae, sqrt(avg((da_price - prediction) ^ 2)) AS rmse FROM scored GROUP BY 1), b AS (SELECT * FROM m WHERE variant <> 'persistence' ORDER BY mae, rmse LIMIT 1)"
    " SELECT CASE WHEN p.mae <= b.mae THEN 'persistence' ELSE b.variant END AS selected, p.mae AS baseline_mae, b.mae AS best_mae FROM m p, b WHERE p.variant = 'persistence'",
)
def best_variant(spark: SparkSession, path: str) -> DataFrame:
    """Lowest-error candidate, keeping the baseline unless it is beaten."""
    scored = S.settle(metrics.point_metrics(_scored(spark, path), ["variant"], "da_price", "prediction"))
    return metrics.best_variant(scored, [], "variant", "persistence")


@query("g04_ordered_sink", "rows:i out_of_order:i", "SELECT count(*) AS rows, 0 AS out_of_order FROM orders")
def ordered_sink(spark: SparkSession, path: str) -> DataFrame:
    """Rows written sorted inside each file; neighbours are checked per file."""
    from pyspark.sql import Window

    out = S.scratch(spark)
    rows = S.order_clock(spark, path).withColumn("day", F.to_date("valid_time_utc"))
    sinks.write_yearly(rows, out, "day", ["day", "o_orderkey"])
    back = spark.read.parquet(out).select("day", "o_orderkey", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    # neighbours are compared inside blocks of one file, so no file is sorted in one task
    blocks = back.withColumn("_b", F.floor(F.col("i") / 1000))
    previous = F.lag(F.struct("day", "o_orderkey")).over(Window.partitionBy("f", "_b").orderBy("i"))
    return blocks.withColumn("_p", previous).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_p") > F.struct("day", "o_orderkey")).alias("out_of_order")
    )


@query(
    "h01_horizon_fanout", "site_id:s valid_time_utc:t horizon_hours:i as_of_utc:t last_observed:f",
    """SELECT s.site_id, s.valid_time_utc, h AS horizon_hours, s.valid_time_utc - to_hours(h) AS as_of_utc, o.value AS last_observed FROM site_hours s CROSS JOIN range(1, 11) AS r(h)
      JOIN site_hours o ON o.site_id = s.site_id AND o.valid_time_utc = s.valid_time_utc - to_hours(h + 1)""",
)
def horizon_fanout(spark: SparkSession, path: str) -> DataFrame:
    """Leads 1..10 with the newest completed observation before each decision."""
    hourly = S.settle(S.site_hours(spark, path).withColumn("available_at", F.col("valid_time_utc") + C.hours(1)))
    fan = features.horizon_fanout(hourly.select("site_id", "valid_time_utc"), "valid_time_utc", 10)
    return features.last_observed(fan, hourly, ["site_id"], "valid_time_utc", "value", "available_at", "last_observed")


@query("h02_equal_pairs", "variant:s rows:i pairs:i", "SELECT variant, count(*) AS rows, count(DISTINCT (day, hour_local)) AS pairs FROM scored GROUP BY 1")
def equal_pairs(spark: SparkSession, path: str) -> DataFrame:
    return contracts.equal_pair_counts(_scored(spark, path), "variant", ["day", "hour_local"])


@query("h03_melted_predictions", "day:d hour_local:i variant:s prediction:f", "SELECT day, hour_local, variant, prediction FROM scored")
def melted_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _scored(spark, path)


@query("h04_common_stamps", "common:i first_time:t last_time:t",
       "SELECT count(*) AS common, min(t) AS first_time, max(t) AS last_time FROM (SELECT valid_time_utc AS t FROM site_hours WHERE site_id = 'view' INTERSECT SELECT valid_time_utc FROM site_hours WHERE site_id = 'click' INTERSECT SELECT valid_time_utc FROM site_hours WHERE site_id = 'error')")
def common_stamps(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.site_hours(spark, path).select("site_id", "valid_time_utc"))
    return audit.common_stamps([hourly.filter(F.col("site_id") == s) for s in ("view", "click", "error")], "valid_time_utc")


_HOURS = range(24)


@query("h05_pivot_hours", "site_id:s day:d " + " ".join(f"v_h{h:02d}:f" for h in _HOURS),
       "SELECT site_id, CAST(valid_time_utc AS DATE) AS day, " + ", ".join(f"max(value) FILTER (WHERE hour(valid_time_utc) = {h}) AS v_h{h:02d}" for h in _HOURS) + " FROM site_hours GROUP BY 1, 2")
def pivot_hours(spark: SparkSession, path: str) -> DataFrame:
    rows = S.site_hours(spark, path).select("site_id", F.to_date("valid_time_utc").alias("day"), F.hour("valid_time_utc").alias("h"), "value")
    return features.pivot_hours(rows, ["site_id", "day"], "h", "value", list(_HOURS), "v")


_BLOCKS = [(t, h) for t in ("pv", "price", "spread") for h in S.WORKING]


@query("h06_day_blocks", "source_day:d " + " ".join(f"{t}_h{h:02d}:f" for t, h in _BLOCKS),
       "SELECT source_day, " + ", ".join(f"max({t}_residual) FILTER (WHERE hour_local = {h}) AS {t}_h{h:02d}" for t, h in _BLOCKS) + " FROM residuals GROUP BY 1")
def day_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Three labelled 16-hour blocks per library day from one aggregation."""
    lib = S.residuals(pts(spark, path))
    return lib.groupBy("source_day").agg(*[F.max(F.when(F.col("hour_local") == h, F.col(f"{t}_residual"))).alias(f"{t}_h{h:02d}") for t, h in _BLOCKS])


@query("h07_site_stack", "valid_time_utc:t site_id:s power_w:f",
       "SELECT valid_time_utc, site_id, v AS power_w FROM (SELECT valid_time_utc, unnest(['da_price', 'id_price', 'pv_kwh']) AS site_id, unnest([da_price, id_price, pv_kwh]) AS v FROM market)")
def site_stack(spark: SparkSession, path: str) -> DataFrame:
    """Profile columns stacked to site rows."""
    return shaping.unpivot_profiles(S.market(spark, path), ["valid_time_utc"], ["da_price", "id_price", "pv_kwh"])


@query("h09_key_guard", "site_id:s valid_time_utc:t status:s",
       "SELECT s.site_id, s.valid_time_utc, 'missing' AS status FROM site_hours s WHERE n = 1 UNION ALL SELECT site_id, valid_time_utc + INTERVAL 1 YEAR, 'extra' FROM site_hours WHERE n >= 8")
def key_guard(spark: SparkSession, path: str) -> DataFrame:
    """Missing and extra keys of a damaged copy."""
    hourly = S.settle(S.site_hours(spark, path))
    copy = hourly.filter("n > 1").select("site_id", "valid_time_utc").unionByName(
        hourly.filter("n >= 8").select("site_id", (F.col("valid_time_utc") + F.expr("interval 1 year")).alias("valid_time_utc"))
    )
    return contracts.unexpected_and_missing(hourly, copy, ["site_id", "valid_time_utc"])



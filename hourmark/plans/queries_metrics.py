"""Queries for aggregations and forecast quality (E-01..E-31, E-39..E-45)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.functions import numeric as N
from hourmark.operators import audit, features, metrics, pointintime, ranking, shaping, uncertainty
from hourmark.params import QUANTILE_LEVELS
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_calendar import SEASON_SQL, TYPE_SQL
from hourmark.plans.queries_joins import _FULL_LOCATIONS_SQL, _decisions, _window_sql, requests_at


def pts(spark: SparkSession, path: str) -> DataFrame:
    """Settled market rows with their persistence points."""
    return S.points(S.settle(S.market(spark, path)))


@query(
    "e01_resample_hourly", "site_id:s valid_time_utc:t power_mean_w:f intervals:i quality_status:s energy_kwh:f available_at_utc:t",
    "SELECT event_type AS site_id, date_trunc('hour', ts) AS valid_time_utc, avg(value) AS power_mean_w, count(value) AS intervals, CASE WHEN bool_and(value <= 200) THEN 'usable' ELSE 'excluded' END AS quality_status,"
    " avg(value) / 1000 AS energy_kwh, date_trunc('hour', ts) + INTERVAL 1 HOUR AS available_at_utc FROM events GROUP BY 1, 2",
)
def resample_hourly(spark: SparkSession, path: str) -> DataFrame:
    rows = S.readings(spark, path).withColumn("status", F.when(F.col("value") > 200, "spike").otherwise("usable"))
    return shaping.resample_hourly(rows, ["site_id"], "ts", "value", "status")


@query("e02_multisite_complete_hours", "site_id:s valid_time_utc:t power_mean_w:f",
       "SELECT event_type AS site_id, date_trunc('hour', ts) AS valid_time_utc, avg(value) AS power_mean_w FROM events GROUP BY 1, 2 HAVING count(*) = 4")
def multisite_complete_hours(spark: SparkSession, path: str) -> DataFrame:
    """Hours with exactly four readings."""
    return shaping.complete_hours(shaping.resample_hourly(S.readings(spark, path), ["site_id"], "ts", "value"), 4)


@query("e03_day_shape", "site_id:s day:d periods:i unique_hours:i",
       "SELECT event_type AS site_id, CAST(ts AS DATE) AS day, count(*) AS periods, count(DISTINCT hour(ts)) AS unique_hours FROM events GROUP BY 1, 2")
def day_shape(spark: SparkSession, path: str) -> DataFrame:
    """Readings and distinct hours per site day (hours collapsed before the distinct count)."""
    hourly = S.readings(spark, path).groupBy("site_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hourly.groupBy("site_id", F.to_date("h").alias("day")).agg(F.sum("n").alias("periods"), F.count(F.lit(1)).alias("unique_hours"))


_STATS = "{p}_mean:f {p}_std:f {p}_min:f {p}_max:f {p}_range:f {p}_negative_share:f"


@query(
    "e04_previous_day_stats", "delivery_date_local:d " + _STATS.format(p="prev") + " recent_mean:f recent_std:f",
    """WITH d AS (SELECT delivery_date_local + 1 AS delivery_date_local, avg(da_price) AS prev_mean, stddev_pop(da_price) AS prev_std, min(da_price) AS prev_min, max(da_price) AS prev_max,
        max(da_price) - min(da_price) AS prev_range, avg((da_price < 0)::INT) AS prev_negative_share FROM market GROUP BY 1),
      w AS (SELECT t.delivery_date_local, avg(h.da_price) AS recent_mean, stddev_pop(h.da_price) AS recent_std FROM (SELECT DISTINCT delivery_date_local + 1 AS delivery_date_local FROM market) t
        JOIN market h ON h.delivery_date_local BETWEEN t.delivery_date_local - 7 AND t.delivery_date_local - 1 GROUP BY 1 HAVING count(DISTINCT h.delivery_date_local) = 7)
      SELECT * FROM d JOIN w USING (delivery_date_local)""",
)
def previous_day_stats(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    day = "delivery_date_local"
    yesterday = hourly.withColumn(day, F.date_add(day, 1)).groupBy(day).agg(*features.curve_stats("da_price", "prev"))
    return yesterday.join(features.trailing_days_stats(hourly, [], day, "da_price", 7, "recent"), day)


@query(
    "e05_curve_stats", "valid_time_utc:t day_mean:f day_std:f day_min:f day_max:f minus_mean:f",
    "SELECT valid_time_utc, avg(da_price) OVER w AS day_mean, stddev_pop(da_price) OVER w AS day_std, min(da_price) OVER w AS day_min, max(da_price) OVER w AS day_max,"
    " da_price - avg(da_price) OVER w AS minus_mean FROM market WINDOW w AS (PARTITION BY delivery_date_local)",
)
def curve_stats(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    stats = hourly.groupBy("delivery_date_local").agg(*features.curve_stats("da_price", "day"))
    return hourly.join(stats, "delivery_date_local").withColumn("minus_mean", F.col("da_price") - F.col("day_mean"))


def _recent(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    return features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["id_price", "spread"])


@query(
    "e06_last_six_stats", "as_of_utc:t p_mean:f p_std:f p_min:f p_max:f p_momentum:f s_mean:f s_std:f s_momentum:f",
    "SELECT as_of_utc, list_avg(w) AS p_mean, list_stddev_pop(w) AS p_std, list_min(w) AS p_min, list_max(w) AS p_max, w[6] - w[5] AS p_momentum, list_avg(ws) AS s_mean, list_stddev_pop(ws) AS s_std, ws[6] - ws[5] AS s_momentum"
    f" FROM ({_window_sql()})",
)
def last_six_stats(spark: SparkSession, path: str) -> DataFrame:
    rows = _recent(spark, path)
    return rows.withColumns({**features.array_stats(F.col("id_price_window"), "p"), **features.array_stats(F.col("spread_window"), "s")})


@query(
    "e07_enriched_last_six", "as_of_utc:t p_median:f p_iqr:f p_abs_change_mean:f p_slope:f p_last_minus_mean:f ratio_d7:f ratio_d7_valid:i",
    f"""SELECT a.as_of_utc, list_median(a.w) AS p_median, list_aggregate(a.w, 'quantile_cont', 0.75) - list_aggregate(a.w, 'quantile_cont', 0.25) AS p_iqr,
      (abs(w[2] - w[1]) + abs(w[3] - w[2]) + abs(w[4] - w[3]) + abs(w[5] - w[4]) + abs(w[6] - w[5])) / 5 AS p_abs_change_mean,
      (-2.5 * w[1] - 1.5 * w[2] - 0.5 * w[3] + 0.5 * w[4] + 1.5 * w[5] + 2.5 * w[6]) / 17.5 AS p_slope, w[6] - list_avg(w) AS p_last_minus_mean,
      list_avg(w) / m7 AS ratio_d7, (abs(m7) > 1e-8)::INT AS ratio_d7_valid FROM ({_window_sql()}) a JOIN (SELECT as_of_utc, list_avg(w) AS m7 FROM ({_window_sql(7)})) b USING (as_of_utc)""",
)
def enriched_last_six(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    recent = features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["id_price"])
    week = features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["id_price"], local_days_back=7).withColumnRenamed("id_price_window", "w7")
    rows = recent.join(week, "as_of_utc").withColumns(features.enriched_window_stats(F.col("id_price_window"), "p"))
    m, m7 = (features.array_stats(F.col(c), "x")["x_mean"] for c in ("id_price_window", "w7"))
    return rows.withColumns({"ratio_d7": N.ratio_or_sentinel(m, m7), "ratio_d7_valid": (F.abs(m7) > 1e-8).cast("int")})


@query("e08_short_slope", "o_custkey:i orders:i slope:f",
       "SELECT o_custkey, count(*) AS orders, CASE WHEN count(*) >= 2 THEN regr_slope(p, i) ELSE 0 END AS slope FROM (SELECT o_custkey, o_totalprice / 1000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r, -row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders) WHERE r <= 6 GROUP BY 1")
def short_slope(spark: SparkSession, path: str) -> DataFrame:
    """Slope over each customer's last six orders (limited per group before the shuffle)."""
    last = ranking.top_n(S.table(spark, path, "orders", "o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey").desc()], 6)
    arrays = last.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("p")))).alias("a"))
    return arrays.select("o_custkey", F.size("a").alias("orders"), N.slope(F.col("a.p")).alias("slope"))


@query(
    "e09_local_ar1", "as_of_utc:t steps:i forecast:f",
    f"""WITH b AS (SELECT as_of_utc, w, hour(as_of_utc) % 5 + 2 AS k, w[1:5] AS x, w[2:6] AS y FROM ({_window_sql()})),
      m AS (SELECT *, list_avg(x) AS mx, list_avg(y) AS my, list_var_pop(x) * 5 AS sxx FROM b),
      f AS (SELECT *, least(greatest(list_sum([(x[i] - mx) * (y[i] - my) FOR i IN range(1, 6)]) / sxx, -0.98), 0.98) AS phi FROM m)
      SELECT as_of_utc, k AS steps, CASE WHEN sxx <= 1e-8 THEN list_avg(w) ELSE (my - phi * mx) * list_sum([phi ^ j FOR j IN range(0, k)]) + phi ^ k * w[6] END AS forecast FROM f""",
)
def local_ar1(spark: SparkSession, path: str) -> DataFrame:
    steps = F.hour("as_of_utc") % 5 + 2
    return _recent(spark, path).withColumns({"steps": steps, "forecast": N.ar1_forecast(F.col("id_price_window"), steps)})


@query("e10_spatial_summary", "as_of_utc:t valid_time_utc:t forecast_mean:f forecast_std:f",
       f"SELECT as_of_utc, valid_time_utc, avg(forecast) AS forecast_mean, stddev_samp(forecast) AS forecast_std FROM ({_FULL_LOCATIONS_SQL}) WHERE n = 5 GROUP BY ALL")
def spatial_summary(spark: SparkSession, path: str) -> DataFrame:
    """Mean and sample std over all locations of the latest runs."""
    hourly = S.settle(S.market(spark, path).select("valid_time_utc"))
    picked = pointintime.asof_per_location(requests_at(hourly, 9), S.forecast_archive(spark, path), [], len(S.SITES))
    return pointintime.spatial_summary(picked, ["as_of_utc", "valid_time_utc"], ["forecast"])


@query(
    "b21_forecast_revision", "valid_time_utc:t mean_revision:f std_revision:f",
    f"""WITH d AS ({_FULL_LOCATIONS_SQL}), l AS ({_FULL_LOCATIONS_SQL.replace('INTERVAL 9 HOUR', 'INTERVAL 1 HOUR')}),
      ds AS (SELECT valid_time_utc, avg(forecast) AS m, stddev_samp(forecast) AS s FROM d WHERE n = 5 GROUP BY 1), ls AS (SELECT valid_time_utc, avg(forecast) AS m, stddev_samp(forecast) AS s FROM l WHERE n = 5 GROUP BY 1)
      SELECT valid_time_utc, ls.m - ds.m AS mean_revision, ls.s - ds.s AS std_revision FROM ds JOIN ls USING (valid_time_utc)""",
)
def forecast_revision(spark: SparkSession, path: str) -> DataFrame:
    """Latest minus earlier cross-location mean and std."""
    hourly = S.settle(S.market(spark, path).select("valid_time_utc"))
    archive = S.settle(S.forecast_archive(spark, path))

    def summary(lead: int, tag: str) -> DataFrame:
        picked = pointintime.asof_per_location(requests_at(hourly, lead), archive, [], len(S.SITES))
        out = pointintime.spatial_summary(picked, ["valid_time_utc"], ["forecast"])
        return out.withColumnsRenamed({"forecast_mean": f"{tag}_m", "forecast_std": f"{tag}_s"})

    rows = summary(9, "old").join(summary(1, "new"), "valid_time_utc")
    return rows.withColumns({"mean_revision": F.col("new_m") - F.col("old_m"), "std_revision": F.col("new_s") - F.col("old_s")})


@query(
    "e11_price_shape", "season:s day_type:s hour_local:i score:f",
    f"""WITH o AS (SELECT {SEASON_SQL.format(d='l')} AS season, {TYPE_SQL.format(d='l')} AS day_type, hour(l) AS hour_local, o_totalprice / 1000 AS p FROM (SELECT *, {S.berlin('valid_time_utc')} AS l FROM order_clock))
      SELECT season, day_type, hour_local, median(p) AS score FROM o GROUP BY GROUPING SETS ((season, day_type, hour_local), (day_type, hour_local))""",
)
def price_shape(spark: SparkSession, path: str) -> DataFrame:
    """Seasonal clock-price medians with the day-type fallback rows (null season)."""
    from hourmark.operators.planning import price_shape as fit

    t = F.col("valid_time_utc")
    rows = S.order_clock(spark, path).select(C.local_date(t).alias("day"), C.local_hour(t).alias("hour"), (F.col("o_totalprice") / 1000.0).alias("p"))
    return fit(rows, "day", "hour", "p")


@query(
    "e12_night_reference", "reference_day:d night_price:f",
    "SELECT delivery_date_local + (hour_local >= 22)::INT + 1 AS reference_day, greatest(avg(da_price), 0) AS night_price FROM market WHERE hour_local IN (22, 23, 0, 1, 2, 3, 4, 5, 6) GROUP BY 1",
)
def night_prices(spark: SparkSession, path: str) -> DataFrame:
    """Nightly mean over nine labels, floored at zero (a one-night lookback)."""
    from hourmark.operators.planning import night_reference

    return night_reference(S.market(spark, path), [], "delivery_date_local", "hour_local", "da_price", nights=1)


@query("e13_site_descriptives", "site_id:s rows:i peak:f p995:f", "SELECT event_type AS site_id, count(*) AS rows, max(value) AS peak, quantile_cont(value, 0.995) AS p995 FROM events GROUP BY 1")
def site_descriptives(spark: SparkSession, path: str) -> DataFrame:
    """Exact p99.5 over all readings of a site, counted across tasks."""
    return ranking.describe(S.readings(spark, path).select("site_id", "value"), ["site_id"], "value", [0.995], ["p995"])


def _scored(spark: SparkSession, path: str) -> DataFrame:
    """Two variants scored on identical hours: persistence and the intraday curve."""
    return shaping.melt(
        pts(spark, path).withColumn("day", F.col("delivery_date_local")), ["day", "hour_local", "da_price"],
        {"da_price_point": "persistence", "id_price": "intraday"},
    )


sql_view("scored", "SELECT delivery_date_local AS day, hour_local, da_price, 'persistence' AS variant, da_price_point AS prediction FROM points UNION ALL SELECT delivery_date_local, hour_local, da_price, 'intraday', id_price FROM points")
MAE, RMSE = "avg(abs(da_price - prediction)) AS mae", "sqrt(avg((da_price - prediction) ^ 2)) AS rmse"


@query("e14_point_metrics", "variant:s rows:i mae:f rmse:f bias:f", f"SELECT variant, count(*) AS rows, {MAE}, {RMSE}, avg(prediction - da_price) AS bias FROM scored GROUP BY 1")
def point_metrics(spark: SparkSession, path: str) -> DataFrame:
    return metrics.point_metrics(_scored(spark, path), ["variant"], "da_price", "prediction")


@query(
    "e15_normalised_metrics", "variant:s nmae:f nrmse:f",
    f"WITH p AS (SELECT max(da_price) AS peak FROM market WHERE delivery_date_local <= DATE '2024-01-15') SELECT variant, mae / peak AS nmae, rmse / peak AS nrmse FROM (SELECT variant, {MAE}, {RMSE} FROM scored WHERE day > DATE '2024-01-15' GROUP BY 1), p",
)
def normalised_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Errors of the later window as shares of the training window's peak."""
    rows = S.settle(_scored(spark, path))
    split = F.lit("2024-01-15").cast("date")
    hourly = S.market(spark, path).filter(F.col("delivery_date_local") <= split)
    out = metrics.point_metrics(rows.filter(F.col("day") > split), ["variant"], "da_price", "prediction")
    peak = hourly.agg(F.max("da_price")).scalar()
    return out.withColumns({"nmae": F.col("mae") / peak, "nrmse": F.col("rmse") / peak})


PERIODS = [("january", "2024-01-01", "2024-01-31"), ("first_half", "2024-01-01", "2024-01-15"), ("second_week", "2024-01-08", "2024-01-14")]


@query(
    "e16_period_metrics", "period:s variant:s rows:i mae:f bias:f p95_abs_error:f",
    "SELECT period, variant, count(*) AS rows, avg(abs(prediction - da_price)) AS mae, avg(prediction - da_price) AS bias, quantile_cont(abs(prediction - da_price), 0.95) AS p95_abs_error FROM scored JOIN (VALUES "
    + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + ") AS t(period, a, b) ON day BETWEEN a AND b GROUP BY ALL",
)
def period_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Bias and p95 error over overlapping named periods."""
    return metrics.period_metrics(S.settle(_scored(spark, path)), PERIODS, "day", ["variant"], "da_price", "prediction")


@query("e17_metrics_over_sets", "variant:s hour_local:i rows:i mae:f rmse:f",
       f"SELECT variant, hour_local, count(*) AS rows, {MAE}, {RMSE} FROM scored GROUP BY GROUPING SETS ((variant, hour_local), (variant), ())")
def metrics_over_sets(spark: SparkSession, path: str) -> DataFrame:
    return metrics.metrics_over_sets(_scored(spark, path), [["variant", "hour_local"], ["variant"], []], "da_price", "prediction")


@query(
    "e18_next_hour_metrics", "next_rows:i next_mae:f next_rmse:f all_rows:i all_mae:f all_rmse:f",
    """WITH p AS (SELECT t.id_price AS y, t.da_price AS f, t.hour_local - d.hour_local AS lead FROM market d JOIN market t ON t.delivery_date_local = d.delivery_date_local AND t.hour_local > d.hour_local)
      SELECT count(*) FILTER (WHERE lead = 1) AS next_rows, avg(abs(y - f)) FILTER (WHERE lead = 1) AS next_mae, sqrt(avg((y - f) ^ 2) FILTER (WHERE lead = 1)) AS next_rmse, count(*) AS all_rows, avg(abs(y - f)) AS all_mae, sqrt(avg((y - f) ^ 2)) AS all_rmse FROM p""",
)
def next_hour_metrics(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    targets = hourly.select("delivery_date_local", F.col("hour_local").alias("target_hour"), "id_price", "da_price")
    pairs = features.decision_targets(_decisions(hourly), targets, [], "delivery_date_local", "decision_hour_local", "target_hour")
    return metrics.masked_metrics(pairs, [], "id_price", "da_price", {"next": F.col("lead_hours") == 1, "all": F.lit(True)})


@query(
    "e19_fold_summary", "variant:s folds:i mae_mean:f mae_std:f mae_std_pop:f",
    f"SELECT variant, count(*) AS folds, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, stddev_pop(mae) AS mae_std_pop FROM (SELECT variant, day(day) % 5 AS fold, {MAE} FROM scored GROUP BY ALL) GROUP BY 1",
)
def fold_summary(spark: SparkSession, path: str) -> DataFrame:
    """Mean and spread of fold errors with either divisor."""
    folds = metrics.point_metrics(_scored(spark, path).withColumn("fold", F.dayofmonth("day") % 5), ["variant", "fold"], "da_price", "prediction")
    folds = S.settle(folds)
    population = metrics.fold_summary(folds, "fold", ["variant"], "mae", ddof=0).select("variant", F.col("mae_std").alias("mae_std_pop"))
    return metrics.fold_summary(folds, "fold", ["variant"], "mae").join(population, "variant")


@query("e19_paired_improvement", "fold:i baseline:f challenger:f improvement:f",
       f"WITH m AS (SELECT variant, day(day) % 5 AS fold, {MAE} FROM scored GROUP BY ALL) SELECT a.fold, a.mae AS baseline, b.mae AS challenger, a.mae - b.mae AS improvement FROM m a JOIN m b USING (fold) WHERE a.variant = 'persistence' AND b.variant = 'intraday'")
def paired_improvement(spark: SparkSession, path: str) -> DataFrame:
    folds = metrics.point_metrics(_scored(spark, path).withColumn("fold", F.dayofmonth("day") % 5), ["variant", "fold"], "da_price", "prediction")
    return metrics.paired_improvement(folds, "variant", "persistence", "intraday", ["fold"], "mae")


@query(
    "e20_daily_spearman", "days:i mean_spearman:f",
    """WITH r AS (SELECT delivery_date_local AS d, rank() OVER (PARTITION BY delivery_date_local ORDER BY da_price) + (count(*) OVER (PARTITION BY delivery_date_local, da_price) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY delivery_date_local ORDER BY da_price_point) + (count(*) OVER (PARTITION BY delivery_date_local, da_price_point) - 1) / 2.0 AS b FROM points)
      SELECT count(*) AS days, avg(c) AS mean_spearman FROM (SELECT d, corr(a, b) AS c FROM r GROUP BY 1) WHERE NOT isnan(c)""",
)
def daily_spearman(spark: SparkSession, path: str) -> DataFrame:
    daily = metrics.daily_spearman(pts(spark, path), ["delivery_date_local"], "da_price", "da_price_point")
    return daily.agg(F.count("spearman").alias("days"), F.avg("spearman").alias("mean_spearman"))


@query(
    "e21_extreme_overlap", "delivery_date_local:d top_overlap:f bottom_overlap:f",
    """WITH r AS (SELECT delivery_date_local, row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price DESC, hour_local) AS ta, row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price_point DESC, hour_local) AS tp,
        row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price, hour_local) AS ba, row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price_point, hour_local) AS bp FROM points)
      SELECT delivery_date_local, count(*) FILTER (WHERE ta <= 6 AND tp <= 6) / 6.0 AS top_overlap, count(*) FILTER (WHERE ba <= 6 AND bp <= 6) / 6.0 AS bottom_overlap FROM r GROUP BY 1""",
)
def extreme_overlap(spark: SparkSession, path: str) -> DataFrame:
    return metrics.extreme_overlap(pts(spark, path), ["delivery_date_local"], "hour_local", "da_price", "da_price_point", 6)


_LONG_Q = "SELECT hour_local, da_price AS y, unnest([" + ", ".join(f"{{'level': {lv}, 'q': {c}}}" for c, lv in S.Q_COLUMNS.items()) + "], recursive := true) FROM quantile_forecasts"


@query("e22_pinball_loss", "level:f rows:i pinball_loss:f",
       f"SELECT level, count(*) AS rows, avg(CASE WHEN y >= q THEN level * (y - q) ELSE (1 - level) * (q - y) END) AS pinball_loss FROM ({_LONG_Q}) GROUP BY GROUPING SETS ((level), ())")
def pinball_loss(spark: SparkSession, path: str) -> DataFrame:
    """Per level and, with a null level, over all levels."""
    rows = metrics.long_quantiles(S.quantile_forecasts(pts(spark, path)), [], "da_price", S.Q_COLUMNS)
    loss = metrics.pinball(F.col("actual"), F.col("quantile"), F.col("level"))
    return rows.groupingSets([[F.col("level")], []], F.col("level")).agg(F.count(F.lit(1)).alias("rows"), F.avg(loss).alias("pinball_loss"))


@query("e23_quantile_calibration", "hour_local:i level:f empirical_cdf:f calibration_error:f",
       f"SELECT hour_local, level, avg((y <= q)::INT) AS empirical_cdf, avg((y <= q)::INT) - level AS calibration_error FROM ({_LONG_Q}) GROUP BY 1, 2")
def quantile_calibration(spark: SparkSession, path: str) -> DataFrame:
    return metrics.quantile_scores(S.quantile_forecasts(pts(spark, path)), [], "da_price", S.Q_COLUMNS, ["hour_local"])


@query("e24_interval_coverage", "hour_local:i rows:i coverage:f mean_width:f",
       "SELECT hour_local, count(*) AS rows, avg((da_price BETWEEN price_q10 AND price_q90)::INT) AS coverage, avg(price_q90 - price_q10) AS mean_width FROM quantile_forecasts GROUP BY GROUPING SETS ((hour_local), ())")
def interval_coverage(spark: SparkSession, path: str) -> DataFrame:
    """By hour and, with a null hour, overall."""
    rows = S.settle(S.quantile_forecasts(pts(spark, path)).select("hour_local", "da_price", "price_q10", "price_q90"))
    hourly = metrics.interval_scores(rows, ["hour_local"], "da_price", "price_q10", "price_q90")
    overall = metrics.interval_scores(rows, [], "da_price", "price_q10", "price_q90").withColumn("hour_local", F.lit(None).cast("int"))
    return hourly.unionByName(overall)


@query("e25_quantile_crossing", "rows:i crossing_rows:i crossing_rate:f",
       "SELECT count(*) AS rows, count(*) FILTER (WHERE c) AS crossing_rows, avg(c::INT) AS crossing_rate FROM (SELECT " + " OR ".join(f"{b} < {a}" for a, b in zip(list(S.Q_COLUMNS), list(S.Q_COLUMNS)[1:])) + " AS c FROM quantile_forecasts)")
def quantile_crossing(spark: SparkSession, path: str) -> DataFrame:
    return metrics.crossing_rate(S.quantile_forecasts(pts(spark, path)), list(S.Q_COLUMNS))


def _ensemble(spark: SparkSession, path: str) -> DataFrame:
    """Five hundred reproducible members around each price point."""
    rows = pts(spark, path).select("delivery_date_local", "hour_local", "da_price", "da_price_point")
    rows = rows.withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(499))))
    noise = N.draw_uniform(F.col("scenario_id"), uncertainty.day_number(F.col("delivery_date_local")) * 24 + F.col("hour_local"), 7)
    return rows.withColumn("value", F.col("da_price_point") + (noise - 0.5) * 80.0)


def draw_sql(scenario: str, ordinal: str, seed: int, rounds: int = 3) -> str:
    """SQL: the integer mixing of ``functions.numeric.draw``."""
    a, b, c = N.DRAW_FACTORS
    x = f"(({scenario})::BIGINT * {a} + ({ordinal})::BIGINT * {b} + {c * seed}) % {N.DRAW_PRIME}"
    for _ in range(rounds):
        x = f"list_transform([{x}], lambda z: (z * z + {N.DRAW_STEP}) % {N.DRAW_PRIME})[1]"
    return x


def day_number_sql(day: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', {day})"


sql_view(
    "ensemble",
    f"SELECT delivery_date_local, hour_local, da_price, s AS scenario_id, da_price_point + ({draw_sql('s', day_number_sql('delivery_date_local') + ' * 24 + hour_local', 7)} / {N.DRAW_PRIME}.0 - 0.5) * 80 AS value FROM points, range(500) AS r(s)",
)


@query("e26_scenario_bands", "delivery_date_local:d hour_local:i mean:f p10:f p50:f p90:f",
       "SELECT delivery_date_local, hour_local, avg(value) AS mean, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM ensemble GROUP BY 1, 2")
def scenario_bands(spark: SparkSession, path: str) -> DataFrame:
    return metrics.scenario_bands(_ensemble(spark, path), ["delivery_date_local", "hour_local"], "value")


@query(
    "e27_ensemble_crps", "delivery_date_local:d hour_local:i members:i crps:f",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY delivery_date_local, hour_local ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY delivery_date_local, hour_local) AS n FROM ensemble)
      SELECT delivery_date_local, hour_local, count(*) AS members, avg(abs(value - da_price)) - sum((2 * i - n + 1) * value) / (max(n) * max(n)) AS crps FROM s GROUP BY 1, 2""",
)
def ensemble_crps(spark: SparkSession, path: str) -> DataFrame:
    return metrics.ensemble_crps(_ensemble(spark, path), ["delivery_date_local", "hour_local"], "value", "da_price")


@query("e28_residual_diagnostics", "hour_local:i rows:i mean:f std:f p10:f median:f p90:f",
       "SELECT hour_local, count(*) AS rows, avg(price_residual) AS mean, stddev_samp(price_residual) AS std, quantile_cont(price_residual, 0.1) AS p10, median(price_residual) AS median, quantile_cont(price_residual, 0.9) AS p90 FROM residuals GROUP BY 1")
def residual_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    return metrics.residual_diagnostics(S.settle(S.residuals(pts(spark, path))), ["hour_local"], "price_residual")


def _long_residuals(lib: DataFrame) -> DataFrame:
    long = lib.unpivot(["source_day", "hour_local"], ["pv_residual", "price_residual", "spread_residual"], "target", "value")
    return long.withColumn("variable", F.format_string("%s_h%02d", F.regexp_replace("target", "_residual", ""), F.col("hour_local")))


sql_view(
    "long_residuals",
    "SELECT source_day, hour_local, t AS target, v AS value, replace(t, '_residual', '') || '_h' || lpad(hour_local::VARCHAR, 2, '0') AS variable FROM (SELECT source_day, hour_local, unnest(['pv_residual', 'price_residual', 'spread_residual']) AS t, unnest([pv_residual, price_residual, spread_residual]) AS v FROM residuals)",
)
_CORR_SQL = "SELECT a.variable AS variable_i, b.variable AS variable_j, corr(a.{v}, b.{v}) AS correlation, count(*) AS days FROM {t} a JOIN {t} b USING (source_day) GROUP BY ALL"


@query("e29_correlation_matrix", "variable_i:s variable_j:s correlation:f days:i", _CORR_SQL.format(v="value", t="long_residuals"))
def correlation_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Pearson correlation of 48 day-vector variables."""
    return metrics.correlation_matrix(_long_residuals(S.settle(S.residuals(pts(spark, path)))), "source_day", "variable", "value")


sql_view(
    "rank_library",
    "SELECT source_day, hour_local, target, variable, (rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY variable) AS u FROM long_residuals",
)


def _ranks(spark: SparkSession, path: str) -> DataFrame:
    long = _long_residuals(S.settle(S.residuals(pts(spark, path))))
    ranks = uncertainty.copula_ranks(long, "source_day", "hour_local", "target", "value")
    return ranks.withColumn("variable", F.format_string("%s_h%02d", F.regexp_replace("target", "_residual", ""), F.col("hour_local")))


@query(
    "e30_cross_target_summary", "target_pair:s mean_rank_correlation:f mean_abs_rank_correlation:f max_abs_rank_correlation:f",
    f"""WITH c AS ({_CORR_SQL.format(v='u', t='rank_library')}), p AS (SELECT split_part(variable_i, '_', 1) AS a, split_part(variable_j, '_', 1) AS b, correlation AS c FROM c)
      SELECT a || '__' || b AS target_pair, avg(c) AS mean_rank_correlation, avg(abs(c)) AS mean_abs_rank_correlation, max(abs(c)) AS max_abs_rank_correlation FROM p
      WHERE (a, b) IN (('pv', 'price'), ('pv', 'spread'), ('price', 'spread')) GROUP BY 1""",
)
def cross_target_summary(spark: SparkSession, path: str) -> DataFrame:
    matrix = metrics.correlation_matrix(S.settle(_ranks(spark, path)), "source_day", "variable", "u")
    first, other = F.split("variable_i", "_")[0], F.split("variable_j", "_")[0]
    return metrics.cross_target_summary(matrix, first, other, [("pv", "price"), ("pv", "spread"), ("price", "spread")])


@query(
    "e31_dependence_audit", "pairs:i correlation_rmse:f correlation_max_abs_error:f",
    f"""WITH smp AS (SELECT l.* EXCLUDE (source_day), s AS source_day FROM range(500) AS r(s) JOIN (SELECT *, dense_rank() OVER (ORDER BY source_day) - 1 AS pos FROM long_residuals) l ON l.pos = {draw_sql('s', '0', 3)} % (SELECT nullif(count(DISTINCT source_day), 0) FROM long_residuals)),
      a AS ({_CORR_SQL.format(v='value', t='long_residuals')}), b AS ({_CORR_SQL.format(v='value', t='smp')})
      SELECT count(*) AS pairs, sqrt(avg((a.correlation - b.correlation) ^ 2)) AS correlation_rmse, max(abs(a.correlation - b.correlation)) AS correlation_max_abs_error FROM a JOIN b USING (variable_i, variable_j)""",
)
def dependence_audit(spark: SparkSession, path: str) -> DataFrame:
    """Correlations of 500 sampled days against the library's."""
    lib = S.settle(_long_residuals(S.residuals(pts(spark, path))))
    target = spark.range(1).select(F.lit("1970-01-01").cast("date").alias("anchor"))
    # the anchor lies after no library day, so positions are taken over the whole library
    days = lib.select("source_day").distinct()
    positions = uncertainty.eligible_positions(target.withColumnRenamed("anchor", "day"), days, "day").filter("_lib = 1").select(
        F.col("_d").alias("source_day"), F.col("n_eligible").alias("pos")
    )
    total = days.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(500).select(F.col("id").alias("scenario_id")).withColumn("pos", N.draw_index(F.col("scenario_id"), F.lit(0), 3, total))
    sampled = draws.join(positions, "pos").join(lib, "source_day").drop("source_day").withColumnRenamed("scenario_id", "source_day")
    return metrics.dependence_error(
        metrics.correlation_matrix(lib, "source_day", "variable", "value"), metrics.correlation_matrix(sampled, "source_day", "variable", "value")
    )


@query(
    "e39_source_audit", "rows:i first_time:t last_time:t duplicate_stamps:i column_name:s missing:i",
    """WITH s AS (SELECT date_trunc('minute', ts) AS t, value, CASE WHEN value > 5 THEN user_id END AS user_id FROM events),
      a AS (SELECT count(*) AS rows, min(t) AS first_time, max(t) AS last_time, count(*) - count(DISTINCT t) AS duplicate_stamps, count(*) FILTER (WHERE value IS NULL) AS mv, count(*) FILTER (WHERE user_id IS NULL) AS mu FROM s)
      SELECT rows, first_time, last_time, duplicate_stamps, 'value' AS column_name, mv AS missing FROM a UNION ALL SELECT rows, first_time, last_time, duplicate_stamps, 'user_id', mu FROM a""",
)
def source_audit(spark: SparkSession, path: str) -> DataFrame:
    rows = S.table(spark, path, "events", "ts", "value", "user_id").select(
        F.date_trunc("minute", "ts").alias("t"), "value", F.when(F.col("value") > 5, F.col("user_id")).alias("user_id")
    )
    return audit.source_audit(rows, "t", ["value", "user_id"])


_ZERO_SQL = "SELECT event_type AS site_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2 HAVING max(greatest(value - 200, 0)) = 0"


@query("e40_zero_days", "site_id:s day:d", _ZERO_SQL)
def zero_days(spark: SparkSession, path: str) -> DataFrame:
    """Site days without any reading above 200."""
    rows = S.readings(spark, path).select("site_id", F.to_date("ts").alias("day"), N.clip(F.col("value") - 200.0, 0.0).alias("v"))
    return audit.zero_days(rows, ["site_id"], "day", "v")


@query("e40_shared_zero_days", "day:d profiles:i", f"SELECT day, count(*) AS profiles FROM ({_ZERO_SQL}) GROUP BY 1 HAVING count(*) >= 2")
def shared_zero_days(spark: SparkSession, path: str) -> DataFrame:
    return audit.shared_zero_days(zero_days(spark, path), "day")


@query(
    "e41_monthly_coverage", "month:d rows_F:i rows_O:i rows_P:i",
    """WITH c AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS s FROM orders), sp AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM c)
      SELECT sp.month, count(*) FILTER (WHERE s = 'F') AS rows_F, count(*) FILTER (WHERE s = 'O') AS rows_O, count(*) FILTER (WHERE s = 'P') AS rows_P FROM sp LEFT JOIN c USING (month) GROUP BY 1""",
)
def monthly_coverage(spark: SparkSession, path: str) -> DataFrame:
    return audit.monthly_coverage(S.table(spark, path, "orders", "o_orderdate", "o_orderstatus"), "o_orderstatus", "o_orderdate", ["F", "O", "P"])


@query(
    "e41_step_histogram", "site_id:s step_seconds:i rows:i",
    "SELECT site_id, step AS step_seconds, count(*) AS rows FROM (SELECT site_id, date_diff('second', lag(valid_time_utc) OVER (PARTITION BY site_id ORDER BY valid_time_utc), valid_time_utc) AS step FROM site_hours) WHERE step IS NOT NULL GROUP BY ALL",
)
def step_histogram(spark: SparkSession, path: str) -> DataFrame:
    return audit.step_histogram(S.settle(S.site_hours(spark, path)), ["site_id"], "valid_time_utc")


@query(
    "e42_location_quality", "location_id:s rows:i missing_value:i availability_rate:f complete_days:i first_complete_day:d last_complete_day:d",
    """WITH r AS (SELECT site_id, CAST(valid_time_utc AS DATE) AS day, CASE WHEN n >= 2 THEN value END AS value FROM site_hours), d AS (SELECT site_id, day, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS m, bool_and(value IS NOT NULL) AS a FROM r GROUP BY ALL)
      SELECT site_id AS location_id, sum(n) AS rows, sum(m) AS missing_value, (sum(n) - sum(m)) / sum(n) AS availability_rate, count(*) FILTER (WHERE a) AS complete_days, min(day) FILTER (WHERE a) AS first_complete_day, max(day) FILTER (WHERE a) AS last_complete_day FROM d GROUP BY 1""",
)
def location_quality(spark: SparkSession, path: str) -> DataFrame:
    rows = S.site_hours(spark, path).select(
        F.col("site_id").alias("location_id"), F.to_date("valid_time_utc").alias("day"), F.when(F.col("n") >= 2, F.col("value")).alias("value")
    ).withColumn("usable", F.col("value").isNotNull())
    return audit.location_quality(rows, "location_id", "day", ["value"], "usable")


@query(
    "e43_weighted_scale", "site_id:s weighted_mean:f scale:f",
    """WITH m AS (SELECT site_id, sum(n * value) / sum(n) AS mu, stddev_pop(value) AS g FROM site_hours GROUP BY 1)
      SELECT site_id, mu AS weighted_mean, greatest(sqrt(sum(n * (value - mu) ^ 2) / sum(n)), 0.1 * max(g), 1e-6) AS scale FROM site_hours JOIN m USING (site_id) GROUP BY ALL""",
)
def weighted_scale(spark: SparkSession, path: str) -> DataFrame:
    """Reading-count weighted mean and floored scale of each site."""
    mean, std = uncertainty.weighted_scale(F.col("value"), F.col("n"))
    return S.site_hours(spark, path).groupBy("site_id").agg(
        mean.alias("weighted_mean"), uncertainty.floored_scale(std, F.stddev_pop("value")).alias("scale")
    )


@query(
    "e45_archive_metadata", "rows:i runs:i locations:i null_forecast:i",
    "SELECT count(*) AS rows, count(DISTINCT run_init_utc) AS runs, count(DISTINCT location_id) AS locations, count(*) FILTER (WHERE forecast > 200) AS null_forecast FROM forecast_archive",
)
def archive_metadata(spark: SparkSession, path: str) -> DataFrame:
    rows = S.forecast_archive(spark, path).withColumn("forecast", F.when(F.col("forecast") <= 200, F.col("forecast")))
    return audit.archive_metadata(rows, "run_init_utc", "location_id", ["forecast"])

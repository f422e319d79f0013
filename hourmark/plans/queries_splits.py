"""Queries for splits and evaluation protocols that SQL can state (I-01..I-05, I-08, I-12, I-15, I-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.operators import metrics, splits, uncertainty
from hourmark.params import QUANTILE_LEVELS
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_metrics import draw_sql, pts

sql_view(
    "shuffled_weeks",
    f"SELECT *, row_number() OVER (PARTITION BY season ORDER BY {draw_sql('week_index', '0', 42)}, week_index) - 1 AS position, count(*) OVER (PARTITION BY season) AS size FROM weeks",
)
_SHARE = "greatest(1, round_even(size * 0.15, 0))"


def _weeks(spark: SparkSession, path: str) -> DataFrame:
    return splits.week_table(S.order_clock(spark, path).select("valid_time_utc"), "valid_time_utc")


@query("i01_seasonal_split", "week_index:i season:s split:s",
       f"SELECT week_index, season, CASE WHEN position < {_SHARE} THEN 'test' WHEN position < 2 * {_SHARE} THEN 'validation' ELSE 'train' END AS split FROM shuffled_weeks")
def seasonal_split(spark: SparkSession, path: str) -> DataFrame:
    """70/15/15 by whole weeks in every season."""
    return splits.seasonal_split(_weeks(spark, path))


@query("i01_split_rows", "split:s weeks:i orders:i",
       f"SELECT CASE WHEN position < {_SHARE} THEN 'test' WHEN position < 2 * {_SHARE} THEN 'validation' ELSE 'train' END AS split, count(*) AS weeks, sum(orders) AS orders FROM shuffled_weeks GROUP BY 1")
def split_rows(spark: SparkSession, path: str) -> DataFrame:
    """Row counts after joining the split back: whole weeks stay together."""
    rows = S.order_clock(spark, path).select("valid_time_utc").withColumn("week_start", splits.week_start(F.col("valid_time_utc")))
    counts = rows.groupBy("week_start").agg(F.count(F.lit(1)).alias("orders"))
    labelled = splits.seasonal_split(_weeks(spark, path)).join(counts, "week_start")
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("weeks"), F.sum("orders").alias("orders"))


@query("i02_seasonal_folds", "week_index:i season:s fold:i",
       "SELECT week_index, season, (position + CASE season WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END) % 5 AS fold FROM shuffled_weeks")
def seasonal_folds(spark: SparkSession, path: str) -> DataFrame:
    """Five folds by whole weeks, round-robin inside each season."""
    return splits.seasonal_folds(_weeks(spark, path), 5)


@query(
    "i03_rolling_origin", "delivery_date_local:d fold:i cutoff:d",
    """WITH d AS (SELECT delivery_date_local, row_number() OVER (ORDER BY delivery_date_local) - 1 AS i FROM (SELECT DISTINCT delivery_date_local FROM market))
      SELECT delivery_date_local, (i - 10) // 5 AS fold, min(delivery_date_local) OVER (PARTITION BY (i - 10) // 5) AS cutoff FROM d WHERE i >= 10""",
)
def rolling_origin(spark: SparkSession, path: str) -> DataFrame:
    """Ten initial days, then blocks of five."""
    return splits.rolling_origin(S.market(spark, path), "delivery_date_local", 10, 5)


@query(
    "i03_rolling_rows", "fold:i part:s rows:i first_day:d last_day:d",
    """WITH d AS (SELECT delivery_date_local, row_number() OVER (ORDER BY delivery_date_local) - 1 AS i FROM (SELECT DISTINCT delivery_date_local FROM market)),
        f AS (SELECT delivery_date_local AS day, (i - 10) // 5 AS fold, min(delivery_date_local) OVER (PARTITION BY (i - 10) // 5) AS cutoff FROM d WHERE i >= 10), c AS (SELECT DISTINCT fold, cutoff FROM f),
        r AS (SELECT fold, 'train' AS part, delivery_date_local FROM market JOIN c ON delivery_date_local < cutoff UNION ALL SELECT fold, 'test', delivery_date_local FROM market JOIN f ON day = delivery_date_local)
      SELECT fold, part, count(*) AS rows, min(delivery_date_local) AS first_day, max(delivery_date_local) AS last_day FROM r GROUP BY 1, 2""",
)
def rolling_rows(spark: SparkSession, path: str) -> DataFrame:
    """Train rows strictly before each cutoff and the block's test rows."""
    hourly = S.settle(S.market(spark, path))
    folds = S.settle(splits.rolling_origin(hourly, "delivery_date_local", 10, 5))
    rows = splits.rolling_origin_rows(hourly, folds, "delivery_date_local")
    return rows.groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("delivery_date_local").alias("first_day"), F.max("delivery_date_local").alias("last_day")
    )


@query(
    "i04_expanding_months", "refit_month:d part:s rows:i value:f",
    """WITH m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)) + INTERVAL 1 MONTH, date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS refit_month FROM orders)
      SELECT refit_month, CASE WHEN o_orderdate < refit_month THEN 'train' ELSE 'test' END AS part, count(*) AS rows, avg(o_totalprice / 1000) AS value FROM orders JOIN m ON o_orderdate < refit_month + INTERVAL 1 MONTH GROUP BY 1, 2""",
)
def expanding_months(spark: SparkSession, path: str) -> DataFrame:
    """Refit every month of the table but the first on everything before it, test on the month."""
    rows = S.table(spark, path, "orders", "o_orderdate", "o_totalprice").withColumn("day", F.to_date("o_orderdate"))
    daily = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") / 1000.0).alias("s"))
    daily = S.settle(daily.dropna(subset=["day"]))
    bounds = daily.agg(F.add_months(F.trunc(F.min("day"), "month"), 1).cast("string"), F.trunc(F.max("day"), "month").cast("string")).first()
    if bounds[0] is None or bounds[0] > bounds[1]:
        return daily.limit(0).select(F.col("day").alias("refit_month"), F.lit("").alias("part"), F.col("n").alias("rows"), F.col("s").alias("value"))
    parts = splits.expanding_months(daily, "day", bounds[0], bounds[1])
    return parts.groupBy("refit_month", "part").agg(F.sum("n").alias("rows"), (F.sum("s") / F.sum("n")).alias("value"))


@query("i05_chronological_holdout", "part:s orders:i first_day:d last_day:d",
       "SELECT CASE WHEN o_orderdate <= DATE '1998-12-31' THEN 'train' ELSE 'test' END AS part, count(*) AS orders, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def chronological_holdout(spark: SparkSession, path: str) -> DataFrame:
    rows = S.table(spark, path, "orders", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    parts = splits.chronological_split(rows, "day", "1998-12-31", "1999-01-01")
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_NAMES = {f"q{round(level * 100):02d}": level for level in QUANTILE_LEVELS}


@query(
    "i08_conditional_quantiles", "hour_local:i day_type:s " + " ".join(f"{n}:f" for n in _NAMES),
    f"""WITH r AS (SELECT hour_local, CASE WHEN isodow(source_day) >= 6 THEN 'weekend' ELSE 'workday' END AS day_type, price_residual AS v FROM residuals),
        f AS (SELECT hour_local, day_type, count(*) AS n, {', '.join(f'quantile_cont(v, {q!r}) AS own_{n}' for n, q in _NAMES.items())} FROM r GROUP BY 1, 2),
        g AS (SELECT hour_local, {', '.join(f'quantile_cont(v, {q!r}) AS all_{n}' for n, q in _NAMES.items())} FROM r GROUP BY 1)
      SELECT hour_local, day_type, {', '.join(f'CASE WHEN n >= 10 THEN own_{n} ELSE all_{n} END AS {n}' for n in _NAMES)} FROM f JOIN g USING (hour_local)""",
)
def conditional_quantiles(spark: SparkSession, path: str) -> DataFrame:
    """Empirical residual quantiles by hour and day type, by hour alone when thin."""
    from hourmark.functions.calendar import day_type

    lib = S.settle(S.residuals(pts(spark, path)).withColumn("day_type", day_type(F.col("source_day"))))
    return uncertainty.grouped_residual_quantiles(lib, ["hour_local", "day_type"], ["hour_local"], "price_residual", list(_NAMES.values()), list(_NAMES), 10)


@query(
    "i12_model_frame", "site_id:s valid_time_utc:t target:f f24:f oracle:f",
    "SELECT s.site_id, s.valid_time_utc, s.value AS target, l.f24_da_price AS f24, m.id_price AS oracle FROM site_hours s LEFT JOIN layered_forecasts l USING (valid_time_utc) LEFT JOIN market m USING (valid_time_utc) WHERE l.f24_da_price IS NOT NULL AND l.f24_pv_kwh IS NOT NULL AND m.id_price IS NOT NULL",
)
def model_frame(spark: SparkSession, path: str) -> DataFrame:
    """Forecast and actual features joined one-to-one to the targets, complete cases only."""
    hourly = S.settle(S.market(spark, path))
    layers = S.layered_forecasts(hourly).select("valid_time_utc", F.col("f24_da_price").alias("f24"), "f24_pv_kwh")
    rows = S.site_hours(spark, path).select("site_id", "valid_time_utc", F.col("value").alias("target"))
    joined = rows.join(layers, "valid_time_utc", "left").join(hourly.select("valid_time_utc", F.col("id_price").alias("oracle")), "valid_time_utc", "left")
    return joined.dropna(subset=["f24", "f24_pv_kwh", "oracle"])


_WEIGHTS = [i / 20 for i in range(21)]


@query(
    "i15_blend_grid", "weight:f rows:i mae:f rmse:f",
    f"SELECT weight, count(*) AS rows, avg(abs(id_price - p)) AS mae, sqrt(avg((id_price - p) ^ 2)) AS rmse FROM (SELECT id_price, w AS weight, da_price + w * (id_price_point - da_price) AS p FROM points, (SELECT unnest({_WEIGHTS}) AS w)) GROUP BY 1",
)
def blend_grid(spark: SparkSession, path: str) -> DataFrame:
    """Validation error of every blend weight in one job."""
    return metrics.blend_grid(pts(spark, path), "id_price", "da_price", "id_price_point", _WEIGHTS)


@query(
    "i16_standardised", "valid_time_utc:t z_price:f z_pv:f",
    f"WITH t AS (SELECT avg(da_price) AS m, stddev_pop(da_price) AS s, avg(pv_kwh) AS mp, stddev_pop(pv_kwh) AS sp FROM market WHERE delivery_date_local <= {S.cut_day_sql('market', (2, 3))}) SELECT valid_time_utc, (da_price - m) / s AS z_price, (pv_kwh - mp) / sp AS z_pv FROM market, t",
)
def standardised(spark: SparkSession, path: str) -> DataFrame:
    """Scaling fitted on training rows only, applied to all."""
    hourly = S.settle(S.market(spark, path))
    train = hourly.filter(F.col("delivery_date_local") <= S.cut_day(hourly, "delivery_date_local", (2, 3)))
    m = train.agg(F.struct(F.avg("da_price").alias("m"), F.stddev_pop("da_price").alias("s"), F.avg("pv_kwh").alias("mp"), F.stddev_pop("pv_kwh").alias("sp")).alias("x")).scalar()
    rows = hourly.withColumn("_m", m)
    return rows.select(
        "valid_time_utc", ((F.col("da_price") - F.col("_m.m")) / F.col("_m.s")).alias("z_price"), ((F.col("pv_kwh") - F.col("_m.mp")) / F.col("_m.sp")).alias("z_pv")
    )



"""Queries for models fitted from fold sums: quantile learner (I-08), one-pass cross-fitting (I-09, I-11, I-14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import features as feats
from hourmark.operators import fitting, metrics, ranking, shaping, splits
from hourmark.params import QUANTILE_LEVELS
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_metrics import pts

FOLDS = 5
_NAMES = {f"q{round(level * 100):02d}": level for level in QUANTILE_LEVELS}
QUANTILE_FEATURES = ["da_price_point", "id_price_point", "pv_kwh_point", "hour_sin", "hour_cos", "weekend"]
#: Largest distance between a level and the share of actuals at or below its out-of-fold quantile.
COVERED = 0.08


def _residual_frame(spark: SparkSession, path: str) -> DataFrame:
    """Working-hour price residuals with what is known at the decision, in whole-week folds."""
    known = S.settle(pts(spark, path))
    library = S.residuals(known).select("source_day", "hour_local", "price_residual")
    rows = library.join(known.withColumnRenamed("delivery_date_local", "source_day"), ["source_day", "hour_local"])
    turn = F.col("hour_local") * F.lit(2 * 3.141592653589793 / 24)
    rows = rows.withColumns({"hour_sin": F.sin(turn), "hour_cos": F.cos(turn), "day_type": C.day_type(F.col("source_day"))})
    rows = rows.withColumn("weekend", (F.col("day_type") == "weekend").cast("double")).withColumn("week_start", splits.week_start(F.col("valid_time_utc")))
    weeks = splits.seasonal_folds(splits.week_table(known, "valid_time_utc"), FOLDS).select("week_start", "fold")
    return S.settle(rows.join(F.broadcast(weeks), "week_start"))  # one row per calendar week


def _grouped_out_of_fold(rows: DataFrame) -> DataFrame:
    """The grouped empirical quantiles of the other folds, as a row per (fold, hour, day type)."""
    others = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).filter(F.col("held") != F.col("fold"))
    return ranking.exact_quantiles(others, ["held", "hour_local", "day_type"], "price_residual", list(_NAMES.values()), [f"g_{n}" for n in _NAMES]).withColumnRenamed("held", "fold")


@query(
    "i08_quantile_learner", "level:f rows:i crossings:i covered:s beats_groups:s",
    f"SELECT level, rows, 0 AS crossings, 'yes' AS covered, 'yes' AS beats_groups FROM (SELECT unnest({list(QUANTILE_LEVELS)}) AS level), (SELECT count(*) AS rows FROM residuals) WHERE rows > 0",
)
def quantile_learner(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold quantiles of a learner: rows, crossings, coverage per level, and pinball loss against grouped quantiles."""
    rows = _residual_frame(spark, path)
    model = fitting.quantile_fits(rows, "fold", QUANTILE_FEATURES, "price_residual", list(QUANTILE_LEVELS))
    scored = rows.withColumn("_q", model.columns("fold"))
    both = scored.join(_grouped_out_of_fold(rows), ["fold", "hour_local", "day_type"], "left")
    items = [
        F.struct(
            F.lit(level).alias("level"), F.col("_q")[k].alias("own"), F.col(f"g_{name}").alias("grouped"),
            (F.col("_q")[k] < F.col("_q")[k - 1] if k else F.lit(False)).cast("int").alias("crossed"),
        )
        for k, (name, level) in enumerate(_NAMES.items())
    ]
    long = both.select(F.col("price_residual").alias("y"), F.inline(F.array(*items)))
    loss = lambda c: F.avg(F.when(F.col("grouped").isNotNull(), metrics.pinball(F.col("y"), F.col(c), F.col("level"))))
    by_level = S.settle(long.groupBy("level").agg(
        F.count("own").alias("rows"), F.sum("crossed").alias("crossings"), F.avg((F.col("y") <= F.col("own")).cast("double")).alias("below"),
        loss("own").alias("own_loss"), loss("grouped").alias("grouped_loss"),
    ))
    total = by_level.agg(F.struct(F.sum("own_loss").alias("own"), F.sum("grouped_loss").alias("grouped"))).scalar()
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return by_level.withColumn("_t", total).select(
        "level", "rows", "crossings", yes(F.abs(F.col("below") - F.col("level")) <= COVERED).alias("covered"), yes(F.col("_t.own") < F.col("_t.grouped")).alias("beats_groups")
    )


sql_view(
    "order_totals",
    "SELECT o_orderdate AS valid_time_utc, sum(o_totalprice) / 1e6 AS value, CAST(count(*) AS DOUBLE) AS orders FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1",
)
sql_view(
    "order_frame",
    f"""SELECT d.*, a.value AS lag24, b.value AS lag168, d.value - b.value AS residual, a.value - c.value AS last_residual,
      (w.position + CASE w.season WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END) % {FOLDS} AS fold
    FROM order_totals d JOIN order_totals a ON a.valid_time_utc = d.valid_time_utc - INTERVAL 24 HOUR JOIN order_totals b ON b.valid_time_utc = d.valid_time_utc - INTERVAL 168 HOUR
    JOIN order_totals c ON c.valid_time_utc = d.valid_time_utc - INTERVAL 192 HOUR
    JOIN shuffled_weeks w ON w.week_start = date_trunc('week', {S.berlin('d.valid_time_utc')})::DATE""",
)


def order_frame(spark: SparkSession, path: str) -> DataFrame:
    """Daily order value with lags, the residual of the weekly persistence and the last one known, in whole-week folds."""
    orders = S.table(spark, path, "orders", "o_orderkey", "o_orderdate", "o_totalprice").dropna(subset=["o_orderdate"])
    clock = orders.withColumn("valid_time_utc", F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int")))
    # one aggregation per day carries the sums and the clock's first and last stamp, so the orders are read once
    days = S.settle(clock.groupBy(F.col("o_orderdate").alias("day")).agg(
        (F.sum("o_totalprice") / 1e6).alias("value"), F.count(F.lit(1)).cast("double").alias("orders"), F.min("valid_time_utc").alias("first"), F.max("valid_time_utc").alias("last")
    ))
    stamps = days.select(F.explode(F.array("first", "last")).alias("valid_time_utc"))
    weeks = splits.seasonal_folds(splits.week_table(stamps, "valid_time_utc"), FOLDS).select("week_start", "fold")
    daily = days.select(F.col("day").alias("valid_time_utc"), "value", "orders")
    rows = feats.hour_lags(daily, [], "valid_time_utc", ["value"], [24, 168, 192], names="lag{lag}").dropna(subset=["lag24", "lag168", "lag192"])
    rows = rows.withColumns({"residual": F.col("value") - F.col("lag168"), "last_residual": F.col("lag24") - F.col("lag192"), "week_start": splits.week_start(F.col("valid_time_utc"))})
    return S.settle(rows.join(F.broadcast(weeks), "week_start"))  # one row per calendar week


_ONE = "SELECT f, regr_slope({y}, {x}) AS b1, 0.0 AS b2, regr_intercept({y}, {x}) AS b0 FROM order_frame, range({k}) AS t(f) WHERE fold <> f GROUP BY f"
_TWO = """SELECT f, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM (SELECT f, m1, m2, my, (v2 * c1 - c12 * c2) / (v1 * v2 - c12 * c12) AS b1, (v1 * c2 - c12 * c1) / (v1 * v2 - c12 * c12) AS b2
  FROM (SELECT f, avg({x}) AS m1, avg({z}) AS m2, avg({y}) AS my, var_pop({x}) AS v1, var_pop({z}) AS v2, covar_pop({x}, {z}) AS c12, covar_pop({x}, {y}) AS c1, covar_pop({z}, {y}) AS c2
    FROM order_frame, range({k}) AS t(f) WHERE fold <> f GROUP BY f))"""


@query(
    "i09_one_pass_cross_fit", "fold:i rows:i intercept:f slope:f mae:f rmse:f",
    f"""WITH fits AS ({_ONE.format(y='value', x='lag168', k=FOLDS)})
      SELECT fold, count(*) AS rows, b0 AS intercept, b1 AS slope, avg(abs(value - b0 - b1 * lag168)) AS mae, sqrt(avg((value - b0 - b1 * lag168) ^ 2)) AS rmse FROM order_frame JOIN fits ON f = fold GROUP BY ALL""",
)
def one_pass_cross_fit(spark: SparkSession, path: str) -> DataFrame:
    """Every leave-one-fold-out model from one aggregation; its coefficients and out-of-fold errors."""
    rows = order_frame(spark, path)
    fits = fitting.leave_one_out_fits(fitting.fold_sums(rows, "fold", ["lag168"], "value"), ["lag168"])
    scored = fitting.predicted(rows, fits, "fold", "p")
    pick = lambda i: reduce(lambda a, kv: F.when(F.col("fold") == kv[0], F.lit(kv[1].values[i])).otherwise(a), fits.items(), F.lit(None).cast("double"))
    error = F.col("value") - F.col("p")
    out = scored.groupBy("fold").agg(F.count("p").alias("rows"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return out.withColumns({"intercept": pick(0), "slope": pick(1)})


@query(
    "i11_one_pass_correction", "variant:s rows:i mae:f rmse:f",
    f"""WITH fits AS ({_TWO.format(y='residual', x='last_residual', z='lag24', k=FOLDS)}),
      p AS (SELECT value, lag168 AS baseline, greatest(lag168 + last_residual, 0) AS persistence, greatest(lag168 + b0 + b1 * last_residual + b2 * lag24, 0) AS direct FROM order_frame JOIN fits ON f = fold)
      SELECT variant, count(*) AS rows, avg(abs(value - x)) AS mae, sqrt(avg((value - x) ^ 2)) AS rmse FROM (UNPIVOT p ON baseline, persistence, direct INTO NAME variant VALUE x) GROUP BY 1""",
)
def one_pass_correction(spark: SparkSession, path: str) -> DataFrame:
    """Baseline, persisted residual and a cross-fitted residual model on identical rows, fitted in one scan."""
    rows = order_frame(spark, path)
    scored = fitting.cross_fit_linear(rows, "fold", ["last_residual", "lag24"], "residual", "correction")
    scored = scored.withColumns({
        "baseline": F.col("lag168"), "persistence": F.greatest(F.col("lag168") + F.col("last_residual"), F.lit(0.0)),
        "direct": F.greatest(F.col("lag168") + F.col("correction"), F.lit(0.0)),
    })
    long = shaping.melt(scored, ["valid_time_utc", "value"], {c: c for c in ("baseline", "persistence", "direct")})
    return metrics.point_metrics(long, ["variant"], "value", "prediction")


_SETS = {"week": ["lag168"], "week_and_day": ["lag168", "lag24"]}


@query(
    "i14_one_pass_ablation", "variant:s protocol:s rows:i mae:f rmse:f",
    f"""WITH cut AS (SELECT quantile_disc(valid_time_utc, 0.7) AS c FROM order_frame),
      one AS ({_ONE.format(y='value', x='lag168', k=FOLDS)}), two AS ({_TWO.format(y='value', x='lag168', z='lag24', k=FOLDS)}),
      held AS (SELECT value, lag168, lag24, r.* FROM order_frame, cut, (SELECT regr_slope(value, lag168) AS s1, regr_intercept(value, lag168) AS s0, avg(lag168) AS m1, avg(lag24) AS m2, avg(value) AS my, var_pop(lag168) AS v1, var_pop(lag24) AS v2,
          covar_pop(lag168, lag24) AS c12, covar_pop(lag168, value) AS c1, covar_pop(lag24, value) AS c2 FROM order_frame, cut WHERE valid_time_utc <= c) r WHERE valid_time_utc > c),
      solved AS (SELECT *, (v2 * c1 - c12 * c2) / (v1 * v2 - c12 * c12) AS t1, (v1 * c2 - c12 * c1) / (v1 * v2 - c12 * c12) AS t2 FROM held),
      e AS (SELECT 'week' AS variant, 'week_cv' AS protocol, value - b0 - b1 * lag168 AS x FROM order_frame JOIN one ON f = fold UNION ALL SELECT 'week_and_day', 'week_cv', value - b0 - b1 * lag168 - b2 * lag24 FROM order_frame JOIN two ON f = fold
        UNION ALL SELECT 'week', 'holdout', value - s0 - s1 * lag168 FROM solved UNION ALL SELECT 'week_and_day', 'holdout', value - my - t1 * (lag168 - m1) - t2 * (lag24 - m2) FROM solved)
      SELECT variant, protocol, count(*) AS rows, avg(abs(x)) AS mae, sqrt(avg(x ^ 2)) AS rmse FROM e GROUP BY 1, 2""",
)
def one_pass_ablation(spark: SparkSession, path: str) -> DataFrame:
    """Feature sets under a chronological holdout and pooled week folds; the cut comes from the data (70 % of the days)."""
    rows = order_frame(spark, path)
    place = F.ceil(F.col("n_total") * F.lit(0.7))
    cut = ranking.order_statistic(rows.withColumn("_t", F.unix_micros("valid_time_utc").cast("double")), [], "_t", place).select("value").scalar()
    late = S.settle(rows.withColumn("late", (F.unix_micros("valid_time_utc") > cut).cast("int")))
    parts = []
    for name, columns in _SETS.items():
        sums = fitting.fold_sums(late, "late", columns, "value")
        if 0 not in sums:
            sums = {0: next(iter(sums.values()), fitting.np.zeros((len(columns) + 2,) * 2)) * 0}
        held = fitting.predicted(late.filter("late = 1"), {1: fitting.solve_sums(sums[0], columns)}, "late", "prediction")
        pooled = fitting.cross_fit_linear(late, "fold", columns, "value")
        for protocol, scored in (("holdout", held), ("week_cv", pooled)):
            parts.append(scored.select(F.lit(name).alias("variant"), F.lit(protocol).alias("protocol"), "value", "prediction"))
    return metrics.point_metrics(reduce(DataFrame.unionByName, parts), ["variant", "protocol"], "value", "prediction")


@query(
    "i14_huber_cross_fit", "fold:i rows:i close:s",
    "SELECT fold, count(*) AS rows, 'yes' AS close FROM order_frame GROUP BY 1",
)
def huber_cross_fit(spark: SparkSession, path: str) -> DataFrame:
    """Leave-one-fold-out Huber models, all reweighted in one scan per iteration: the median error stays below plain persistence's."""
    rows = order_frame(spark, path)
    columns = ["lag168", "lag24", "orders"]
    scored = fitting.predicted(rows, fitting.huber_fits(rows, "fold", columns, "value"), "fold", "p")
    out = scored.groupBy("fold").agg(F.count("p").alias("rows"), F.avg(F.abs(F.col("value") - F.col("p"))).alias("own"), F.avg(F.abs(F.col("value") - F.col("lag168"))).alias("base"))
    return out.withColumn("close", F.when(F.col("own") < F.col("base"), "yes").otherwise("no"))

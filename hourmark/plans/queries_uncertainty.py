"""Queries for scenarios and calibration (J-*, D-19, E-44, H-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.functions import numeric as N
from hourmark.operators import metrics, ranking, splits, uncertainty
from hourmark.params import QUANTILE_LEVELS
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_calendar import inverse_sql
from hourmark.plans.queries_metrics import _long_residuals, day_number_sql, draw_sql, pts

DAY, HOUR = "delivery_date_local", "hour_local"
N_SCENARIOS, SEED = 500, 11
TARGETS = {
    "pv": ("pv_kwh_point", "pv_residual"), "price": ("da_price_point", "price_residual"), "spread": ("spread_point", "spread_residual"),
}


def _working(points: DataFrame) -> DataFrame:
    return points.filter(F.col(HOUR).between(6, 21)).dropna(subset=["da_price_point", "pv_kwh_point", "spread_point"])


sql_view("working_points", "SELECT * FROM points WHERE hour_local BETWEEN 6 AND 21 AND da_price_point IS NOT NULL AND pv_kwh_point IS NOT NULL AND spread_point IS NOT NULL")
sql_view("library_days", "SELECT source_day, row_number() OVER (ORDER BY source_day) - 1 AS pos FROM (SELECT DISTINCT source_day FROM residuals)")
sql_view("target_days", "SELECT t.day, (SELECT count(*) FROM library_days l WHERE l.source_day < t.day) AS n FROM (SELECT DISTINCT delivery_date_local AS day FROM working_points) t")
sql_view("draws", f"SELECT t.day, s AS scenario_id, l.source_day FROM target_days t, range({N_SCENARIOS}) AS r(s) JOIN library_days l ON l.pos = {draw_sql('s', day_number_sql('t.day'), SEED)} % nullif(t.n, 0)")
sql_view(
    "eligible_means",
    "SELECT t.day, r.hour_local, avg(pv_residual) AS pv_c, avg(price_residual) AS price_c, avg(spread_residual) AS spread_c FROM target_days t JOIN residuals r ON r.source_day < t.day GROUP BY 1, 2",
)


def scenario_sql(centred: bool) -> str:
    shift = (lambda t: f" - m.{t}_c") if centred else (lambda t: "")
    return (
        "SELECT d.day AS delivery_date_local, d.scenario_id, p.hour_local, d.source_day,"
        f" least(greatest(p.pv_kwh_point + r.pv_residual{shift('pv')}, 0), 8) AS pv, p.da_price_point + r.price_residual{shift('price')} AS price, p.spread_point + r.spread_residual{shift('spread')} AS spread"
        " FROM draws d JOIN working_points p ON p.delivery_date_local = d.day JOIN residuals r ON r.source_day = d.source_day AND r.hour_local = p.hour_local JOIN eligible_means m ON m.day = d.day AND m.hour_local = p.hour_local"
    )


sql_view("raw_scenarios", scenario_sql(False))
sql_view("centred_scenarios", scenario_sql(True))


def _inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Settled working-hour points of the target days and the residual library."""
    return working_inputs(S.settle(pts(spark, path)))


def working_inputs(all_points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _working(all_points), S.settle(S.residuals(all_points))


def scenarios(spark: SparkSession, path: str, centre: bool) -> DataFrame:
    return scenarios_from(S.settle(pts(spark, path)), centre)


def scenarios_from(all_points: DataFrame, centre: bool) -> DataFrame:
    points, library = working_inputs(all_points)
    draws = uncertainty.sample_source_days(points, library, DAY, N_SCENARIOS, SEED)
    return uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, TARGETS, centre, {"pv": (0.0, 8.0)})


SCENARIO_SPEC = f"{DAY}:d scenario_id:i {HOUR}:i source_day:d pv:f price:f"


@query("j01_residual_library", f"fold:i source_day:d {HOUR}:i pv_residual:f price_residual:f spread_residual:f",
       """WITH d AS (SELECT source_day, row_number() OVER (ORDER BY source_day) - 1 AS i FROM (SELECT DISTINCT source_day FROM residuals))
         SELECT (i - 10) // 5 AS fold, r.* FROM residuals r JOIN d USING (source_day) WHERE i >= 10""")
def residual_library(spark: SparkSession, path: str) -> DataFrame:
    """Residuals of rolling-origin test blocks on complete days."""
    library = S.settle(S.residuals(pts(spark, path)))
    folds = splits.rolling_origin(library, "source_day", 10, 5)
    return library.join(folds, "source_day")


@query("j02_two_target_bootstrap", SCENARIO_SPEC, "SELECT * FROM raw_scenarios")
def two_target_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """PV and price from the same sampled residual day."""
    return scenarios(spark, path, False)


@query("j03_three_target_bootstrap", SCENARIO_SPEC + " spread:f", "SELECT * FROM centred_scenarios")
def three_target_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Three targets, centred on the mean residual of the eligible days."""
    return scenarios(spark, path, True)


@query(
    "d19_scenario_expansion", f"{DAY}:d scenario_id:i source_day:d hours:i price:f",
    "SELECT delivery_date_local, scenario_id, source_day, count(*) AS hours, avg(price) AS price FROM raw_scenarios GROUP BY 1, 2, 3",
)
def scenario_expansion(spark: SparkSession, path: str) -> DataFrame:
    """Each sampled day expands to its own hours."""
    return scenarios(spark, path, False).groupBy(DAY, "scenario_id", "source_day").agg(F.count(F.lit(1)).alias("hours"), F.avg("price").alias("price"))


@query("h08_scenario_rows", f"{DAY}:d scenario_id:i {HOUR}:i target:s value:f",
       "SELECT delivery_date_local, scenario_id, hour_local, unnest(['pv', 'price', 'intraday']) AS target, unnest([pv, price, price + spread]) AS value FROM raw_scenarios")
def scenario_rows(spark: SparkSession, path: str) -> DataFrame:
    """Long scenario rows; intraday price is day-ahead plus spread."""
    rows = scenarios(spark, path, False).withColumn("intraday", F.col("price") + F.col("spread"))
    return rows.unpivot([DAY, "scenario_id", HOUR], ["pv", "price", "intraday"], "target", "value")


BANDWIDTH, MIXTURE = 10.0, 0.2


def weights_sql(pairs: str) -> str:
    """SQL: seasonal probabilities of ``(day, source_day)`` pairs."""
    o = "dayofyear(make_date(2000, month({c}), day({c})))"
    a, b = o.format(c="source_day"), o.format(c="day")
    dist = f"least(abs({a} - {b}), 366 - abs({a} - {b}))"
    return f"SELECT day, source_day, {1 - MIXTURE!r} * k / sum(k) OVER (PARTITION BY day) + {MIXTURE!r} / count(*) OVER (PARTITION BY day) AS probability FROM (SELECT day, source_day, exp(-0.5 * ({dist} / {BANDWIDTH!r}) ^ 2) AS k FROM ({pairs}))"


sql_view("season_weights", weights_sql("SELECT t.day, l.source_day FROM target_days t JOIN library_days l ON l.source_day < t.day"))
sql_view("order_days", "SELECT DISTINCT o_orderdate::DATE AS source_day FROM orders")


@query("j04_seasonal_weights", f"{DAY}:d library_days:i total:f newest:f oldest:f largest:f",
       "SELECT day AS delivery_date_local, count(*) AS library_days, sum(probability) AS total, arg_max(probability, source_day) AS newest, arg_min(probability, source_day) AS oldest, max(probability) AS largest FROM ("
       + weights_sql("SELECT t.source_day AS day, o.source_day FROM order_days t JOIN order_days o ON o.source_day < t.source_day") + ") GROUP BY 1")
def seasonal_weights(spark: SparkSession, path: str) -> DataFrame:
    """Circular-calendar kernel weights of every order day over all earlier ones, summarised per day.

    Weights are held per calendar ordinal; the newest and oldest day find theirs by their own ordinal.
    """
    days = S.settle(S.table(spark, path, "orders", "o_orderdate").select(F.to_date("o_orderdate").alias("source_day")).distinct())
    weights = uncertainty.ordinal_weights(days.withColumnRenamed("source_day", DAY), days, DAY, BANDWIDTH, MIXTURE)
    earlier = Window.orderBy("source_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    ends = days.select(F.col("source_day").alias(DAY), F.max("source_day").over(earlier).alias("last"), F.min("source_day").over(earlier).alias("first"))
    p, n = F.col("probability"), F.col("days")
    at = lambda c: F.max(F.when(F.col("ordinal") == C.calendar_ordinal(F.col(c)), p))
    return weights.join(ends, DAY).groupBy(DAY).agg(
        F.sum(n).alias("library_days"), F.sum(n * p).alias("total"), at("last").alias("newest"), at("first").alias("oldest"), F.max(p).alias("largest"),
    )


def _weights(points: DataFrame, library: DataFrame) -> DataFrame:
    return uncertainty.seasonal_weights(points, library, DAY, BANDWIDTH, MIXTURE)


@query("e44_sampling_diagnostics", f"{DAY}:d eligible_days:i effective_sample_days:f maximum_day_probability:f minimum_day_probability:f",
       "SELECT day AS delivery_date_local, count(*) AS eligible_days, 1 / sum(probability ^ 2) AS effective_sample_days, max(probability) AS maximum_day_probability, min(probability) AS minimum_day_probability FROM season_weights GROUP BY 1")
def sampling_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    points, library = _inputs(spark, path)
    return uncertainty.ordinal_diagnostics(uncertainty.ordinal_weights(points, library, DAY, BANDWIDTH, MIXTURE), DAY)


sql_view(
    "seasonal_draws",
    f"""SELECT g.day, scenario_id, source_day FROM (SELECT day, s AS scenario_id, {draw_sql('s', day_number_sql('day'), 5)} / {N.DRAW_PRIME}.0 AS u FROM target_days, range({N_SCENARIOS}) AS r(s)) g JOIN (
        SELECT day, source_day, sum(probability) OVER w AS cum, sum(probability) OVER w - probability AS prev, row_number() OVER (PARTITION BY day ORDER BY o DESC, source_day DESC) AS last
        FROM (SELECT *, dayofyear(make_date(2000, month(source_day), day(source_day))) AS o FROM season_weights) WINDOW w AS (PARTITION BY day ORDER BY o, source_day ROWS UNBOUNDED PRECEDING)) c
      ON c.day = g.day AND u >= prev AND (u < cum OR last = 1)""",
)


@query(
    "j05_weighted_sampling", f"{DAY}:d scenario_id:i source_day:d",
    "SELECT day AS delivery_date_local, scenario_id, source_day FROM seasonal_draws",
)
def weighted_sampling(spark: SparkSession, path: str) -> DataFrame:
    """Draws with replacement by seasonal probability: the ordinal, then one of its days."""
    points, library = _inputs(spark, path)
    return uncertainty.sample_ordinals(uncertainty.ordinal_weights(points, library, DAY, BANDWIDTH, MIXTURE), library, DAY, N_SCENARIOS, 5)


_ORDINAL = "dayofyear(make_date(2000, month({c}), day({c})))"
_APART = f"abs({_ORDINAL.format(c='v.source_day')} - {_ORDINAL.format(c='w.source_day')})"
_SCALE = "greatest(sqrt(greatest(sum(p * pv_residual ^ 2) / sum(p) - (sum(p * pv_residual) / sum(p)) ^ 2, 0)), 0.1 * stddev_pop(pv_residual), 1e-6)"


sql_view(
    "adjusted_pv",
    f"""WITH near AS (SELECT w.day, w.source_day, v.source_day AS other, exp(-0.5 * (least({_APART}, 366 - {_APART}) / {BANDWIDTH!r}) ^ 2) AS k FROM season_weights w JOIN season_weights v ON v.day = w.day),
      own AS (SELECT day, source_day, other, {1 - MIXTURE!r} * k / sum(k) OVER (PARTITION BY day, source_day) + {MIXTURE!r} / count(*) OVER (PARTITION BY day, source_day) AS p FROM near),
      sc AS (SELECT day, own.source_day, hour_local, {_SCALE} AS scale FROM own JOIN residuals r ON r.source_day = own.other GROUP BY 1, 2, 3),
      ts AS (SELECT day, hour_local, {_SCALE} AS scale FROM (SELECT day, source_day, probability AS p FROM season_weights) JOIN residuals USING (source_day) GROUP BY 1, 2),
      u AS (SELECT w.day, w.source_day, r.hour_local, probability, pv_residual / sc.scale AS z FROM season_weights w JOIN residuals r USING (source_day) JOIN sc ON sc.day = w.day AND sc.source_day = w.source_day AND sc.hour_local = r.hour_local),
      c AS (SELECT day, hour_local, sum(probability * z) AS centre FROM u GROUP BY 1, 2)
      SELECT u.day AS delivery_date_local, source_day, u.hour_local, z AS standardised, (z - centre) * ts.scale AS adjusted FROM u JOIN c USING (day, hour_local) JOIN ts USING (day, hour_local)""",
)


@query(
    "j06_standardised_residuals", f"{DAY}:d source_day:d {HOUR}:i standardised:f adjusted:f",
    "SELECT * FROM adjusted_pv",
)
def standardised_residuals(spark: SparkSession, path: str) -> DataFrame:
    """PV residuals divided by their own season's scale, centred and rescaled to the target's season, from days before the target."""
    points, library = _inputs(spark, path)
    return uncertainty.standardise_residuals(library, _weights(points, library), DAY, HOUR, "pv_residual", BANDWIDTH, MIXTURE)


sql_view(
    "seasonal_scenarios",
    """SELECT p.delivery_date_local, d.scenario_id, p.hour_local, d.source_day, least(greatest(p.pv_kwh_point + a.adjusted, 0), 8) AS pv, p.da_price_point + r.price_residual - m.price_c AS price, p.spread_point + r.spread_residual - m.spread_c AS spread
    FROM seasonal_draws d JOIN working_points p ON p.delivery_date_local = d.day JOIN residuals r ON r.source_day = d.source_day AND r.hour_local = p.hour_local
    JOIN adjusted_pv a ON a.delivery_date_local = d.day AND a.source_day = d.source_day AND a.hour_local = p.hour_local
    JOIN (SELECT day, hour_local, sum(probability * price_residual) AS price_c, sum(probability * spread_residual) AS spread_c FROM season_weights JOIN residuals USING (source_day) GROUP BY 1, 2) m ON m.day = d.day AND m.hour_local = p.hour_local""",
)


def composed(points: DataFrame, library: DataFrame) -> DataFrame:
    """Three targets: seasonal draws, weighted centring, PV scaled from its own season to the target's and kept within the plant's range."""
    return uncertainty.seasonal_scenarios(points, library, DAY, HOUR, S.WORKING, TARGETS, ["pv_residual"], N_SCENARIOS, 5, BANDWIDTH, MIXTURE, {"pv": (0.0, 8.0)})


@query("j03_composed_three_target", SCENARIO_SPEC + " spread:f", "SELECT * FROM seasonal_scenarios")
def composed_three_target(spark: SparkSession, path: str) -> DataFrame:
    """Seasonal draws, standardisation and weighted centring in one generator."""
    return composed(*_inputs(spark, path))


@query("j07_copula_library", f"source_day:d {HOUR}:i target:s u:f", "SELECT source_day, hour_local, target, u FROM rank_library")
def copula_library(spark: SparkSession, path: str) -> DataFrame:
    long = _long_residuals(S.settle(S.residuals(pts(spark, path))))
    return uncertainty.copula_ranks(long, "source_day", HOUR, "target", "value")


def _price_quantiles(points: DataFrame) -> DataFrame:
    """Price, spread and PV marginals of each target hour as arrays on the nine levels."""
    q = N.sorted_quantiles(list(S.Q_COLUMNS))
    rows = S.quantile_forecasts(points)
    marginals = F.array(
        F.struct(F.lit("price_residual").alias("target"), q.alias("q")),
        F.struct(F.lit("spread_residual").alias("target"), F.transform(q, lambda v: v / 4.0).alias("q")),
        F.struct(F.lit("pv_residual").alias("target"), F.transform(q, lambda v: v / 10.0).alias("q")),
    )
    return rows.select(DAY, HOUR, F.inline(marginals))


@query(
    "j08_copula_sampling", f"{DAY}:d scenario_id:i {HOUR}:i target:s source_day:d u:f value:f",
    f"""WITH q AS (SELECT f.delivery_date_local, f.hour_local, list_sort([{', '.join(S.Q_COLUMNS)}]) AS q FROM quantile_forecasts f JOIN working_points USING (delivery_date_local, hour_local)),
      s AS (SELECT d.day AS delivery_date_local, d.scenario_id, k.hour_local, k.target, d.source_day, k.u, CASE k.target WHEN 'price_residual' THEN q.q WHEN 'pv_residual' THEN list_transform(q.q, lambda z: z / 10) ELSE list_transform(q.q, lambda z: z / 4) END AS qq
        FROM draws d JOIN rank_library k ON k.source_day = d.source_day JOIN q ON q.delivery_date_local = d.day AND q.hour_local = k.hour_local)
      SELECT delivery_date_local, scenario_id, hour_local, target, source_day, u, CASE target WHEN 'spread_residual' THEN greatest({inverse_sql('u', 'qq')}, -10) WHEN 'pv_residual' THEN least(greatest({inverse_sql('u', 'qq')}, 0), 8) ELSE {inverse_sql('u', 'qq')} END AS value FROM s""",
)
def copula_sampling(spark: SparkSession, path: str) -> DataFrame:
    """Joint ranks of one library day inverted through the target day's marginals."""
    points, library = _inputs(spark, path)
    ranks = S.settle(uncertainty.copula_ranks(_long_residuals(library), "source_day", HOUR, "target", "value"))
    draws = uncertainty.sample_source_days(points, library, DAY, N_SCENARIOS, SEED)
    return uncertainty.copula_scenarios(draws, ranks, _price_quantiles(points), DAY, HOUR, "target", QUANTILE_LEVELS, {"spread_residual": (-10.0, None), "pv_residual": (0.0, 8.0)})


LEVELS = list(QUANTILE_LEVELS)
PAIRS = uncertainty.central_pairs(LEVELS)
sql_view("fit_cut", f"SELECT {S.cut_day_sql('quantile_forecasts', (3, 5))} AS day")
sql_view("sorted_quantiles", f"SELECT delivery_date_local, hour_local, hour_local // 6 AS grp, da_price, list_sort([{', '.join(S.Q_COLUMNS)}]) AS q FROM quantile_forecasts")
sql_view(
    "conformal_scores",
    " UNION ALL ".join(
        f"SELECT grp, {LEVELS[i]} AS lo, {LEVELS[j]} AS hi, {i} AS pair, greatest(q[{i + 1}] - da_price, da_price - q[{j + 1}], 0) AS score, (da_price BETWEEN q[{i + 1}] AND q[{j + 1}])::INT AS inside FROM sorted_quantiles WHERE delivery_date_local <= (SELECT day FROM fit_cut)"
        for i, j in PAIRS
    ),
)
sql_view(
    "conformal_corrections",
    """SELECT grp, lo, hi, pair, n AS calibration_rows, raw_coverage, level AS score_quantile_level, max(score) FILTER (WHERE rn = ceil(round((n - 1) * level, 9)) + 1) AS correction
      FROM (SELECT *, least(1, ceil(round((n + 1) * round(hi - lo, 9), 9)) / n) AS level FROM
        (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY grp, pair) AS n, avg(inside) OVER (PARTITION BY grp, pair) AS raw_coverage FROM conformal_scores WINDOW w AS (PARTITION BY grp, pair ORDER BY score))) GROUP BY ALL""",
)


def _conformal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = S.settle(S.quantile_forecasts(pts(spark, path)).withColumn("grp", F.floor(F.col(HOUR) / 6)))
    fitted = uncertainty.conformal_fit(rows.filter(F.col(DAY) <= S.cut_day(rows, DAY, (3, 5))), "grp", "da_price", list(S.Q_COLUMNS), LEVELS)
    return rows, fitted


@query("j09_conformal_fit", "grp:i lower_quantile:f upper_quantile:f calibration_rows:i raw_coverage:f score_quantile_level:f correction:f",
       "SELECT grp, lo AS lower_quantile, hi AS upper_quantile, calibration_rows, raw_coverage, score_quantile_level, correction FROM conformal_corrections")
def conformal_fit(spark: SparkSession, path: str) -> DataFrame:
    """Widening per group and central pair from the finite-sample order statistic."""
    return _conformal(spark, path)[1]


_WIDE = {}
for _i, _j in PAIRS:
    _WIDE[_i] = f"q[{_i + 1}] - c{_i}"
    _WIDE[_j] = f"q[{_j + 1}] + c{_i}"
_ADJUSTED = ", ".join(_WIDE.get(i, f"q[{i + 1}]") for i in range(len(LEVELS)))
sql_view(
    "calibrated",
    f"SELECT delivery_date_local, hour_local, da_price, list_sort([{_ADJUSTED}]) AS z FROM sorted_quantiles JOIN (SELECT grp, "
    + ", ".join(f"max(correction) FILTER (WHERE pair = {i}) AS c{i}" for i, _ in PAIRS)
    + " FROM conformal_corrections GROUP BY 1) USING (grp)",
)


@query("j10_conformal_apply", f"{DAY}:d {HOUR}:i " + " ".join(f"{c}:f" for c in S.Q_COLUMNS),
       "SELECT delivery_date_local, hour_local, " + ", ".join(f"least(greatest(z[{i + 1}], -60), 120) AS {c}" for i, c in enumerate(S.Q_COLUMNS)) + " FROM calibrated WHERE delivery_date_local > (SELECT day FROM fit_cut)")
def conformal_apply(spark: SparkSession, path: str) -> DataFrame:
    """Widened, re-sorted, clipped quantiles of the later days."""
    rows, fitted = _conformal(spark, path)
    return uncertainty.conformal_apply(rows.filter(F.col(DAY) > S.cut_day(rows, DAY, (3, 5))), fitted, "grp", list(S.Q_COLUMNS), LEVELS, -60.0, 120.0)


@query("j10_calibrated_coverage", "kind:s rows:i coverage:f mean_width:f",
       "SELECT 'raw' AS kind, count(*) AS rows, avg((da_price BETWEEN q[2] AND q[8])::INT) AS coverage, avg(q[8] - q[2]) AS mean_width FROM sorted_quantiles WHERE delivery_date_local > (SELECT day FROM fit_cut)"
       " UNION ALL SELECT 'calibrated', count(*), avg((da_price BETWEEN z[2] AND z[8])::INT), avg(z[8] - z[2]) FROM calibrated WHERE delivery_date_local > (SELECT day FROM fit_cut)")
def calibrated_coverage(spark: SparkSession, path: str) -> DataFrame:
    """P10-P90 coverage before and after calibration."""
    rows, fitted = _conformal(spark, path)
    later = rows.filter(F.col(DAY) > S.cut_day(rows, DAY, (3, 5)))
    repaired = later.withColumn("_q", N.sorted_quantiles(list(S.Q_COLUMNS))).withColumns({"price_q10": F.col("_q")[1], "price_q90": F.col("_q")[7]})
    calibrated = uncertainty.conformal_apply(later, S.settle(fitted), "grp", list(S.Q_COLUMNS), LEVELS)
    both = [
        metrics.interval_scores(df, [], "da_price", "price_q10", "price_q90").withColumn("kind", F.lit(name))
        for name, df in (("raw", repaired), ("calibrated", calibrated))
    ]
    return both[0].unionByName(both[1])


@query(
    "j11_quantile_frames", f"fold:i {DAY}:d {HOUR}:i da_price:f price_q10:f price_q50:f price_q90:f spread_q50:f",
    """WITH d AS (SELECT delivery_date_local, row_number() OVER (ORDER BY delivery_date_local) - 1 AS i FROM (SELECT DISTINCT delivery_date_local FROM points)), f AS (SELECT delivery_date_local, (i - 10) // 5 AS fold, min(delivery_date_local) OVER (PARTITION BY (i - 10) // 5) AS cutoff FROM d WHERE i >= 10),
      s AS (SELECT fold, hour_local, median(spread - spread_point) AS m FROM points JOIN (SELECT DISTINCT fold, cutoff FROM f) ON delivery_date_local < cutoff GROUP BY 1, 2)
      SELECT fold, delivery_date_local, hour_local, da_price, price_q10, price_q50, price_q90, spread_point + m AS spread_q50 FROM quantile_forecasts JOIN f USING (delivery_date_local) JOIN s USING (fold, hour_local)""",
)
def quantile_frames(spark: SparkSession, path: str) -> DataFrame:
    """Rolling price quantiles with actuals, plus spread medians learned before each fold."""
    points = S.settle(pts(spark, path))
    folds = S.settle(splits.rolling_origin(points, DAY, 10, 5))
    rows = splits.rolling_origin_rows(points.withColumn("spread_residual", F.col("spread") - F.col("spread_point")), folds, DAY)
    learned = ranking.exact_quantiles(rows.filter("part = 'train'"), ["fold", HOUR], "spread_residual", [0.5], ["m"])
    test = S.quantile_forecasts(rows.filter("part = 'test'"))
    return test.join(learned, ["fold", HOUR]).withColumn("spread_q50", F.col("spread_point") + F.col("m"))


_EVAL_SQL = """SELECT '{g}' AS generator, count(*) AS rows, avg(abs(mean - da_price)) AS scenario_mean_mae, avg((da_price BETWEEN p10 AND p90)::INT) AS coverage, avg(p90 - p10) AS mean_width, avg(crps) AS crps FROM (
  SELECT delivery_date_local, hour_local, max(da_price) AS da_price, avg(price) AS mean, quantile_cont(price, 0.1) AS p10, quantile_cont(price, 0.9) AS p90, avg(abs(price - da_price)) - sum((2 * i - n + 1) * price) / (max(n) * max(n)) AS crps
  FROM (SELECT s.*, p.da_price, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.delivery_date_local, s.hour_local) AS n FROM {t} s JOIN working_points p USING (delivery_date_local, hour_local) WINDOW w AS (PARTITION BY s.delivery_date_local, s.hour_local ORDER BY price)) GROUP BY 1, 2) HAVING count(*) > 0"""


@query("j12_scenario_evaluation", "generator:s rows:i scenario_mean_mae:f coverage:f mean_width:f crps:f",
       _EVAL_SQL.format(g="raw", t="raw_scenarios") + " UNION ALL " + _EVAL_SQL.format(g="centred", t="centred_scenarios"))
def scenario_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Bands, coverage and CRPS of two generators in one table."""
    points, library = _inputs(spark, path)
    draws = S.settle(uncertainty.sample_source_days(points, library, DAY, N_SCENARIOS, SEED))
    actual = points.select(DAY, HOUR, "da_price")
    rows = [
        uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, {"price": TARGETS["price"]}, centre).withColumn("generator", F.lit(name))
        for name, centre in (("raw", False), ("centred", True))
    ]
    both = rows[0].unionByName(rows[1]).join(actual, [DAY, HOUR])
    keys = ["generator", DAY, HOUR]
    bands = metrics.scenario_bands(both, keys, "price")
    scores = metrics.ensemble_crps(both, keys, "price", "da_price").join(bands, keys)
    return scores.groupBy("generator").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("mean") - F.col("da_price"))).alias("scenario_mean_mae"),
        F.avg(F.col("da_price").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"),
        F.avg(F.col("p90") - F.col("p10")).alias("mean_width"), F.avg("crps").alias("crps"),
    )


_ACTUALS = {"pv": "pv_kwh", "price": "da_price", "spread": "spread"}
_SCORE_SQL = """SELECT '{g}' AS generator, '{t}' AS target, count(*) AS rows, avg(abs(mean - y)) AS scenario_mean_mae, avg((y BETWEEN p10 AND p90)::INT) AS coverage, avg(p90 - p10) AS mean_width, avg(crps) AS crps FROM (
  SELECT delivery_date_local, hour_local, max(y) AS y, avg(x) AS mean, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90, avg(abs(x - y)) - sum((2 * i - n + 1) * x) / (max(n) * max(n)) AS crps
  FROM (SELECT s.delivery_date_local, s.hour_local, s.{t} AS x, p.{a} AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.delivery_date_local, s.hour_local) AS n FROM {v} s JOIN working_points p USING (delivery_date_local, hour_local) WINDOW w AS (PARTITION BY s.delivery_date_local, s.hour_local ORDER BY s.{t})) GROUP BY 1, 2) HAVING count(*) > 0"""


@query("j12_target_evaluation", "generator:s target:s rows:i scenario_mean_mae:f coverage:f mean_width:f crps:f",
       " UNION ALL ".join(_SCORE_SQL.format(g=g, v=v, t=t, a=a) for g, v in (("raw", "raw_scenarios"), ("seasonal", "seasonal_scenarios")) for t, a in _ACTUALS.items()))
def target_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Bands, coverage and CRPS of every target under the plain and the composed generator."""
    points, library = _inputs(spark, path)
    draws = S.settle(uncertainty.sample_source_days(points, library, DAY, N_SCENARIOS, SEED))
    raw = uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, TARGETS, False, {"pv": (0.0, 8.0)})
    both = raw.withColumn("generator", F.lit("raw")).unionByName(composed(points, library).withColumn("generator", F.lit("seasonal")))
    long = both.unpivot([DAY, HOUR, "generator"], list(TARGETS), "target", "x")
    actual = points.select(DAY, HOUR, *[F.col(a).alias(t) for t, a in _ACTUALS.items()]).unpivot([DAY, HOUR], list(_ACTUALS), "target", "y")
    rows = long.join(actual, [DAY, HOUR, "target"])
    keys = ["generator", "target", DAY, HOUR]
    scores = metrics.ensemble_crps(rows, keys, "x", "y").join(metrics.scenario_bands(rows, keys, "x"), keys)
    return scores.groupBy("generator", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("mean") - F.col("y"))).alias("scenario_mean_mae"),
        F.avg(F.col("y").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("mean_width"), F.avg("crps").alias("crps"),
    )

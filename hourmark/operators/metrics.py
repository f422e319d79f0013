"""Forecast-quality metrics: point, grouped, quantile, interval, rank and ensemble."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.operators.ranking import exact_quantiles, rank_window_average


def mae(actual: Column, prediction: Column) -> Column:
    return F.avg(F.abs(actual - prediction))


def rmse(actual: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((actual - prediction) * (actual - prediction)))


def point_metrics(df: DataFrame, groups: Sequence[str], actual: str, prediction: str, peak: Column | None = None) -> DataFrame:
    """Rows, MAE, RMSE and bias per group, with shares of a training peak when given."""
    a, p = F.col(actual), F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("rows"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), F.avg(p - a).alias("bias")]
    out = df.groupBy(*groups).agg(*aggs)
    if peak is not None:
        out = out.withColumns({"nmae": F.col("mae") / peak, "nrmse": F.col("rmse") / peak})
    return out


def masked_metrics(df: DataFrame, groups: Sequence[str], actual: str, prediction: str, masks: Mapping[str, Column]) -> DataFrame:
    """MAE/RMSE over several row masks side by side in one pass."""
    aggs = []
    for name, cond in masks.items():
        a, p = F.when(cond, F.col(actual)), F.when(cond, F.col(prediction))
        aggs += [F.count_if(cond).alias(f"{name}_rows"), mae(a, p).alias(f"{name}_mae"), rmse(a, p).alias(f"{name}_rmse")]
    return df.groupBy(*groups).agg(*aggs)


def metrics_over_sets(df: DataFrame, sets: Sequence[Sequence[str]], actual: str, prediction: str) -> DataFrame:
    """The same metrics over several groupings (``GROUPING SETS``); unused keys are null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    a, p = F.col(actual), F.col(prediction)
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse")
    )


def period_metrics(
    df: DataFrame, periods: Sequence[tuple[str, str, str]], day: str, groups: Sequence[str], actual: str, prediction: str
) -> DataFrame:
    """Bias and exact p95 absolute error per (possibly overlapping) named period.

    ``periods`` lists ``(name, first day, last day)``: each row is repeated for
    the periods it falls in by a row-wise filter, with no join.
    """
    names = [F.when(F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(n)) for n, a, b in periods]
    inside = df.withColumn("period", F.explode(F.filter(F.array(*names), lambda p: p.isNotNull())))
    errors = inside.withColumn("abs_error", F.abs(F.col(prediction) - F.col(actual)))
    keys = ["period", *groups]
    base = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.col(prediction) - F.col(actual)).alias("bias"),
    )
    return base.join(exact_quantiles(errors, keys, "abs_error", [0.95], ["p95_abs_error"]), keys)


def fold_summary(df: DataFrame, fold: str, groups: Sequence[str], metric: str, ddof: int = 1) -> DataFrame:
    """Mean and spread of a per-fold metric."""
    std = F.stddev_samp if ddof else F.stddev_pop
    return df.groupBy(*groups).agg(
        F.count_distinct(fold).alias("folds"), F.avg(metric).alias(f"{metric}_mean"), std(metric).alias(f"{metric}_std")
    )


def paired_improvement(df: DataFrame, variant: str, baseline: str, challenger: str, keys: Sequence[str], metric: str) -> DataFrame:
    """Baseline minus challenger metric per key, by conditional aggregation (no self-join)."""
    pick = lambda name: F.max(F.when(F.col(variant) == name, F.col(metric)))
    wide = df.groupBy(*keys).agg(pick(baseline).alias("baseline"), pick(challenger).alias("challenger"))
    return wide.withColumn("improvement", F.col("baseline") - F.col("challenger"))


def daily_spearman(df: DataFrame, day: Sequence[str], actual: str, prediction: str) -> DataFrame:
    """Spearman correlation per day (at most 24 rows a day, so day windows are small)."""
    pairs = df.filter(F.col(actual).isNotNull() & F.col(prediction).isNotNull())
    ranked = rank_window_average(pairs, day, actual, "_ra")
    ranked = rank_window_average(ranked, day, prediction, "_rp")
    spread = (F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rp") > 0)
    return ranked.groupBy(*day).agg(F.when(spread, F.corr("_ra", "_rp")).alias("spearman"))


def extreme_overlap(df: DataFrame, day: Sequence[str], hour: str, actual: str, prediction: str, k: int = 6) -> DataFrame:
    """Share of the k highest and k lowest hours a forecast finds, per day."""
    def rank(order: list[Column]) -> Column:
        return F.row_number().over(Window.partitionBy(*day).orderBy(*order))

    pairs = df.filter(F.col(actual).isNotNull() & F.col(prediction).isNotNull())
    flagged = pairs.withColumns(
        {
            "_ta": rank([F.col(actual).desc(), F.col(hour)]), "_tp": rank([F.col(prediction).desc(), F.col(hour)]),
            "_ba": rank([F.col(actual), F.col(hour)]), "_bp": rank([F.col(prediction), F.col(hour)]),
        }
    )
    return flagged.groupBy(*day).agg(
        (F.count_if((F.col("_ta") <= k) & (F.col("_tp") <= k)) / float(k)).alias("top_overlap"),
        (F.count_if((F.col("_ba") <= k) & (F.col("_bp") <= k)) / float(k)).alias("bottom_overlap"),
    )


def long_quantiles(df: DataFrame, keys: Sequence[str], actual: str, columns: Mapping[str, float]) -> DataFrame:
    """Wide quantile columns to ``(level, quantile)`` rows."""
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), F.col(c).alias("quantile")) for c, level in columns.items()])
    return df.select(*keys, F.col(actual).alias("actual"), F.inline(pairs))


def pinball(actual: Column, quantile: Column, level: Column) -> Column:
    error = actual - quantile
    return F.greatest(level * error, (level - 1.0) * error)


def quantile_scores(df: DataFrame, keys: Sequence[str], actual: str, columns: Mapping[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Pinball loss, empirical CDF and calibration error per level."""
    rows = long_quantiles(df, list(dict.fromkeys([*keys, *groups])), actual, columns)
    out = rows.groupBy(*groups, "level").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(pinball(F.col("actual"), F.col("quantile"), F.col("level"))).alias("pinball_loss"),
        F.avg((F.col("actual") <= F.col("quantile")).cast("double")).alias("empirical_cdf"),
    )
    return out.withColumn("calibration_error", F.col("empirical_cdf") - F.col("level"))


def interval_scores(df: DataFrame, groups: Sequence[str], actual: str, low: str, high: str) -> DataFrame:
    inside = F.col(actual).between(F.col(low), F.col(high)).cast("double")
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(inside).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("mean_width")
    )


def crossing_rate(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    crossed = F.lit(False)
    for a, b in zip(columns, columns[1:], strict=False):
        crossed = crossed | (F.col(b) < F.col(a))
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(crossed).alias("crossing_rows"),
        F.avg(crossed.cast("double")).alias("crossing_rate"),
    )


def scenario_bands(scenarios: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, P10, P50, P90 over the scenarios of one (day, hour): a fixed ensemble size."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = scenarios.groupBy(*keys).agg(F.avg(value).alias("mean"), q.alias("_q"))
    return out.select(*keys, "mean", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


def ensemble_crps(scenarios: DataFrame, keys: Sequence[str], value: str, actual: str) -> DataFrame:
    """CRPS from the sorted-coefficient identity.

    Members of one key are a fixed ensemble (hundreds), ranked in a window that
    shares its partitioning with the aggregation: one shuffle in all.
    """
    part = Window.partitionBy(*keys)
    ranked = scenarios.withColumns(
        {"_i": F.row_number().over(part.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(part)}
    )
    weight = (F.col("_i") * 2 - F.col("_n") + 1) / (F.col("_n") * F.col("_n"))
    return ranked.groupBy(*keys).agg(
        (F.avg(F.abs(F.col(value) - F.col(actual))) - F.sum(weight * F.col(value))).alias("crps"),
        F.max(actual).alias(actual), F.count(F.lit(1)).alias("members"),
    )


def residual_diagnostics(df: DataFrame, groups: Sequence[str], residual: str) -> DataFrame:
    """Rows, mean, sample std, P10, median, P90; quantiles hold for groups of any size."""
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std")
    )
    return base.join(exact_quantiles(df, groups, residual, [0.1, 0.5, 0.9], ["p10", "median", "p90"]), list(groups))


def correlation_matrix(df: DataFrame, day: str, variable: str, value: str) -> DataFrame:
    """Pearson correlation of every ordered variable pair over common days.

    A day becomes one vector; its outer product (the upper triangle, a block per
    variable) is summed over the days with partial aggregation, so no
    row is joined. Variables are a fixed label set (hours times targets), which
    bounds a vector. The lower triangle is mirrored.
    """
    vectors = df.groupBy(day).agg(F.sort_array(F.collect_list(F.struct(F.col(variable).alias("v"), F.col(value).alias("x")))).alias("_d"))
    place = F.sequence(F.lit(1), F.size("_d"))
    block = F.transform(place, lambda i: F.struct(F.element_at("_d", i).alias("a"), F.slice("_d", i, F.size("_d")).alias("b")))
    rows = vectors.select(F.explode(block).alias("_k")).select("_k.a", F.explode("_k.b").alias("b"))
    pairs = rows.select(F.col("a.v").alias("variable_i"), F.col("b.v").alias("variable_j"), F.col("a.x").alias("_x"), F.col("b.x").alias("_y"))
    upper = pairs.groupBy("variable_i", "variable_j").agg(F.corr("_x", "_y").alias("correlation"), F.count(F.lit(1)).alias("days"))
    mirrored = upper.filter(F.col("variable_i") != F.col("variable_j")).select(
        F.col("variable_j").alias("variable_i"), F.col("variable_i").alias("variable_j"), "correlation", "days"
    )
    return upper.unionByName(mirrored)


def dependence_error(left: DataFrame, right: DataFrame) -> DataFrame:
    """RMSE and largest absolute difference of two correlation tables."""
    keys = ["variable_i", "variable_j"]
    joined = left.select(*keys, F.col("correlation").alias("_a")).join(right.select(*keys, F.col("correlation").alias("_b")), keys)
    diff = F.col("_a") - F.col("_b")
    return joined.agg(
        F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(diff * diff)).alias("correlation_rmse"),
        F.max(F.abs(diff)).alias("correlation_max_abs_error"),
    )


def cross_target_summary(correlations: DataFrame, target_of: Column, other_of: Column, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean, mean absolute and largest absolute correlation between two targets."""
    named = correlations.withColumns({"_a": target_of, "_b": other_of})
    label = F.lit(None).cast("string")
    for a, b in pairs:
        label = F.when((F.col("_a") == a) & (F.col("_b") == b), f"{a}__{b}").otherwise(label)
    return named.withColumn("target_pair", label).filter(F.col("target_pair").isNotNull()).groupBy("target_pair").agg(
        F.avg("correlation").alias("mean_rank_correlation"),
        F.avg(F.abs("correlation")).alias("mean_abs_rank_correlation"),
        F.max(F.abs("correlation")).alias("max_abs_rank_correlation"),
    )


def best_variant(metrics: DataFrame, groups: Sequence[str], variant: str, baseline: str) -> DataFrame:
    """Lowest (MAE, RMSE) variant; the baseline stays when it is not beaten."""
    order = F.struct("mae", "rmse", variant)
    best = metrics.filter(F.col(variant) != baseline)
    chosen = best.groupBy(*groups).agg(F.min_by(F.struct(variant, "mae"), order).alias("_best"))
    base = metrics.filter(F.col(variant) == baseline).select(*groups, F.col("mae").alias("baseline_mae"))
    if groups:
        joined = chosen.join(base, list(groups))
    else:
        joined = chosen.withColumn("baseline_mae", base.scalar())
    keep = F.col("baseline_mae") <= F.col("_best.mae")
    return joined.select(
        *groups, F.when(keep, F.lit(baseline)).otherwise(F.col(f"_best.{variant}")).alias("selected"),
        "baseline_mae", F.col("_best.mae").alias("best_mae"),
    )


def blend_grid(df: DataFrame, actual: str, baseline: str, challenger: str, weights: Sequence[float]) -> DataFrame:
    """MAE and RMSE of every blend weight in one pass."""
    rows = df.select(actual, baseline, challenger, F.explode(F.array(*[F.lit(w) for w in weights])).alias("weight"))
    rows = rows.withColumn("_p", F.col(baseline) + F.col("weight") * (F.col(challenger) - F.col(baseline)))
    return rows.groupBy("weight").agg(
        F.count(F.lit(1)).alias("rows"), mae(F.col(actual), F.col("_p")).alias("mae"), rmse(F.col(actual), F.col("_p")).alias("rmse")
    )

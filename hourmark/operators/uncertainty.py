"""Joint scenarios and calibration: residual bootstrap, rank copula, conformal intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.calendar import calendar_ordinal, circular_distance
from hourmark.functions.numeric import clip, draw_index, draw_uniform, inverse_marginal, sorted_quantiles
from hourmark.operators.ranking import average_ranks, exact_quantiles, order_statistic


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def eligible_positions(targets: DataFrame, library_days: DataFrame, day: str, source: str = "source_day") -> DataFrame:
    """Library size visible to each target day (library days strictly before it).

    Library positions are global, so the eligible days of a target are simply
    positions ``0 .. n_eligible - 1``: one counter per target, not a list.
    Daily grain: the windows run over one row per calendar day.
    """
    lib = library_days.select(F.col(source)).distinct()
    marks = lib.select(F.col(source).alias("_d"), F.lit(1).alias("_lib")).unionByName(
        targets.select(F.col(day).alias("_d"), F.lit(0).alias("_lib")).distinct()
    )
    flat = marks.groupBy("_d").agg(F.max("_lib").alias("_lib"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select(
        "_d", "_lib", F.coalesce(F.sum("_lib").over(before), F.lit(0)).alias("n_eligible")
    )


def sample_source_days(
    targets: DataFrame, library_days: DataFrame, day: str, scenarios: int, seed: int, source: str = "source_day"
) -> DataFrame:
    """Uniform draw with replacement of a library day per (target day, scenario)."""
    marks = eligible_positions(targets, library_days, day, source)
    positions = marks.filter(F.col("_lib") == 1).select(F.col("_d").alias(source), F.col("n_eligible").alias("_pos"))
    counts = marks.select(F.col("_d").alias(day), "n_eligible").filter(F.col("n_eligible") > 0)
    grid = (
        targets.select(day).distinct().join(counts, day)
        .withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
        .withColumn("_pos", draw_index(F.col("scenario_id"), day_number(F.col(day)), seed, F.col("n_eligible")))
    )
    return grid.join(positions, "_pos").select(day, "scenario_id", source, "n_eligible")


def seasonal_weights(
    targets: DataFrame, library_days: DataFrame, day: str, bandwidth: float, mixture: float,
    source: str = "source_day",
) -> DataFrame:
    """Gaussian kernel on circular calendar distance, mixed with a uniform floor.

    The output lists every library day a target may draw, those before it (daily
    grain). Pairs come from an equi-join on library positions ``0 .. n - 1``.
    """
    marks = eligible_positions(targets, library_days, day, source)
    positions = marks.filter(F.col("_lib") == 1).select(F.col("_d").alias(source), F.col("n_eligible").alias("_pos"))
    counted = marks.select(F.col("_d").alias(day), F.col("n_eligible").alias("_n"))
    wanted = targets.select(day).distinct().join(counted.filter(F.col("_n") > 0), day)
    pairs = wanted.withColumn("_pos", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).join(positions, "_pos")
    distance = circular_distance(calendar_ordinal(F.col(source)), calendar_ordinal(F.col(day)))
    z = distance / F.lit(float(bandwidth))
    pairs = pairs.withColumn("_k", F.exp(z * z * -0.5))
    per_target = Window.partitionBy(day)
    weighted = pairs.select(
        day, source,
        (F.lit(1.0 - mixture) * F.col("_k") / F.sum("_k").over(per_target)
         + F.lit(mixture) / F.count(F.lit(1)).over(per_target)).alias("probability"),
    )
    return weighted


def ordinal_weights(
    targets: DataFrame, library_days: DataFrame, day: str, bandwidth: float, mixture: float, source: str = "source_day"
) -> DataFrame:
    """Seasonal weights without listing library days: ``(day, ordinal, days, probability)``.

    The kernel depends on the two calendar ordinals alone, so a target needs the
    number of earlier library days per ordinal, 366 rows at most, and what is
    stored grows with the targets instead of with targets times library days.
    ``probability`` is that of each single day of the ordinal.
    """
    library = library_days.select(F.col(source).alias("_d")).distinct()
    wanted = targets.select(F.col(day).alias("_d")).distinct()
    marks = library.select("_d", calendar_ordinal(F.col("_d")).alias("ordinal"), F.lit(1).alias("_lib")).unionByName(
        wanted.select("_d", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("ordinal"), F.lit(0).alias("_lib"))
    )
    # a target sorts before a library day of the same date, so it counts earlier days only
    upto = Window.partitionBy("ordinal").orderBy("_d", "_lib").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.withColumn("days", F.sum("_lib").over(upto)).filter((F.col("_lib") == 0) & (F.col("days") > 0))
    z = circular_distance(F.col("ordinal"), calendar_ordinal(F.col("_d"))) / F.lit(float(bandwidth))
    kernel = counted.withColumn("_k", F.exp(z * z * -0.5))
    whole = Window.partitionBy("_d")
    share = F.lit(1.0 - mixture) * F.col("_k") / F.sum(F.col("days") * F.col("_k")).over(whole) + F.lit(mixture) / F.sum("days").over(whole)
    return kernel.select(F.col("_d").alias(day), "ordinal", "days", share.alias("probability"))


def ordinal_diagnostics(weights: DataFrame, day: str) -> DataFrame:
    """``sampling_diagnostics`` of weights held per ordinal."""
    p, n = F.col("probability"), F.col("days")
    return weights.groupBy(day).agg(
        F.sum(n).alias("eligible_days"), (F.lit(1.0) / F.sum(n * p * p)).alias("effective_sample_days"),
        F.max(p).alias("maximum_day_probability"), F.min(p).alias("minimum_day_probability"),
    )


def sample_ordinals(weights: DataFrame, library_days: DataFrame, day: str, scenarios: int, seed: int, source: str = "source_day") -> DataFrame:
    """Weighted draw with replacement: first the ordinal, then one of its days, oldest first.

    A target's ladder holds 366 steps at most; only drawn days meet the library.
    """
    upto = Window.partitionBy(day).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = weights.withColumn("_cum", F.sum(F.col("days") * F.col("probability")).over(upto))
    ladders = steps.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("_cum", "ordinal", "days", "probability"))).alias("_ladder"))
    grid = ladders.withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
    grid = grid.withColumn("_u", draw_uniform(F.col("scenario_id"), day_number(F.col(day)), seed))
    passed = F.size(F.filter("_ladder", lambda e: e["_cum"] <= F.col("_u")))
    grid = grid.withColumn("_step", F.col("_ladder")[F.least(passed, F.size("_ladder") - 1)]).drop("_ladder")
    into = F.col("_u") - (F.col("_step._cum") - F.col("_step.days") * F.col("_step.probability"))
    nth = F.greatest(F.lit(0), F.least(F.floor(into / F.col("_step.probability")), F.col("_step.days") - 1)).cast("bigint")
    drawn = grid.select(day, "scenario_id", F.col("_step.ordinal").alias("_ordinal"), nth.alias("_nth"))
    library = library_days.select(source).distinct().withColumn("_ordinal", calendar_ordinal(F.col(source)))
    place = F.row_number().over(Window.partitionBy("_ordinal").orderBy(source)) - 1
    return drawn.join(library.withColumn("_nth", place.cast("bigint")), ["_ordinal", "_nth"]).select(day, "scenario_id", source)


def sampling_diagnostics(weights: DataFrame, day: str) -> DataFrame:
    p = F.col("probability")
    return weights.groupBy(day).agg(
        F.count(F.lit(1)).alias("eligible_days"), (F.lit(1.0) / F.sum(p * p)).alias("effective_sample_days"),
        F.max(p).alias("maximum_day_probability"), F.min(p).alias("minimum_day_probability"),
    )


def sample_weighted(weights: DataFrame, day: str, scenarios: int, seed: int, source: str = "source_day") -> DataFrame:
    """Weighted draw with replacement: one cumulative array per target, searched per scenario.

    The array holds one entry per library day (daily grain).
    """
    ordered = Window.partitionBy(day).orderBy(source).rowsBetween(Window.unboundedPreceding, 0)
    cumulative = weights.withColumn("_cum", F.sum("probability").over(ordered))
    ladders = cumulative.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("_cum", source))).alias("_ladder"))
    grid = ladders.withColumn("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
    grid = grid.withColumn("_u", draw_uniform(F.col("scenario_id"), day_number(F.col(day)), seed))
    steps = F.size(F.filter("_ladder", lambda e: e["_cum"] <= F.col("_u")))
    index = F.least(steps, F.size("_ladder") - 1)
    return grid.select(day, "scenario_id", F.col("_ladder")[index][source].alias(source))


def weighted_scale(value: Column, weight: Column) -> tuple[Column, Column]:
    """Aggregates for a weighted mean and standard deviation (moments, one pass)."""
    total = F.sum(weight)
    mean = F.sum(weight * value) / total
    var = F.greatest(F.sum(weight * value * value) / total - mean * mean, F.lit(0.0))
    return mean, F.sqrt(var)


def floored_scale(scale: Column, global_std: Column, share: float = 0.10, minimum: float = 1e-6) -> Column:
    return F.greatest(scale, global_std * share, F.lit(minimum))


def known_scales(
    residuals: DataFrame, weights: DataFrame, day: str, hour: str, value: str, bandwidth: float, mixture: float, source: str = "source_day"
) -> DataFrame:
    """Seasonally weighted scale around each calendar ordinal as a target day knows it: from its own library days only.

    Residuals are summed per (target day, hour, ordinal) first; then ordinals
    meet ordinals, 366 at most on either side, so what a target and hour need
    stays bounded however long the library is. Returns ``(day, hour, _ordinal, source_scale)``.
    """
    known = weights.select(day, source).join(residuals.select(source, hour, F.col(value).alias("_x")), source)
    sums = known.groupBy(day, hour, calendar_ordinal(F.col(source)).alias("_near")).agg(
        F.count("_x").alias("_n"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q")
    )
    z = circular_distance(F.col("_near"), F.col("_ordinal")) / F.lit(float(bandwidth))
    met = sums.select(day, hour, F.col("_near").alias("_ordinal")).join(sums, [day, hour]).withColumn("_k", F.exp(z * z * -0.5))

    def mixed(column: str) -> Column:
        near = F.sum(F.col("_k") * F.col(column)) / F.sum(F.col("_k") * F.col("_n"))
        return near * (1.0 - mixture) + F.sum(column) / F.sum("_n") * mixture

    def deviation(mean: Column, square: Column) -> Column:
        return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))

    overall = deviation(F.sum("_s") / F.sum("_n"), F.sum("_q") / F.sum("_n"))
    return met.groupBy(day, hour, "_ordinal").agg(floored_scale(deviation(mixed("_s"), mixed("_q")), overall).alias("source_scale"))


def standardise_residuals(
    residuals: DataFrame, weights: DataFrame, day: str, hour: str, value: str, bandwidth: float, mixture: float, source: str = "source_day"
) -> DataFrame:
    """Residuals divided by their own season's scale, centred and rescaled to the target day's season.

    All scales of a target day come from library days before it. Returns
    ``(day, source_day, hour, standardised, centre, target_scale, adjusted)``.
    """
    scales = known_scales(residuals, weights, day, hour, value, bandwidth, mixture, source)
    own = weights.join(residuals.select(source, hour, value), source).withColumn("_ordinal", calendar_ordinal(F.col(source)))
    pairs = own.join(scales, [day, hour, "_ordinal"]).withColumn("standardised", F.col(value) / F.col("source_scale"))
    mean, std = weighted_scale(F.col(value), F.col("probability"))
    target = pairs.groupBy(day, hour).agg(
        F.sum(F.col("probability") * F.col("standardised")).alias("centre"),
        floored_scale(std, F.stddev_pop(value)).alias("target_scale"),
    )
    return pairs.join(target, [day, hour]).select(
        day, source, hour, "standardised", "centre", "target_scale",
        ((F.col("standardised") - F.col("centre")) * F.col("target_scale")).alias("adjusted"),
    )


def ordinal_moments(
    targets: DataFrame, library: DataFrame, day: str, hour: str, hours: Sequence[int], values: Sequence[str], source: str = "source_day"
) -> DataFrame:
    """What each target day knows per clock hour and calendar ordinal: ``n`` and, per value, ``value_s`` and ``value_q``.

    Counts, sums and sums of squares of the library days before the target run
    along the days of each (hour, ordinal), so no target meets a library day; a
    target has ``len(hours) * 366`` rows at most, however long the library is.
    """
    own = library.select(F.col(source).alias("_d"), hour, calendar_ordinal(F.col(source)).alias("ordinal"), F.lit(1).alias("_lib"), *values)
    asked = targets.select(F.col(day).alias("_d")).distinct().withColumn(hour, F.explode(F.array(*[F.lit(h) for h in hours])))
    asked = asked.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.lit(366))))
    asked = asked.select("_d", hour, "ordinal", F.lit(0).alias("_lib"), *[F.lit(None).cast("double").alias(v) for v in values])
    # a target sorts before a library day of the same date, so it knows earlier days only
    upto = Window.partitionBy(hour, "ordinal").orderBy("_d", "_lib").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [c for v in values for c in (F.sum(v).over(upto).alias(f"{v}_s"), F.sum(F.col(v) * F.col(v)).over(upto).alias(f"{v}_q"))]
    known = own.unionByName(asked).select(F.col("_d").alias(day), hour, "ordinal", "_lib", F.sum("_lib").over(upto).alias("n"), *sums)
    return known.filter((F.col("_lib") == 0) & (F.col("n") > 0)).drop("_lib")


def seasonal_adjustments(
    moments: DataFrame, weights: DataFrame, day: str, hour: str, values: Sequence[str], standardised: Sequence[str], bandwidth: float, mixture: float
) -> tuple[DataFrame, DataFrame]:
    """Centres and scales of each target day from the moments of the ordinals alone.

    Returns ``(day, hour, value_mean, ...)`` with the probability-weighted mean of
    every value and, for standardised ones, ``value_centre`` and ``value_target``;
    and ``(day, hour, ordinal, value_scale)`` with the scale around each ordinal.
    ``weights`` are ``ordinal_weights``.
    """
    p = F.col("probability")
    weighted = moments.join(weights.select(day, "ordinal", "probability"), [day, "ordinal"])
    near = moments.select(day, hour, F.col("ordinal").alias("_near"), F.col("n").alias("_n"), *[F.col(f"{v}_{k}").alias(f"_{v}_{k}") for v in standardised for k in "sq"])
    z = circular_distance(F.col("_near"), F.col("ordinal")) / F.lit(float(bandwidth))
    met = moments.select(day, hour, "ordinal").join(near, [day, hour]).withColumn("_k", F.exp(z * z * -0.5))  # ordinals meet ordinals: 366 at most on either side

    def deviation(mean: Column, square: Column) -> Column:
        return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))

    def mixed(column: str) -> Column:
        return F.sum(F.col("_k") * F.col(column)) / F.sum(F.col("_k") * F.col("_n")) * (1.0 - mixture) + F.sum(column) / F.sum("_n") * mixture

    scales = met.groupBy(day, hour, "ordinal").agg(*[
        floored_scale(deviation(mixed(f"_{v}_s"), mixed(f"_{v}_q")), deviation(F.sum(f"_{v}_s") / F.sum("_n"), F.sum(f"_{v}_q") / F.sum("_n"))).alias(f"{v}_scale") for v in standardised
    ])
    total = F.sum(p * F.col("n"))
    stats = []
    for v in values:
        s, q = F.col(f"{v}_s"), F.col(f"{v}_q")
        mean = F.sum(p * s) / total
        stats.append(mean.alias(f"{v}_mean"))
        if v in standardised:
            overall = deviation(F.sum(s) / F.sum("n"), F.sum(q) / F.sum("n"))
            stats += [
                F.sum(p * s / F.col(f"{v}_scale")).alias(f"{v}_centre"),
                floored_scale(deviation(mean, F.sum(p * q) / total), overall).alias(f"{v}_target"),
            ]
    return weighted.join(scales, [day, hour, "ordinal"]).groupBy(day, hour).agg(*stats), scales


def seasonal_scenarios(
    points: DataFrame, library: DataFrame, day: str, hour: str, hours: Sequence[int], targets: Mapping[str, tuple[str, str]], standardised: Sequence[str],
    scenarios: int, seed: int, bandwidth: float, mixture: float, bounds: Mapping[str, tuple[float | None, float | None]] | None = None, source: str = "source_day",
) -> DataFrame:
    """Joint scenarios: seasonal draw of a library day, weighted centring of every target, season-to-season scaling of some.

    ``targets`` maps an output to ``(point column, residual column)``; residual
    columns named in ``standardised`` are divided by the scale of their own
    season, centred, and scaled to the target's. All of it is known before the
    target day. No (target, library day) pair is ever listed.
    """
    residuals = [r for _, r in targets.values()]
    weights = ordinal_weights(points, library, day, bandwidth, mixture, source)
    draws = sample_ordinals(weights, library, day, scenarios, seed, source)
    moments = ordinal_moments(points, library, day, hour, hours, residuals, source)
    stats, scales = seasonal_adjustments(moments, weights, day, hour, residuals, standardised, bandwidth, mixture)
    rows = draws.join(library.select(source, hour, *residuals), source).withColumn("ordinal", calendar_ordinal(F.col(source)))
    rows = rows.join(points, [day, hour]).join(stats, [day, hour]).join(scales, [day, hour, "ordinal"])
    out = []
    for name, (point, r) in targets.items():
        moved = (F.col(r) / F.col(f"{r}_scale") - F.col(f"{r}_centre")) * F.col(f"{r}_target") if r in standardised else F.col(r) - F.col(f"{r}_mean")
        out.append(clip(F.col(point) + moved, *((bounds or {}).get(name, (None, None)))).alias(name))
    return rows.select(day, "scenario_id", hour, source, *out)


def residual_library(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Actual minus prediction for each target."""
    return df.select(*keys, *[(F.col(a) - F.col(p)).alias(name) for name, (a, p) in pairs.items()])


def running_centre(library: DataFrame, source: str, hour: str, values: Sequence[str]) -> DataFrame:
    """Mean residual of the library days up to and including each day, per hour.

    A target's eligible mean is the entry of its last eligible day, so centring
    needs no target-by-library join. Daily grain per hour.
    """
    upto = Window.partitionBy(hour).orderBy(source).rowsBetween(Window.unboundedPreceding, 0)
    return library.select(source, hour, *[F.avg(v).over(upto).alias(f"{v}_centre") for v in values])


def bootstrap_scenarios(
    points: DataFrame,
    library: DataFrame,
    draws: DataFrame,
    day: str,
    hour: str,
    targets: Mapping[str, tuple[str, str]],
    centre: bool = False,
    bounds: Mapping[str, tuple[float | None, float | None]] | None = None,
    source: str = "source_day",
) -> DataFrame:
    """Sampled source day's residuals on the point forecast, all targets from one row.

    ``targets`` maps an output to ``(point column, residual column)``.
    """
    residuals = [r for _, r in targets.values()]
    rows = draws.join(points, day).join(library.select(source, hour, *residuals), [source, hour])
    shift = {r: F.lit(0.0) for r in residuals}
    if centre:
        marks = eligible_positions(points, library, day, source)
        latest = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
        newest = marks.select(
            F.col("_d").alias(day), F.last(F.when(F.col("_lib") == 1, F.col("_d")), ignorenulls=True).over(latest).alias("_last")
        )
        centres = running_centre(library, source, hour, residuals).withColumnRenamed(source, "_last")
        rows = rows.join(newest, day).join(centres, ["_last", hour])
        shift = {r: F.col(f"{r}_centre") for r in residuals}
    out = {
        name: clip(F.col(point) + F.col(res) - shift[res], *((bounds or {}).get(name, (None, None))))
        for name, (point, res) in targets.items()
    }
    return rows.select(day, "scenario_id", hour, source, *[c.alias(n) for n, c in out.items()])


def copula_ranks(residuals: DataFrame, day: str, hour: str, target: str, value: str) -> DataFrame:
    """Average rank of each day within its (target, hour), mapped to ``(rank - 0.5) / n``."""
    ranked = average_ranks(residuals, [target, hour], value)
    return ranked.select(day, hour, target, ((F.col("rank") - 0.5) / F.col("n_total")).alias("u"))


def copula_scenarios(
    draws: DataFrame, ranks: DataFrame, quantiles: DataFrame, day: str, hour: str, target: str,
    levels: Sequence[float], bounds: Mapping[str, tuple[float | None, float | None]] | None = None, source: str = "source_day",
) -> DataFrame:
    """Ranks of the sampled day inverted through the target day's marginals.

    ``quantiles`` has ``(day, hour, target, q)`` with ``q`` an array on
    ``levels``; crossings are repaired before inversion.
    """
    sampled = draws.join(ranks.withColumnRenamed(day, source) if day in ranks.columns else ranks, source)
    rows = sampled.join(quantiles, [day, hour, target])
    value = inverse_marginal(F.col("u"), F.array_sort("q"), levels)
    for name, (low, high) in (bounds or {}).items():
        value = F.when(F.col(target) == name, clip(value, low, high)).otherwise(value)
    return rows.select(day, "scenario_id", hour, target, source, "u", value.alias("value"))


def grouped_residual_quantiles(
    residuals: DataFrame, groups: Sequence[str], fallback: Sequence[str], value: str, levels: Sequence[float], names: Sequence[str], minimum: int
) -> DataFrame:
    """Empirical residual quantiles by group, by the coarser group when it is thin."""
    fine = exact_quantiles(residuals, groups, value, levels, names).join(
        residuals.groupBy(*groups).agg(F.count(value).alias("_n")), list(groups)
    )
    coarse = exact_quantiles(residuals, fallback, value, levels, [f"{n}_fallback" for n in names])
    both = fine.join(coarse, list(fallback))
    enough = F.col("_n") >= minimum
    return both.select(*groups, *[F.when(enough, F.col(n)).otherwise(F.col(f"{n}_fallback")).alias(n) for n in names])


def central_pairs(levels: Sequence[float]) -> list[tuple[int, int]]:
    """Index pairs of levels symmetric around the median."""
    n = len(levels)
    pairs = [(i, n - 1 - i) for i in range(n // 2)]
    if any(abs(levels[i] + levels[j] - 1.0) > 1e-9 for i, j in pairs):
        raise ValueError("every lower level needs a symmetric upper level")
    return pairs


def conformal_fit(df: DataFrame, group: str, actual: str, columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Widening per (group, central pair): the finite-sample "higher" order statistic.

    The statistic is found by distributed counting, so a group may be any size.
    """
    ordered = df.withColumn("_q", sorted_quantiles(columns))
    y = F.col(actual)
    items = []
    for i, j in central_pairs(levels):
        lo, hi = F.col("_q")[i], F.col("_q")[j]
        items.append(
            F.struct(
                F.lit(float(levels[i])).alias("lower_quantile"), F.lit(float(levels[j])).alias("upper_quantile"),
                F.greatest(lo - y, y - hi, F.lit(0.0)).alias("score"), y.between(lo, hi).cast("double").alias("inside"),
            )
        )
    rows = ordered.select(group, F.inline(F.array(*items)))
    keys = [group, "lower_quantile", "upper_quantile"]
    coverage = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("calibration_rows"), F.avg("inside").alias("raw_coverage"))
    target = F.round(F.col("upper_quantile") - F.col("lower_quantile"), 9)
    n = F.col("n_total")
    level = F.least(F.lit(1.0), F.ceil(F.round((n + 1) * target, 9)) / n)
    position = F.ceil(F.round((n - 1) * level, 9)) + 1
    corrections = order_statistic(rows, keys, "score", position, "correction").drop("n_total")
    out = coverage.join(corrections, keys).withColumn("target_coverage", target)
    m = F.col("calibration_rows")
    return out.withColumn(
        "score_quantile_level", F.least(F.lit(1.0), F.ceil(F.round((m + 1) * F.col("target_coverage"), 9)) / m)
    )


def conformal_apply(
    df: DataFrame, corrections: DataFrame, group: str, columns: Sequence[str], levels: Sequence[float],
    low: float | None = None, high: float | None = None,
) -> DataFrame:
    """Widen each central pair by its group's correction, re-sort and clip.

    Corrections are pivoted to one row per group, so the join adds no rows; a
    group without corrections keeps its quantiles.
    """
    pairs = central_pairs(levels)
    wide = corrections.groupBy(group).agg(
        *[F.max(F.when(F.abs(F.col("lower_quantile") - levels[i]) < 1e-9, F.col("correction"))).alias(f"_c{i}") for i, _ in pairs]
    )
    joined = df.join(wide, group, "left").withColumn("_q", sorted_quantiles(columns))
    values = [F.col("_q")[i] for i in range(len(levels))]
    for i, j in pairs:
        c = F.coalesce(F.col(f"_c{i}"), F.lit(0.0))
        values[i], values[j] = values[i] - c, values[j] + c
    joined = joined.withColumn("_q", F.array_sort(F.array(*values)))
    out = joined.withColumns({c: clip(F.col("_q")[i], low, high) for i, c in enumerate(columns)})
    return out.drop("_q", *[f"_c{i}" for i, _ in pairs])


def block_bootstrap(
    daily: DataFrame, order: str, values: Sequence[str], block: int, resamples: int, seed: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Paired moving-block resamples: ``(keys, resample, values)`` rows of drawn days.

    Day positions come from a window over one row per day; each drawn block is
    an equi-join on positions, never an all-pairs comparison.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    days = daily.select(*keys, order, *values).withColumns(
        {"_pos": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)}
    )
    sizes = days.groupBy(*keys).agg(F.max("_n").alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    plan = (
        sizes.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("_start", draw_index(F.col("resample"), F.col("_block"), seed, F.greatest(F.col("_n") - block + 1, F.lit(1))))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
        .filter(F.col("_block") * block + F.col("_k") < F.col("_n"))
        .withColumn("_pos", (F.col("_start") + F.col("_k")).cast("int"))
        .drop("_n")
    )
    return plan.join(days, [*keys, "_pos"]).select(*keys, "resample", *values)

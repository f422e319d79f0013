"""Point-in-time rules: a value may be used only once it was available."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.calendar import LOCAL_TZ, hours


def mask_unavailable(df: DataFrame, as_of: Column, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Null every value whose availability column is null or later than ``as_of``.

    ``groups`` maps an availability column to the value columns it governs.
    """
    present = set(df.columns)
    masked = {
        value: F.when(F.col(available) <= as_of, F.col(value))
        for available, values in groups.items()
        if available in present
        for value in values
        if value in present
    }
    return df.withColumns(masked)


def freshest_complete_layer(
    df: DataFrame,
    variables: Sequence[str],
    layers: Sequence[tuple[int, str, str]],
    as_of: Column | None = None,
    prefix: str = "weather_forecast_",
) -> DataFrame:
    """Take all variables from the first layer that is complete and available.

    ``layers`` lists ``(lead_hours, value_prefix, availability_column)`` from
    freshest to oldest. Without ``as_of`` the values are taken as already
    masked, so completeness alone decides.
    """
    usable = []
    for _, value_prefix, available in layers:
        ok = F.lit(True)
        for name in variables:
            ok = ok & F.col(value_prefix + name).isNotNull()
        if as_of is not None:
            ok = ok & F.coalesce(F.col(available) <= as_of, F.lit(False))
        usable.append(ok)

    def pick(choices: Sequence[Column]) -> Column:
        out = F.when(usable[0], choices[0])
        for ok, choice in zip(usable[1:], choices[1:], strict=True):
            out = out.when(ok, choice)
        return out

    chosen = {prefix + v: pick([F.col(p + v) for _, p, _ in layers]) for v in variables}
    chosen[prefix + "lead_hours"] = pick([F.lit(lead) for lead, _, _ in layers])
    chosen[prefix + "available_at_utc"] = pick([F.col(a) for _, _, a in layers])
    return df.withColumns(chosen)


def per_variable_fallback(
    df: DataFrame,
    variables: Sequence[str],
    layers: Sequence[tuple[int, str, str]],
    as_of: Column,
    prefix: str = "local_weather_",
) -> DataFrame:
    """Each variable falls back on its own; leads are those of the chosen values."""
    chosen: dict[str, Column] = {}
    for name in variables:
        chosen[prefix + name] = F.coalesce(
            *[F.when(F.col(available) <= as_of, F.col(p + name)) for _, p, available in layers]
        )
        chosen[prefix + name + "_lead_hours"] = F.coalesce(
            *[
                F.when((F.col(available) <= as_of) & F.col(p + name).isNotNull(), F.lit(lead))
                for lead, p, available in layers
            ]
        )
    return df.withColumns(chosen)


def delivery_context(
    df: DataFrame, decisions: DataFrame, groups: Mapping[str, Sequence[str]], day: str = "delivery_date_local", keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of each decision's delivery day, masked at its ``as_of_utc``: an equi-join on series and day.

    ``decisions`` has ``(keys, day, as_of_utc)``. What a decision knows of the
    history before it comes from ``known_totals``.
    """
    return mask_unavailable(df.join(decisions, [*keys, day]), F.col("as_of_utc"), groups)


def known_at(valid: str, available: str) -> Column:
    """When a value of a past hour counts as known: the later of the hour and its publication, null if unpublished."""
    return F.when(F.col(available).isNotNull(), F.greatest(valid, available))


def known_totals(
    df: DataFrame,
    decisions: DataFrame,
    measures: Mapping[str, tuple[Column, Column]],
    decision_keys: Sequence[str],
    keys: Sequence[str] = (),
    as_of: str = "as_of_utc",
) -> DataFrame:
    """Count and sum of every value known by each decision, over its whole history.

    ``measures`` maps a name to (time from which it is known, value); the result
    adds ``<name>_n`` and ``<name>_sum`` to the decisions. Sums per date run over
    the dates of a series; only facts of a decision's own date are met singly, so
    the work does not grow with decisions times history.
    """
    fact = F.array(*[F.struct(F.lit(m).alias("_m"), at.alias("_at"), v.cast("double").alias("_v")) for m, (at, v) in measures.items()])
    facts = df.select(*keys, F.explode(fact).alias("_f")).select(*keys, "_f.*").filter("_at IS NOT NULL AND _v IS NOT NULL")
    facts = facts.withColumn("_date", F.to_date("_at"))
    names = [f"{m}_{part}" for m in measures for part in ("n", "sum")]

    def totals(suffix: str) -> list[Column]:
        own = [F.when(F.col("_m") == m, F.col("_v")) for m in measures]
        return [how(v).alias(f"{m}_{part}{suffix}") for m, v in zip(measures, own, strict=True) for part, how in (("n", F.count), ("sum", F.sum))]

    probe = decisions.withColumn("_date", F.to_date(as_of))
    daily = facts.groupBy(*keys, "_date").agg(*totals(""))
    spine = probe.select(*keys, "_date").unionByName(daily.select(*keys, "_date")).distinct()
    earlier = Window.partitionBy(*keys).orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    carried = spine.join(daily, [*keys, "_date"], "left").select(*keys, "_date", *[F.sum(c).over(earlier).alias(c) for c in names])
    same_date = (
        probe.join(facts, [*keys, "_date"]).filter(F.col("_at") <= F.col(as_of)).groupBy(*decision_keys, as_of).agg(*totals("_today"))
    )
    joined = probe.join(carried, [*keys, "_date"]).join(same_date, [*decision_keys, as_of], "left")
    zero = F.lit(0)
    return joined.withColumns({c: F.coalesce(c, zero) + F.coalesce(f"{c}_today", zero) for c in names}).drop("_date", *[f"{c}_today" for c in names])


def context_at(
    df: DataFrame,
    as_of: Column,
    start: Column,
    end: Column,
    groups: Mapping[str, Sequence[str]],
    valid: str = "valid_time_utc",
) -> tuple[DataFrame, DataFrame]:
    """One decision's view: masked rows of ``[start, end)`` and all masked history."""
    target = df.filter((F.col(valid) >= start) & (F.col(valid) < end))
    history = df.filter(F.col(valid) <= as_of)
    return mask_unavailable(target, as_of, groups), mask_unavailable(history, as_of, groups)


def horizon_context(
    df: DataFrame,
    decisions: DataFrame,
    groups: Mapping[str, Sequence[str]],
    ahead_hours: int,
    valid: str = "valid_time_utc",
) -> DataFrame:
    """Future rows up to the horizon's end of each decision, masked at its ``as_of_utc``.

    An equi-join on the hour with an exploded offset, so the work is decisions
    times horizon. The observed part, all hours up to ``as_of_utc``, is never
    paired with decisions: ``known_totals`` sums it, ``context_at`` lists it.
    """
    offsets = F.explode(F.sequence(F.lit(1), F.lit(ahead_hours)))
    wanted = decisions.withColumn("offset_hours", offsets).withColumn(
        valid, F.col("as_of_utc") + F.make_dt_interval(F.lit(0), F.col("offset_hours"))
    )
    pairs = wanted.join(df, [c for c in decisions.columns if c in df.columns] + [valid])
    return mask_unavailable(pairs, F.col("as_of_utc"), groups)


def latest_available_run(
    decisions: DataFrame,
    runs: DataFrame,
    decision_keys: Sequence[str],
    as_of: str = "as_of_utc",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Newest run published by each decision, however old it is.

    ``runs`` is the distinct ``(keys, run_init_utc, available_at_utc)`` of an
    archive; ``keys`` name the series and are part of ``decision_keys``.
    Runs published on the decision's own date come from an equi-join on that
    date; otherwise the decision takes the last run of an earlier date, carried
    forward over a spine with one row per date. No row ever meets all runs.
    """
    order = F.struct("available_at_utc", "run_init_utc")
    record = F.struct("run_init_utc", "available_at_utc")
    dated = runs.select(*keys, "run_init_utc", "available_at_utc", F.to_date("available_at_utc").alias("_date"))
    probe = decisions.withColumn("_date", F.to_date(as_of))

    same_date = (
        probe.join(dated, [*keys, "_date"])
        .filter(F.col("available_at_utc") <= F.col(as_of))
        .groupBy(*decision_keys, as_of)
        .agg(F.max_by(record, order).alias("_same"))
    )
    last_of_date = dated.groupBy(*keys, "_date").agg(F.max_by(record, order).alias("_last"))
    spine = probe.select(*keys, "_date").unionByName(dated.select(*keys, "_date")).distinct()
    earlier = Window.partitionBy(*keys).orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)  # one row per date
    carried = spine.join(last_of_date, [*keys, "_date"], "left").select(
        *keys, "_date", F.last("_last", ignorenulls=True).over(earlier).alias("_carried")
    )
    newest = probe.join(carried, [*keys, "_date"]).join(same_date, [*decision_keys, as_of], "left")
    run = F.coalesce("_same", "_carried")
    return newest.filter(run.isNotNull()).select(
        *decision_keys, as_of, run["run_init_utc"].alias("run_init_utc"), run["available_at_utc"].alias("available_at_utc")
    )


def snapshot_join(
    decisions: DataFrame,
    targets: DataFrame,
    archive: DataFrame,
    day: str = "delivery_date_local",
    decision_keys: Sequence[str] = ("delivery_date_local", "decision_hour_local"),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Forecast rows of the newest published run for every future target of a decision, series by series (``keys``)."""
    runs = archive.select(*keys, "run_init_utc", "available_at_utc").distinct()
    chosen = latest_available_run(decisions, runs, [*keys, *[k for k in decision_keys if k not in keys]], keys=keys)
    future = chosen.join(targets, [*keys, day]).filter(F.col("valid_time_utc") > F.col("as_of_utc"))
    out = future.join(archive.drop("available_at_utc"), [*keys, "run_init_utc", "valid_time_utc"])
    return out.withColumns(
        {
            "snapshot_lead_hours": F.timestamp_diff("HOUR", F.col("run_init_utc"), F.col("valid_time_utc")).cast("int"),
            "snapshot_age_hours": F.timestamp_diff("HOUR", F.col("available_at_utc"), F.col("as_of_utc")).cast("int"),
        }
    )


def asof_per_location(
    requests: DataFrame,
    archive: DataFrame,
    request_keys: Sequence[str],
    locations: int,
    location: str = "location_id",
    as_of: str = "as_of_utc",
    valid: str = "valid_time_utc",
) -> DataFrame:
    """Latest published record of each location for a request; all locations required (see ``incomplete_requests``).

    Runs covering one valid time are few, so the join is on valid time and the
    pick is a partial ``max_by`` over structs.
    """
    values = [c for c in archive.columns if c not in (valid, location)]
    hits = requests.join(archive, valid).filter(F.col("available_at_utc") <= F.col(as_of))
    newest = hits.groupBy(*request_keys, as_of, valid, location).agg(
        F.max_by(F.struct(*values), F.struct("available_at_utc", "run_init_utc")).alias("_r")
    )
    picked = newest.select(*request_keys, as_of, valid, location, *[F.col("_r")[v].alias(v) for v in values])
    per_request = Window.partitionBy(*request_keys, as_of, valid)  # one row per location
    return picked.withColumn("_n", F.count(F.lit(1)).over(per_request)).filter(F.col("_n") == locations).drop("_n")


def incomplete_requests(
    requests: DataFrame, archive: DataFrame, request_keys: Sequence[str], locations: int,
    location: str = "location_id", as_of: str = "as_of_utc", valid: str = "valid_time_utc",
) -> DataFrame:
    """Requests that ``asof_per_location`` cannot answer in full, with the number of locations ``found``.

    Callers that need every request answered refuse to go on when this is not empty.
    """
    hits = requests.join(archive.select(valid, location, "available_at_utc"), valid).filter(F.col("available_at_utc") <= F.col(as_of))
    found = hits.groupBy(*request_keys, as_of, valid).agg(F.count_distinct(location).alias("found"))
    counted = requests.select(*request_keys, as_of, valid).distinct().join(found, [*request_keys, as_of, valid], "left")
    return counted.withColumn("found", F.coalesce("found", F.lit(0))).filter(F.col("found") < locations)


def spatial_summary(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each variable across locations."""
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*aggs)


def causality_filter(df: DataFrame, feature_times: Sequence[str], as_of: str = "as_of_utc",
                     target_time: str | None = None) -> DataFrame:
    """Keep rows whose features were published by ``as_of`` and whose target was not."""
    ok = F.lit(True)
    for c in feature_times:
        ok = ok & (F.col(c) <= F.col(as_of))
    if target_time is not None:
        ok = ok & (F.col(target_time) > F.col(as_of))
    return df.filter(ok)


def run_schedule(days: DataFrame, day: str, run_hours: Sequence[int], delay_hours: int = 6) -> DataFrame:
    """One requested run per day and run hour with its publication time."""
    runs = days.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in run_hours])))
    run = F.col(day).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("_h"))
    return runs.select(
        *[c for c in days.columns if c != day],
        run.alias("run_init_utc"),
        (run + hours(delay_hours)).alias("available_at_utc"),
    )

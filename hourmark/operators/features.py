"""Lag, last-N, curve and decision-by-target features.

Lags are self equi-joins on a shifted key (series key plus instant, or series
key plus local day and hour): partitionable, and null on a gap instead of
silently reaching an older row as a row shift would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.numeric import ar1_forecast, ratio_or_sentinel, slope


def hour_lags(
    df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], lags: Sequence[int], names: str = "{value}_lag_{lag}h"
) -> DataFrame:
    """Values of earlier hours as columns: one exploded join for all lags together."""
    shifted = (
        df.select(*keys, ts, *values)
        .withColumn("_lag", F.explode(F.array(*[F.lit(k) for k in lags])))
        .withColumn(ts, F.col(ts) + F.make_dt_interval(F.lit(0), F.col("_lag")))
        .groupBy(*keys, ts)
        .agg(
            *[
                F.max(F.when(F.col("_lag") == k, F.col(v))).alias(names.format(value=v, lag=k))
                for v in values
                for k in lags
            ]
        )
    )
    return df.join(shifted, [*keys, ts], "left")


def clock_lags(table: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], days: Sequence[int], names: str = "{value}_lag_{day}d") -> DataFrame:
    """Values of the same clock hour some days back, from a table stored by ``save_clock_table``.

    The series of one clock hour has one row per day; an exact range of elapsed
    seconds picks the lag, so a gap yields null. On the stored buckets neither an
    exchange nor a join is needed.
    """
    series = Window.partitionBy(*keys, "clock_hour").orderBy(F.unix_seconds(ts))
    exact = lambda k: series.rangeBetween(-k * 86400, -k * 86400)
    return table.select("*", *[F.first(v).over(exact(k)).alias(names.format(value=v, day=k)) for v in values for k in days])


def same_clock_history(
    targets: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    day: str,
    hour: str,
    values: Sequence[str],
    lags: Sequence[int],
    names: str = "{value}_d{lag}",
    required: bool = True,
    instant: str | None = None,
) -> DataFrame:
    """Same clock hour of earlier local days as columns; ``required`` drops rows missing any.

    Where a clock hour occurs twice, ``instant`` picks its later occurrence.
    """

    def value_at(v: str, k: int) -> Column:
        here = F.col("_lag") == k
        if instant is None:
            return F.max(F.when(here, F.col(v)))
        return F.max_by(F.when(here, F.col(v)), F.when(here, F.col(instant)))

    wanted = F.array(*[F.lit(k) for k in lags])
    found = sum((F.max((F.col("_lag") == k).cast("int")) for k in lags), F.lit(0))
    shifted = (
        history.select(*keys, day, hour, *values, *([instant] if instant else []))
        .withColumn("_lag", F.explode(wanted))
        .withColumn(day, F.date_add(day, F.col("_lag")))
        .groupBy(*keys, day, hour)
        .agg(
            found.alias("_found"),
            *[value_at(v, k).alias(names.format(value=v, lag=k)) for v in values for k in lags],
        )
    )
    if required:
        shifted = shifted.filter(F.col("_found") == len(lags))
    return targets.join(shifted.drop("_found"), [*keys, day, hour], "inner" if required else "left")


def mean_skipping_nulls(columns: Sequence[str]) -> Column:
    present = F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present))


def strict_mean(columns: Sequence[str]) -> Column:
    """Mean that is null when any input is null."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / float(len(columns))


def recent_windows(
    decisions: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    n: int = 6,
    backs: Sequence[int] = (),
    as_of: str = "as_of_utc",
    day: str = "delivery_date_local",
    hour: str = "hour_local",
) -> DataFrame:
    """The ``n`` completed hours before a decision, and the same clock hours of earlier days.

    Arrays run old to new: ``{value}_window`` and, per entry of ``backs``,
    ``{value}_d{back}w``. A decision missing any hour of any window is dropped.
    All windows share one join on the hour, one on (day, hour) and one
    aggregation of ``n * (1 + len(backs))`` rows per decision.
    """
    packed = F.struct(*values).alias("_v")
    probe = decisions.select(*keys, as_of).withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    probe = probe.withColumn(ts, F.col(as_of) - F.make_dt_interval(F.lit(0), F.col("_i")))
    rows = probe.join(series.select(*keys, ts, day, hour, packed), [*keys, ts])
    recent = rows.select(*keys, as_of, F.lit(0).alias("_back"), "_i", "_v")
    if backs:
        # an hour repeated at the end of summer time counts once, by its later instant
        earlier = series.groupBy(*keys, day, hour).agg(F.max_by(F.struct(*values), F.col(ts)).alias("_v"))
        asked = rows.select(*keys, as_of, "_i", day, hour, F.explode(F.array(*[F.lit(b) for b in backs])).alias("_back"))
        asked = asked.withColumn(day, F.date_sub(day, F.col("_back")))
        recent = recent.unionByName(asked.join(earlier, [*keys, day, hour]).select(*keys, as_of, "_back", "_i", "_v"))
    items = F.array_sort(F.collect_list(F.struct("_back", (-F.col("_i")).alias("o"), "_v")))
    grouped = recent.groupBy(*keys, as_of).agg(items.alias("_w"))
    windows = [F.slice("_w", 1 + k * n, n).alias(f"_w{k}") for k in range(1 + len(backs))]
    whole = grouped.filter(F.size("_w") == n * (1 + len(backs))).select(*keys, as_of, *windows)
    names = ["window", *[f"d{b}w" for b in sorted(backs)]]
    return whole.select(*keys, as_of, *[F.col(f"_w{k}._v")[v].alias(f"{v}_{name}") for k, name in enumerate(names) for v in values])


def recent_window(
    decisions: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    n: int = 6,
    local_days_back: int = 0,
    **columns: str,
) -> DataFrame:
    """One window: the recent hours, or their clock hours ``local_days_back`` days earlier."""
    if not local_days_back:
        return recent_windows(decisions, series, keys, ts, values, n, **columns)
    both = recent_windows(decisions, series, keys, ts, values, n, (local_days_back,), **columns)
    return both.drop(*[f"{v}_window" for v in values]).withColumnsRenamed({f"{v}_d{local_days_back}w": f"{v}_window" for v in values})


def array_stats(window: Column, prefix: str) -> dict[str, Column]:
    """Mean, population std, min, max and momentum of a short ordered array."""
    n = F.size(window)
    mean = F.aggregate(window, F.lit(0.0), lambda acc, v: acc + v) / n
    var = F.aggregate(F.transform(window, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda acc, v: acc + v) / n
    return {
        f"{prefix}_mean": mean,
        f"{prefix}_std": F.sqrt(var),
        f"{prefix}_min": F.array_min(window),
        f"{prefix}_max": F.array_max(window),
        f"{prefix}_momentum": F.element_at(window, -1) - F.element_at(window, -2),
    }


def array_quantile(window: Column, level: float) -> Column:
    """Linear quantile of a short array."""
    ordered = F.array_sort(window)
    position = (F.size(window) - 1) * F.lit(float(level))
    lo, hi = F.floor(position).cast("int"), F.ceil(position).cast("int")
    return ordered[lo] + (ordered[hi] - ordered[lo]) * (position - lo)


def enriched_window_stats(window: Column, prefix: str) -> dict[str, Column]:
    """Median, IQR, mean absolute change, slope and last minus mean."""
    n = F.size(window)
    mean = F.aggregate(window, F.lit(0.0), lambda acc, v: acc + v) / n
    changes = F.zip_with(
        F.slice(window, F.lit(2), n - 1), F.slice(window, F.lit(1), n - 1), lambda b, a: F.abs(b - a)
    )
    return {
        f"{prefix}_median": array_quantile(window, 0.5),
        f"{prefix}_iqr": array_quantile(window, 0.75) - array_quantile(window, 0.25),
        f"{prefix}_abs_change_mean": F.aggregate(changes, F.lit(0.0), lambda acc, v: acc + v) / (n - 1),
        f"{prefix}_slope": slope(window),
        f"{prefix}_last_minus_mean": F.element_at(window, -1) - mean,
    }


def decision_targets(
    decisions: DataFrame, targets: DataFrame, keys: Sequence[str], day: str, decision_hour: str, target_hour: str
) -> DataFrame:
    """Every later hour of the decision's own day (equi-join on the day, then ``>``)."""
    pairs = decisions.join(targets, [*keys, day]).filter(F.col(target_hour) > F.col(decision_hour))
    return pairs.withColumn("lead_hours", (F.col(target_hour) - F.col(decision_hour)).cast("int"))


def previous_curve(df: DataFrame, keys: Sequence[str], day: str, hour: str, value: str, prefix: str) -> DataFrame:
    """The 24 values of the day before as columns plus its statistics, keyed by delivery day."""
    hours_cols = [F.max(F.when(F.col(hour) == h, F.col(value))).alias(f"{prefix}_h{h:02d}") for h in range(24)]
    stats = curve_stats(value, prefix)
    return df.withColumn(day, F.date_add(day, 1)).groupBy(*keys, day).agg(*hours_cols, *stats)


def curve_stats(value: str, prefix: str) -> list[Column]:
    v = F.col(value)
    return [
        F.avg(v).alias(f"{prefix}_mean"),
        F.stddev_pop(v).alias(f"{prefix}_std"),
        F.min(v).alias(f"{prefix}_min"),
        F.max(v).alias(f"{prefix}_max"),
        (F.max(v) - F.min(v)).alias(f"{prefix}_range"),
        F.avg((v < 0).cast("double")).alias(f"{prefix}_negative_share"),
    ]


def trailing_days_stats(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int, prefix: str) -> DataFrame:
    """Mean and population std of all values of the ``days`` days before each day.

    Daily moments are combined (each day contributes to the next ``days``), so
    no 24*days-row window is formed. Only days with full history are returned.
    """
    v = F.col(value)
    daily = df.groupBy(*keys, day).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v")
    )
    spread = daily.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn(
        day, F.date_add(day, F.col("_k"))
    )
    total = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_m")) / total
    second = F.sum(F.col("_n") * (F.col("_v") + F.col("_m") * F.col("_m"))) / total
    out = spread.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("_days"), mean.alias(f"{prefix}_mean"),
        F.sqrt(F.greatest(second - mean * mean, F.lit(0.0))).alias(f"{prefix}_std"),
    )
    return out.filter(F.col("_days") == days).drop("_days")


def regular_days(df: DataFrame, keys: Sequence[str], day: str, hour: str, hours: int = 24) -> DataFrame:
    """Days holding each of ``hours`` clock hours exactly once (drops DST days)."""
    shape = df.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("periods"), F.count_distinct(hour).alias("unique_hours")
    )
    return shape.filter((F.col("periods") == hours) & (F.col("unique_hours") == hours)).select(*keys, day)


def only_regular_days(df: DataFrame, keys: Sequence[str], day: str, hour: str, hours: int = 24) -> DataFrame:
    return df.join(regular_days(df, keys, day, hour, hours), [*keys, day], "left_semi")


def last_active_lags(
    decisions: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    day: str,
    hour: str,
    decision_hour: str,
    values: Sequence[str],
    n: int,
) -> DataFrame:
    """The last ``n`` active hours strictly before the decision on its own day.

    Newest first as ``{value}_lag_k`` with ``lag_k_available`` flags; a day has
    at most 24 hours, so each (day, decision) group is small by construction.
    """
    pairs = decisions.join(history, [*keys, day]).filter(F.col(hour) < F.col(decision_hour))
    group = [*keys, day, decision_hour]
    ranked = pairs.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(hour).desc()))
    ).filter(F.col("_rn") <= n)
    first = values[0]
    aggs: list[Column] = [
        F.count(F.lit(1)).cast("int").alias("n_lags"),
        F.avg(first).alias(f"{first}_lag_mean"),
        F.stddev_pop(first).alias(f"{first}_lag_std"),
        F.coalesce(F.regr_slope(F.col(first), -F.col("_rn")), F.lit(0.0)).alias(f"{first}_lag_trend"),
    ]
    for k in range(1, n + 1):
        at = F.col("_rn") == k
        aggs += [F.max(F.when(at, F.col(v))).alias(f"{v}_lag_{k}") for v in values]
        aggs.append(F.coalesce(F.max(at.cast("int")), F.lit(0)).alias(f"lag_{k}_available"))
    return ranked.groupBy(*group).agg(*aggs)


def trajectories(df: DataFrame, keys: Sequence[str], lead: str, values: Sequence[str], out: str = "trajectory") -> DataFrame:
    """One row per decision with its future covariates in lead order (bounded by the horizon)."""
    items = F.array_sort(F.collect_list(F.struct(lead, *values)))
    return df.groupBy(*keys).agg(items.alias(out), F.count(F.lit(1)).cast("int").alias("remaining_hours"))


def trajectory_rows(df: DataFrame, keys: Sequence[str], column: str, base: str, residual: str) -> DataFrame:
    """Trajectory arrays back to rows with a non-negative corrected prediction."""
    rows = df.select(*keys, F.inline(column))
    return rows.withColumn("prediction", F.greatest(F.col(base) + F.col(residual), F.lit(0.0)))


def horizon_fanout(df: DataFrame, ts: str, horizons: int) -> DataFrame:
    """Each target hour repeated for leads ``1..horizons`` with its decision instant."""
    fan = df.withColumn("horizon_hours", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    return fan.withColumn("as_of_utc", F.col(ts) - F.make_dt_interval(F.lit(0), F.col("horizon_hours")))


def last_observed(
    fan: DataFrame, series: DataFrame, keys: Sequence[str], ts: str, value: str, available: str, out: str
) -> DataFrame:
    """Attach the newest completed hour, ``horizon + 1`` hours before the target."""
    observed = series.select(
        *keys, F.col(ts).alias("_obs"), F.col(value).alias(out), F.col(available).alias(f"{out}_available_at_utc")
    )
    probe = fan.withColumn("_obs", F.col(ts) - F.make_dt_interval(F.lit(0), F.col("horizon_hours") + 1))
    return probe.join(observed, [*keys, "_obs"]).drop("_obs")


def location_columns(
    df: DataFrame, key: Sequence[str], location: str, locations: Sequence[str], values: Sequence[str], prefix: str = "spatial"
) -> DataFrame:
    """Per-location values as columns: one conditional aggregation in place of a join per location."""
    return df.groupBy(*key).agg(
        *[
            F.max(F.when(F.col(location) == loc, F.col(v))).alias(f"{prefix}_{loc}_{v}")
            for loc in locations
            for v in values
        ]
    )


def pivot_hours(df: DataFrame, keys: Sequence[str], hour: str, value: str, hours: Sequence[int], prefix: str) -> DataFrame:
    """Long to ``{prefix}_hHH`` columns with a literal hour list (no extra job)."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(hour) == h, F.col(value))).alias(f"{prefix}_h{h:02d}") for h in hours]
    )


def intraday_features(hourly: DataFrame, keys: Sequence[str], version: str = "v2") -> DataFrame:
    """Decision-by-target rows of the intraday price problem.

    ``hourly`` carries keys, ``valid_time_utc``, ``delivery_date_local``,
    ``hour_local``, ``da_price`` and ``id_price``. Every lookup is an equi-join;
    the features of a decision are computed once and then joined to its targets.
    """
    if version not in ("v1", "v2"):
        raise ValueError("version must be 'v1' or 'v2'")
    keys = list(keys)
    day, hour = "delivery_date_local", "hour_local"
    series = hourly.dropna(subset=["da_price", "id_price"]).withColumn("spread", F.col("id_price") - F.col("da_price"))
    regular = only_regular_days(series, keys, day, hour)
    decisions = regular.filter(F.col(hour) < 23).select(
        *keys, F.col("valid_time_utc").alias("as_of_utc"), day,
        F.col(hour).alias("decision_hour_local"), F.col("da_price").alias("decision_da_price"),
    )
    values = ["id_price", "spread"]
    windows = recent_windows(decisions, series, keys, "valid_time_utc", values, 6, (7, 14))
    stats: dict[str, Column] = {}
    for v, name in (("id_price", "intraday_last6"), ("spread", "spread_last6")):
        stats |= array_stats(F.col(f"{v}_window"), name)
        stats |= {f"{v}_lag_{k}": F.element_at(f"{v}_window", -k) for k in range(1, 7)}
        for back in ("d7", "d14"):
            past = array_stats(F.col(f"{v}_{back}w"), f"{name}_{back}")
            stats |= {k: c for k, c in past.items() if k.endswith(("_mean", "_std"))}
        if version == "v2":
            stats |= enriched_window_stats(F.col(f"{v}_window"), name)
    features = windows.withColumns(stats)
    derived = {
        "intraday_last6_mean_minus_d7": F.col("intraday_last6_mean") - F.col("intraday_last6_d7_mean"),
        "spread_last6_mean_minus_d7": F.col("spread_last6_mean") - F.col("spread_last6_d7_mean"),
    }
    if version == "v2":
        for back in ("d7", "d14"):
            past = F.col(f"intraday_last6_{back}_mean")
            derived[f"intraday_last6_mean_ratio_{back}"] = ratio_or_sentinel(F.col("intraday_last6_mean"), past)
            derived[f"intraday_last6_mean_ratio_{back}_valid"] = (F.abs(past) > 1e-8).cast("int")
        derived["intraday_last6_mean_minus_d14"] = F.col("intraday_last6_mean") - F.col("intraday_last6_d14_mean")
    features = features.withColumns(derived)

    da_day = regular.groupBy(*keys, day).agg(
        F.avg("da_price").alias("day_mean"), F.stddev_pop("da_price").alias("day_std"),
        F.min("da_price").alias("day_min"), F.max("da_price").alias("day_max"),
    )
    history = series.select(*keys, day, hour, "valid_time_utc", *values)
    lagged = same_clock_history(
        regular.select(*keys, day, hour, "valid_time_utc", "da_price", *values), history, keys, day, hour, values, (1, 7, 14),
        instant="valid_time_utc",
    )
    targets = lagged.join(da_day, [*keys, day]).select(
        *keys, day, F.col(hour).alias("target_hour_local"), F.col("valid_time_utc").alias("target_valid_time_utc"),
        (F.col("valid_time_utc") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("target_available_at_utc"),
        "da_price", (F.col("da_price") - F.col("day_mean")).alias("target_minus_day_mean"),
        "day_mean", "day_std", "day_min", "day_max",
        *[f"{v}_d{k}" for v in values for k in (1, 7, 14)],
        F.col("id_price").alias("target_id_price"), F.col("spread").alias("target_spread"),
    )
    rows = decision_targets(decisions, targets, keys, day, "decision_hour_local", "target_hour_local")
    rows = rows.join(features, [*keys, "as_of_utc"])
    if version == "v2":
        steps = F.col("lead_hours") + 1  # the current hour is unfinished
        rows = rows.withColumns(
            {
                "intraday_ar1_forecast": ar1_forecast(F.col("id_price_window"), steps),
                "spread_ar1_forecast": ar1_forecast(F.col("spread_window"), steps),
                "da_target_minus_decision": F.col("da_price") - F.col("decision_da_price"),
            }
        )
    return rows.drop(*[f"{v}_{w}" for v in values for w in ("window", "d7w", "d14w")])

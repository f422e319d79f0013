"""Resampling, canonical joins, reshaping and set operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.functions.calendar import hours


def resample_hourly(df: DataFrame, keys: Sequence[str], ts: str, value: str, status: str | None = None,
                    usable: str = "usable") -> DataFrame:
    """Readings to hours: mean, interval count, all-usable status, energy and availability."""
    aggs: list[Column] = [F.avg(value).alias("power_mean_w"), F.count(value).cast("int").alias("intervals")]
    if status is not None:
        all_usable = F.bool_and(F.coalesce(F.col(status) == usable, F.lit(False)))
        aggs.append(F.when(all_usable, usable).otherwise("excluded").alias("quality_status"))
    hourly = df.filter(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc("hour", ts).alias("valid_time_utc")).agg(*aggs)
    return hourly.withColumns(
        {"energy_kwh": F.col("power_mean_w") / 1000.0, "available_at_utc": F.col("valid_time_utc") + hours(1)}
    )


def complete_hours(hourly: DataFrame, intervals: int = 4) -> DataFrame:
    """Hours with every reading present."""
    return hourly.filter((F.col("intervals") == intervals) & F.col("power_mean_w").isNotNull())


def unpivot_profiles(df: DataFrame, ids: Sequence[str], profiles: Sequence[str], name: str = "site_id", value: str = "power_w") -> DataFrame:
    """Profile columns to rows in one pass over the source."""
    return df.unpivot(list(ids), list(profiles), name, value)


def coarse_steps(df: DataFrame, keys: Sequence[str], ts: str, step_hours: int = 1) -> DataFrame:
    """Keep stamps whose predecessor is missing or at least ``step_hours`` earlier; of equal stamps one row.

    A predecessor that close lies in the same bucket or the one before, so each
    bucket's first stamp and the last of the bucket before decide: one partial
    aggregation and one join, no lag over a whole series.
    """
    micros = 3_600_000_000 * step_hours
    rows = df.withColumn("_b", F.floor(F.unix_micros(ts) / F.lit(micros)))
    edges = rows.groupBy(*keys, "_b").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    none = F.lit(None).cast("timestamp")
    own = F.struct(F.col("_b").alias("_b"), F.col("_first").alias("_first"), none.alias("_before"))
    after = F.struct((F.col("_b") + 1).alias("_b"), none.alias("_first"), F.col("_last").alias("_before"))
    marks = edges.select(*keys, F.inline(F.array(own, after))).groupBy(*keys, "_b").agg(
        F.max("_first").alias("_first"), F.max("_before").alias("_before")
    )
    near = rows.join(marks, [*keys, "_b"])
    crowded_inside = F.col("_first") < F.col(ts)
    crowded_before = F.coalesce(F.unix_micros(ts) - F.unix_micros("_before") < micros, F.lit(False))
    return near.filter(~crowded_inside & ~crowded_before).dropDuplicates([*keys, "_b"]).drop("_b", "_first", "_before")


def outer_on_time(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Full outer join of sources that are each unique on the key, as one keyed aggregation.

    The sources go into one tagged union, so all share a single exchange however
    many they are. A key that a source holds twice stops the query.
    """
    keys = list(key)
    own = [[c for c in f.columns if c not in keys] for f in frames]
    kinds = [dict(f.dtypes) for f in frames]
    rows = []
    for i, f in enumerate(frames):
        columns = [F.col(c) if i == j else F.lit(None).cast(kinds[j][c]).alias(c) for j, names in enumerate(own) for c in names]
        rows.append(f.select(*keys, F.lit(i).alias("_source"), *columns))
    counts = [F.count_if(F.col("_source") == i) for i in range(len(frames))]
    merged = reduce(DataFrame.unionAll, rows).groupBy(*keys).agg(
        F.greatest(F.lit(0), *counts).alias("_most"), *[F.first(c, ignorenulls=True).alias(c) for names in own for c in names]
    )
    single = F.when(F.col("_most") <= 1, F.lit(True)).otherwise(F.raise_error(F.lit("a source holds a key twice")))
    return merged.filter(single).drop("_most")


def override_status(df: DataFrame, day: str, dates: Sequence[str], status: str, replacement: str) -> DataFrame:
    hit = F.date_format(day, "yyyy-MM-dd").isin(list(dates))
    return df.withColumn(status, F.when(hit, replacement).otherwise(F.col(status)))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    prefix = prefix or f"{column}_"
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def melt(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], name: str = "variant", value: str = "prediction") -> DataFrame:
    """Prediction columns to ``(variant, prediction)`` rows; the map renames columns."""
    renamed = df.select(*keys, *[F.col(c).alias(v) for c, v in columns.items()])
    return renamed.unpivot(list(keys), list(columns.values()), name, value)


def common_complete_days(left: DataFrame, right: DataFrame, day: str, hour: str, hours_wanted: Sequence[int]) -> DataFrame:
    """Days on which both sides hold exactly the wanted hours."""

    def complete(df: DataFrame) -> DataFrame:
        inside = F.col(hour).isin(list(hours_wanted))
        shape = df.groupBy(day).agg(
            F.count_distinct(F.when(inside, F.col(hour))).alias("_in"), F.count_if(~inside).alias("_out")
        )
        return shape.filter((F.col("_in") == len(hours_wanted)) & (F.col("_out") == 0)).select(day)

    return complete(left).intersect(complete(right))


def contiguous_days(df: DataFrame, keys: Sequence[str], day: str, hour: str) -> DataFrame:
    """Rows of days whose hours form one unbroken run."""
    shape = df.groupBy(*keys, day).agg(
        F.min(hour).alias("_lo"), F.max(hour).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count_distinct(hour).alias("_u")
    )
    whole = shape.filter((F.col("_hi") - F.col("_lo") + 1 == F.col("_n")) & (F.col("_n") == F.col("_u")))
    return df.join(whole.select(*keys, day), [*keys, day], "left_semi")


def complete_day_rows(df: DataFrame, keys: Sequence[str], day: str, hour: str, hours_wanted: Sequence[int], values: Sequence[str]) -> DataFrame:
    """Rows of the wanted hours on days that have all of them, once and without nulls."""
    inside = df.filter(F.col(hour).isin(list(hours_wanted)))
    nulls = F.lit(False)
    for v in values:
        nulls = nulls | F.col(v).isNull()
    shape = inside.groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(hour).alias("_u"), F.bool_or(nulls).alias("_bad")
    )
    good = shape.filter((F.col("_n") == len(hours_wanted)) & (F.col("_u") == len(hours_wanted)) & ~F.col("_bad"))
    return inside.join(good.select(*keys, day), [*keys, day], "left_semi")


def forecast_matrix(curve: DataFrame, updates: DataFrame, keys: Sequence[str], hour: str = "hour_local") -> DataFrame:
    """Day-ahead curve seen from every execution hour, overridden by revealed updates.

    ``curve``: keys, hour, ``value``. ``updates``: keys, ``decision_hour_local``,
    ``lead_hours``, ``update``. An update decided at ``d`` is used from hour
    ``d + 1`` for target ``d + lead`` when both stay inside the day.
    """
    grid = curve.withColumn("execution_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    revealed = updates.select(
        *keys,
        (F.col("decision_hour_local") + 1).alias("execution_hour"),
        (F.col("decision_hour_local") + F.col("lead_hours")).alias(hour),
        "update",
    ).filter((F.col("execution_hour") < 24) & (F.col(hour) < 24))
    out = grid.join(revealed, [*keys, "execution_hour", hour], "left")
    return out.withColumn("value", F.coalesce("update", "value")).drop("update")


def coverage_reasons(spine: DataFrame, day: str, checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """First failing check per calendar day, else ``used``.

    Each check is ``(reason, days that pass)``; order is priority.
    """
    out = spine
    reason = F.lit(None).cast("string")
    for i, (name, passing) in enumerate(checks):
        out = out.join(passing.select(day, F.lit(True).alias(f"_ok{i}")).distinct(), day, "left")
        reason = F.coalesce(reason, F.when(F.col(f"_ok{i}").isNull(), name))
    return out.select(*spine.columns, F.coalesce(reason, F.lit("used")).alias("status"))

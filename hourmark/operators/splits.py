"""Whole-week, rolling-origin and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.calendar import LOCAL_TZ, local_time, season
from hourmark.functions.numeric import draw
from hourmark.params import SEASONS


def week_start(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.to_date(F.date_trunc("week", local_time(ts, tz)))


def week_table(df: DataFrame, ts: str, tz: str = LOCAL_TZ) -> DataFrame:
    """One row per present local week: start, dense index, season of its first hour.

    The index window runs over distinct weeks only (about 52 rows a year).
    """
    weeks = df.groupBy(week_start(F.col(ts), tz).alias("week_start")).agg(F.min(ts).alias("_first"))
    return weeks.select(
        "week_start",
        (F.dense_rank().over(Window.orderBy("week_start")) - 1).alias("week_index"),
        season(F.month(local_time(F.col("_first"), tz))).alias("season"),
    )


def with_week_index(df: DataFrame, ts: str, tz: str = LOCAL_TZ) -> DataFrame:
    weeks = F.broadcast(week_table(df, ts, tz))  # one row per calendar week: the rows need no shuffle
    return df.withColumn("week_start", week_start(F.col(ts), tz)).join(weeks, "week_start")


def _shuffled(weeks: DataFrame, seed: int) -> DataFrame:
    """Weeks of each season in a seeded pseudo-random order, with the season's size."""
    by_season = Window.partitionBy("season")
    order = [draw(F.col("week_index"), F.lit(0), seed), F.col("week_index")]
    return weeks.withColumns(
        {"position": F.row_number().over(by_season.orderBy(*order)) - 1, "weeks_in_season": F.count(F.lit(1)).over(by_season)}
    )


def seasonal_split(weeks: DataFrame, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Train/validation/test by whole weeks in every season, at least one week each.

    Seasons with fewer than three weeks get a null split for callers to reject.
    """
    if abs(sum(shares) - 1.0) > 1e-9 or min(shares) < 0:
        raise ValueError("shares must be non-negative and sum to one")
    ordered = _shuffled(weeks, seed)
    n = F.col("weeks_in_season")
    test = F.greatest(F.lit(1), F.bround(n * F.lit(shares[2])).cast("int"))
    validation = F.greatest(F.lit(1), F.bround(n * F.lit(shares[1])).cast("int"))
    label = (
        F.when(n < 3, F.lit(None).cast("string"))
        .when(F.col("position") < test, "test")
        .when(F.col("position") < test + validation, "validation")
        .otherwise("train")
    )
    return ordered.withColumn("split", label)


def seasonal_folds(weeks: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Every week in exactly one of ``k`` folds, dealt round-robin inside its season."""
    if k < 2:
        raise ValueError("k must be at least 2")
    ordered = _shuffled(weeks, seed)
    index = F.lit(None).cast("int")
    for i, name in enumerate(SEASONS):
        index = F.when(F.col("season") == name, i).otherwise(index)
    return ordered.withColumn("fold", F.pmod(F.col("position") + index, F.lit(k)).cast("int"))


def rolling_origin(days: DataFrame, day: str, initial: int, block: int) -> DataFrame:
    """Fold of each day after the initial window and the fold's cutoff (its first day).

    Runs on distinct days, one row per calendar day.
    """
    ranked = days.select(day).distinct().withColumn("_i", F.row_number().over(Window.orderBy(day)) - 1)
    later = ranked.filter(F.col("_i") >= initial).withColumn("fold", F.floor((F.col("_i") - initial) / F.lit(block)).cast("int"))
    return later.withColumn("cutoff", F.min(day).over(Window.partitionBy("fold"))).drop("_i")


def rolling_origin_rows(df: DataFrame, folds: DataFrame, day: str) -> DataFrame:
    """Train rows (strictly before the cutoff) and test rows of every fold.

    A training row is repeated for each fold it precedes; the fold list (days
    divided by block length) is one array, so no join is needed for that.
    """
    cutoffs = folds.agg(F.collect_set(F.struct("fold", "cutoff"))).scalar()
    later = F.filter(F.col("_folds"), lambda f: f["cutoff"] > F.col(day))
    train = df.withColumn("_folds", cutoffs).select("*", F.inline(later)).drop("_folds").withColumn("part", F.lit("train"))
    test = df.join(folds.select(day, "fold", "cutoff"), day).withColumn("part", F.lit("test"))
    return train.unionByName(test)


def expanding_months(df: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Rows before each refit month (train) and inside it (test), months ``first`` to ``last``."""
    months = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    reached = F.filter(months, lambda m: F.col(day) < F.add_months(m, 1))
    joined = df.withColumn("refit_month", F.explode(reached))
    return joined.withColumn("part", F.when(F.col(day) < F.col("refit_month"), "train").otherwise("test"))


def chronological_split(df: DataFrame, day: str, train_end: str, test_start: str, test_end: str | None = None) -> DataFrame:
    """Train up to ``train_end``, test in its own later window (to the last day unless it ends); overlap is refused."""
    if not train_end < test_start <= (test_end or test_start):
        raise ValueError("the test window must start after the training window and not be empty")
    d = F.col(day)
    later = d >= F.lit(test_start).cast("date")
    if test_end is not None:
        later = later & (d <= F.lit(test_end).cast("date"))
    part = F.when(d <= F.lit(train_end).cast("date"), "train").when(later, "test")
    return df.withColumn("part", part).filter(F.col("part").isNotNull())


def missing_seasons(weeks: DataFrame, minimum: int) -> DataFrame:
    """Seasons with too few weeks to fill every split."""
    return weeks.groupBy("season").agg(F.count(F.lit(1)).alias("weeks")).filter(F.col("weeks") < minimum)


def column_list(*groups: Sequence[str]) -> list[str]:
    """Ordered union of column lists without duplicates."""
    return list(dict.fromkeys(c for g in groups for c in g))

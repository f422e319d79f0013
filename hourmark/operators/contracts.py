"""Contracts as data: each returns rule names with violation counts, in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised by :func:`enforce` when a rule is violated."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows violating each rule (a true condition is a violation): ``(rule, violations)``."""
    wide = df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return wide.selectExpr(f"stack({len(rules)}, {pairs}) as (rule, violations)")


def null_rules(columns: Sequence[str]) -> dict[str, Column]:
    return {f"null_{c}": F.col(c).isNull() for c in columns}


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, as one contract row."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return repeated.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
        F.lit("duplicate_" + "_".join(keys)).alias("rule"), "violations"
    )


def gap_count(df: DataFrame, keys: Sequence[str], ts: str, step_hours: int = 1) -> DataFrame:
    """Stamps without a successor one step later, except each series' last.

    An anti-join on the shifted key: no window over a whole series.
    """
    stamps = df.select(*keys, ts).distinct()
    successor = stamps.select(*keys, (F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(step_hours))).alias(ts))
    open_ends = stamps.join(successor, [*keys, ts], "left_anti")
    ends = open_ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return ends.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
        F.lit("gap_" + ts).alias("rule"), "violations"
    )


def series_contract(df: DataFrame, keys: Sequence[str], ts: str, required: Sequence[str]) -> DataFrame:
    """Nulls, unique stamps and hourly continuity of a series."""
    require_columns(df, [*keys, ts, *required])
    return (
        rule_counts(df, null_rules([ts, *required]))
        .unionByName(duplicate_count(df, [*keys, ts]))
        .unionByName(gap_count(df, keys, ts))
    )


def causality_contract(df: DataFrame, feature_times: Sequence[str], target_time: str, valid: str,
                       as_of: str = "as_of_utc", lead: str | None = None, leads: tuple[int, int] = (1, 23)) -> DataFrame:
    """Features published, target hidden, target in the future, lead in range."""
    rules = {f"late_{c}": F.coalesce(F.col(c) > F.col(as_of), F.lit(True)) for c in feature_times}
    rules["target_already_known"] = F.coalesce(F.col(target_time) <= F.col(as_of), F.lit(True))
    rules["target_not_future"] = F.coalesce(F.col(valid) <= F.col(as_of), F.lit(True))
    if lead is not None:
        rules["lead_out_of_range"] = ~F.col(lead).between(*leads)
    return rule_counts(df, rules)


def enforce(violations: DataFrame) -> None:
    """Action: raise when any rule has violations (at most one row per rule is read)."""
    broken = violations.filter(F.col("violations") > 0).collect()
    if broken:
        raise ContractError(", ".join(f"{r['rule']}={r['violations']}" for r in broken))


def unexpected_and_missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, labelled ``missing`` (left only) or ``extra``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("status", F.lit("missing")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("status", F.lit("extra"))
    )


def unequal_points(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Frozen-artifact guard: rows whose value differs or exists on one side only."""
    a = left.select(*keys, F.col(value).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_r"))
    joined = a.join(b, list(keys), "full_outer")
    return joined.agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("different")
    )


def equal_pair_counts(df: DataFrame, variant: str, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct keys per variant (all variants must score the same pairs)."""
    return df.groupBy(variant).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(*[F.col(k) for k in keys]).alias("pairs")
    )

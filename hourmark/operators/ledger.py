"""Settlement of hourly schedules and comparison of strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourmark.functions.numeric import percentage_or_null
from hourmark.operators.ranking import exact_quantiles, quantile_and_tail, value_ranks
from hourmark.params import BILLING_DAYS, DAY_IMPORT, MWH_TO_KWH, NIGHT_IMPORT, NO_CHARGES, Charges, Site, rate


def physical_exchange(df: DataFrame, load: str, charge: str, pv: str, discharge: str, curtailment: str) -> DataFrame:
    """Net exchange with the grid split into import and export."""
    net = F.col(load) + F.col(charge) - (F.col(pv) - F.col(curtailment)) - F.col(discharge)
    return df.withColumns(
        {
            "grid_exchange_kwh": net, "grid_import_kwh": F.greatest(net, F.lit(0.0)), "grid_export_kwh": F.greatest(-net, F.lit(0.0)),
        }
    )


def charge_economics(price: Column, reference: Column, charges: Charges) -> dict[str, Column]:
    """Daytime grid charging against buying the same input energy overnight."""
    now = price / MWH_TO_KWH + rate(charges, DAY_IMPORT)
    overnight = F.greatest(reference, F.lit(0.0)) / MWH_TO_KWH + rate(charges, NIGHT_IMPORT)
    return {
        "grid_charge_cost_eur_per_kwh": now, "overnight_cost_eur_per_kwh": overnight,
        "grid_charge_cheaper": F.coalesce(now < overnight, F.lit(False)).cast("int"),
    }


def simple_ledger(hourly: DataFrame, keys: Sequence[str], da_price: str = "da_price", id_price: str = "id_price",
                  cost: str = "battery_cost_eur_per_kwh") -> DataFrame:
    """Day-ahead, deviation and battery cost of each (day, strategy)."""
    deviation = F.col("load_kwh") - F.col("actual_pv_kwh") - F.col("discharge_kwh") - F.col("position_kwh")
    da = F.col(da_price) / MWH_TO_KWH * F.col("position_kwh")
    intraday = F.col(id_price) / MWH_TO_KWH * deviation
    battery = F.col(cost) * F.col("discharge_kwh")
    return hourly.groupBy(*keys).agg(
        F.sum(da).alias("day_ahead_cost_eur"), F.sum(intraday).alias("intraday_cost_eur"), F.sum(battery).alias("battery_cost_eur"),
        F.sum(da + intraday + battery).alias("total_cost_eur"), F.sum("load_kwh").alias("load_kwh"),
        F.sum("discharge_kwh").alias("discharge_kwh"), F.sum(deviation).alias("deviation_kwh"),
    )


def physical_ledger(hourly: DataFrame, keys: Sequence[str], reference: str, scenario: Site, charges: Charges = NO_CHARGES,
                    da_price: str = "da_price", id_price: str = "id_price") -> DataFrame:
    """Full settlement: positions, deviations, grid charges, terminal recharge, degradation.

    One projection and one aggregation; ``soc_violation`` flags days whose
    actions leave the battery's limits, ``curtailment_violation`` counts hours
    that curtail less than nothing or more than the PV there is (settled as clipped).
    Each charge that is due by day, on import or on export has its own cost column.
    """
    allowed = F.greatest(F.lit(0.0), F.least("curtailment_kwh", "actual_pv_kwh"))
    beyond = F.abs(F.col("curtailment_kwh") - allowed) > 1e-7
    rows = physical_exchange(
        hourly.withColumn("_beyond", beyond.cast("int")).withColumn("curtailment_kwh", allowed),
        "load_kwh", "charge_kwh", "actual_pv_kwh", "discharge_kwh", "curtailment_kwh",
    )
    deviation = F.col("grid_exchange_kwh") - F.col("position_kwh")
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col(da_price) / MWH_TO_KWH * F.col("position_kwh")).alias("day_ahead_cost_eur"),
        F.sum(F.col(id_price) / MWH_TO_KWH * deviation).alias("intraday_cost_eur"),
        F.sum("charge_kwh").alias("charge_kwh"), F.sum("discharge_kwh").alias("discharge_kwh"),
        F.sum("grid_import_kwh").alias("import_kwh"), F.sum("grid_export_kwh").alias("export_kwh"),
        F.sum("curtailment_kwh").alias("curtailment_kwh"), F.sum("_beyond").alias("curtailment_violation"), F.max(reference).alias("_reference"),
    )
    capacity = float(scenario.battery_kwh)
    raw = F.lit(capacity) + F.col("charge_kwh") * scenario.charge_efficiency - F.col("discharge_kwh") / scenario.discharge_efficiency
    out = sums.withColumns(
        {
            "terminal_soc_kwh": F.greatest(F.lit(0.0), F.least(F.lit(capacity), raw)),
            "soc_violation": ((raw < -1e-7) | (raw > capacity + 1e-7)).cast("int"),
        }
    )
    refill = (F.lit(capacity) - F.col("terminal_soc_kwh")) / scenario.charge_efficiency
    price = F.greatest("_reference", F.lit(0.0))
    out = out.withColumns(
        {
            "terminal_recharge_kwh": refill,
            "night_energy_cost_eur": refill * price / MWH_TO_KWH,
            "night_grid_cost_eur": refill * rate(charges, NIGHT_IMPORT),
            "degradation_cost_eur": F.col("discharge_kwh") * scenario.degradation_eur_per_kwh,
        }
    )
    metered = {"day": "import_kwh", "import": "import_kwh", "export": "export_kwh"}
    fees = {f"{name}_cost_eur": F.col(metered[due]) * value for name, due, value in charges if due in metered}
    out = out.withColumns(fees) if fees else out
    parts = ["day_ahead_cost_eur", "intraday_cost_eur", "night_energy_cost_eur", "night_grid_cost_eur", "degradation_cost_eur", *fees]
    total = F.col(parts[0])
    for c in parts[1:]:
        total = total + F.col(c)
    return out.withColumn("total_cost_eur", total).drop("_reference")


def strategy_summary(daily: DataFrame, strategy: Sequence[str], cost: str, alpha: float = 0.95, sums: Sequence[str] = ()) -> DataFrame:
    """Total, mean, sample std, p95, tail mean and maximum of daily cost per strategy."""
    strategy = list(strategy)
    base = daily.groupBy(*strategy).agg(
        F.count(F.lit(1)).alias("days"), F.sum(cost).alias("total_cost"), F.avg(cost).alias("mean_daily_cost"),
        F.stddev_samp(cost).alias("std_daily_cost"), F.max(cost).alias("max_daily_cost"), *[F.sum(c).alias(f"total_{c}") for c in sums],
    )
    return base.join(quantile_and_tail(daily, strategy, cost, alpha, "p95_daily_cost", "cvar_daily_cost"), strategy)


def paired_days(daily: DataFrame, strategy: str, baseline: str, day: Sequence[str], cost: str) -> DataFrame:
    """Each candidate's day beside the baseline's, with the saving."""
    base = daily.filter(F.col(strategy) == baseline).select(*day, F.col(cost).alias("baseline_cost"))
    other = daily.filter(F.col(strategy) != baseline).select(*day, F.col(strategy), F.col(cost).alias("candidate_cost"))
    return other.join(base, list(day)).withColumn("saving", F.col("baseline_cost") - F.col("candidate_cost"))


def unmatched_days(daily: DataFrame, strategy: str, names: Sequence[str], baseline: str, day: Sequence[str]) -> DataFrame:
    """Days on which a named candidate lacks the baseline or the reverse (must be empty)."""
    days = daily.filter(F.col(strategy) == baseline).select(*day).distinct()
    expected = days.withColumn(strategy, F.explode(F.array(*[F.lit(n) for n in names])))
    have = daily.select(*day, strategy).distinct()
    keys = [*day, strategy]
    return expected.join(have, keys, "left_anti").unionByName(have.join(days, list(day), "left_anti"))


def paired_savings(pairs: DataFrame, strategy: Sequence[str], day: str, alpha: float = 0.95, tol: float = 1e-9) -> DataFrame:
    """Saving statistics per candidate, including the baseline's worst days."""
    strategy = list(strategy)
    keys = [*strategy, "baseline_cost"]
    ranks = value_ranks(pairs, strategy, "baseline_cost").select(*keys, "n_total", (F.col("n_total") - F.col("n_cum")).alias("_above"))
    tail = F.greatest(F.lit(1), F.ceil(F.round((1.0 - alpha) * F.col("n_total"), 9)))
    among_ties = F.row_number().over(Window.partitionBy(*keys).orderBy(day))  # equal costs only
    flagged = pairs.join(ranks, keys).withColumn("_worst", F.col("_above") + among_ties <= tail)
    saving = F.col("saving")
    base = flagged.groupBy(*strategy).agg(
        F.count(F.lit(1)).alias("days"), F.sum(saving).alias("total_saving"), F.avg(saving).alias("mean_saving"),
        F.avg((saving > tol).cast("double")).alias("share_cheaper"), F.avg((saving < -tol).cast("double")).alias("share_dearer"),
        F.avg(F.when(F.col("_worst"), saving)).alias("mean_saving_worst_days"),
    )
    return base.join(exact_quantiles(pairs, strategy, "saving", [0.5], ["median_saving"]), strategy)


def opportunity_capture(daily: DataFrame, strategy: str, cost: str, rule: str, oracle: str, steps: Sequence[str]) -> DataFrame:
    """Each strategy's saving against the rule as a share of the rule-to-oracle gap.

    Also the incremental effect over the previous rung of the ladder ``steps``.
    """
    names = [rule, *steps, oracle]
    totals = daily.agg(*[F.sum(F.when(F.col(strategy) == n, F.col(cost))).alias(f"_t{i}") for i, n in enumerate(names)])
    gap = F.col("_t0") - F.col(f"_t{len(names) - 1}")
    rows = [
        F.struct(
            F.lit(n).alias(strategy), F.col(f"_t{i}").alias("total_cost"), (F.col("_t0") - F.col(f"_t{i}")).alias("saving_vs_rule"),
            (F.col(f"_t{max(i - 1, 0)}") - F.col(f"_t{i}")).alias("incremental_saving"),
            (F.col(f"_t{i}") - F.col(f"_t{len(names) - 1}")).alias("gap_to_oracle"),
            percentage_or_null(F.col("_t0") - F.col(f"_t{i}"), gap).alias("capture_pct"),
        )
        for i, n in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*rows)))


def trailing_gap(pairs: DataFrame, strategy: Sequence[str], day: str, days: int = 14) -> DataFrame:
    """Trailing mean of the daily cost gap (daily rows of one strategy)."""
    w = Window.partitionBy(*strategy).orderBy(day).rowsBetween(1 - days, 0)
    return pairs.withColumns({"window_days": F.count(F.lit(1)).over(w), "trailing_saving": F.avg("saving").over(w)})


def tariff_rates(charges: Charges) -> dict[str, Column]:
    """Import price by day and night, and the yearly charges per billed day."""
    return {
        "daytime_import_eur_per_kwh": F.lit(rate(charges, DAY_IMPORT)), "nighttime_import_eur_per_kwh": F.lit(rate(charges, NIGHT_IMPORT)),
        "fixed_daily_eur": F.lit(rate(charges, ("year",)) / BILLING_DAYS),
    }

"""Plans, settlement and comparison rules."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourmark.operators import ledger, planning
from hourmark.params import CHARGES_2025, NIGHT_IMPORT, rate, site

SC = site()


def _day(spark, price, pv=None, cost=0.06, day=date(2024, 1, 1)):
    pv = pv or [0.0] * 24
    rows = [(day, h, float(price[h]), float(pv[h]), float(cost)) for h in range(24)]
    return spark.createDataFrame(rows, "day date, hour int, price double, pv double, battery_cost_eur_per_kwh double")


def _greedy(price, cost):
    """Fractional knapsacks by hand."""
    load = np.array([5.0 if 6 <= h < 22 else 0.0 for h in range(24)])
    left = 200.0 - load.sum()
    for h in sorted(range(6, 22), key=lambda h: (price[h], h)):
        take = min(15.0, left)
        load[h] += take
        left -= take
    out, energy = np.zeros(24), 44.16
    for h in sorted(range(6, 22), key=lambda h: (-price[h], h)):
        if price[h] / 1000 <= cost:
            break
        take = min(5.0, energy)
        out[h] = take
        energy -= take
    return load, out


@pytest.mark.parametrize("seed", range(4))
def test_merit_order_equals_greedy(spark, seed):
    price = np.random.default_rng(seed).normal(60, 50, 24).round(1)
    rows = planning.merit_order_plan(_day(spark, price), ["day"], "hour", "price", "pv", SC).orderBy("hour").collect()
    load, out = _greedy(price, 0.06)
    np.testing.assert_allclose([r["load_kwh"] for r in rows], load)
    np.testing.assert_allclose([r["discharge_kwh"] for r in rows], out)
    np.testing.assert_allclose([r["position_kwh"] for r in rows], load - out)


def test_no_discharge_below_cost(spark):
    rows = planning.merit_order_plan(_day(spark, [50.0] * 24), ["day"], "hour", "price", "pv", SC)
    assert rows.agg(F.sum("discharge_kwh")).first()[0] == 0.0


@pytest.mark.parametrize("target", [80.0, 100.0, 200.0, 320.0])
def test_capped_allocation_meets_target(spark, target):
    df = spark.createDataFrame([(1, float(w)) for w in range(1, 17)], "k int, w double")
    rows = planning.capped_allocation(df, ["k"], "w", target, 5.0, 20.0).collect()
    got = np.array([r["load_kwh"] for r in rows])
    assert got.sum() == pytest.approx(target) and got.min() >= 5.0 - 1e-12 and got.max() <= 20.0 + 1e-12
    weights = np.array([r["w"] for r in rows])
    inner = (got > 5.0 + 1e-9) & (got < 20.0 - 1e-9)
    if inner.sum() > 1:
        ratio = got[inner] / weights[inner]
        assert ratio.max() - ratio.min() < 1e-9


def _scored(spark, score, cost=0.06):
    rows = [(date(2024, 1, 1), h, float(score[h]), cost) for h in range(24)]
    return spark.createDataFrame(rows, "day date, hour int, price_score double, battery_cost_eur_per_kwh double")


def test_rule_prefers_earlier_hour_on_ties(spark):
    plan = planning.rule_plan(_scored(spark, [40.0] * 24), ["day"], "hour", SC).orderBy("hour").collect()
    assert [r["price_rank"] for r in plan] == list(range(1, 17))
    loads = [r["load_kwh"] for r in plan]
    assert sum(loads) == pytest.approx(200.0) and loads == sorted(loads, reverse=True)
    assert all(r["position_kwh"] == r["load_kwh"] for r in plan)


def test_stored_energy_is_summed_along_the_plan(spark):
    hours = [(1, 6, 0.0, 5.0), (1, 7, 2.0, 0.0), (2, 6, 0.0, 44.16), (2, 7, 0.0, 0.0)]
    plan = spark.createDataFrame(hours, "day int, hour int, charge_kwh double, discharge_kwh double")
    rows = {(r["day"], r["hour"]): r for r in planning.stored_energy(plan, ["day"], "hour", SC).collect()}
    assert rows[1, 6]["soc_start_kwh"] == pytest.approx(44.16) and rows[1, 6]["soc_end_kwh"] == pytest.approx(44.16 - 5 / 0.98)
    assert rows[1, 7]["soc_end_kwh"] == pytest.approx(44.16 - 5 / 0.98 + 2 * 0.98)
    assert [rows[k]["soc_violation"] for k in sorted(rows)] == [0, 0, 1, 1]


def test_curtailment_beyond_pv_is_counted(spark):
    cols = "day int, night double, load_kwh double, discharge_kwh double, actual_pv_kwh double, da_price double, id_price double, curtailment_kwh double"
    rows = spark.createDataFrame([(1, 50.0, 5.0, 0.0, 3.0, 1.0, 1.0, 3.0), (1, 50.0, 5.0, 0.0, 3.0, 1.0, 1.0, 4.0)], cols)
    rows = rows.withColumns({"charge_kwh": F.lit(0.0), "position_kwh": F.lit(0.0)})
    got = ledger.physical_ledger(rows, ["day"], "night", SC).first()
    assert (got["curtailment_violation"], got["curtailment_kwh"]) == (1, 6.0)


def test_night_reference_example(spark):
    """Fourteen nights of nine labels; the first, at -100, is floored to zero."""
    rows = []
    for i in range(14):
        price = -100.0 if i == 0 else i + 1.0
        evening = date(2025, 1, 1) + timedelta(days=i)
        rows += [(evening, h, price) for h in (22, 23)] + [(evening + timedelta(days=1), h, price) for h in range(7)]
    df = spark.createDataFrame(rows, "day date, hour int, price double")
    got = planning.night_reference(df, [], "day", "hour", "price").collect()
    assert [(r["reference_day"], r["night_reference"]) for r in got] == [(date(2025, 1, 16), pytest.approx(104 / 14))]


def test_battery_cost_floors_negative_night(spark):
    df = spark.createDataFrame([(-40.0,), (80.0,)], "p double").withColumns(planning.battery_cost(F.col("p"), SC, CHARGES_2025))
    low, high = df.orderBy("p").collect()
    assert low["night_energy_eur_per_kwh"] == 0.0
    assert high["night_energy_eur_per_kwh"] == pytest.approx(0.08 / 0.9604)
    assert high["terminal_soc_value_eur_per_kwh"] == pytest.approx((0.08 + rate(CHARGES_2025, NIGHT_IMPORT)) / 0.98)


def test_tariff_applies_to_import_only(spark):
    row = (date(2024, 1, 1), 50.0, 20.0, 0.0, 30.0, 100.0, 100.0)
    cols = "day date, night double, load_kwh double, discharge_kwh double, actual_pv_kwh double, da_price double, id_price double"
    rows = spark.createDataFrame([row], cols).withColumns({"charge_kwh": F.lit(0.0), "curtailment_kwh": F.lit(0.0), "position_kwh": F.lit(20.0)})
    r = ledger.physical_ledger(rows, ["day"], "night", SC, CHARGES_2025).first()
    assert (r["import_kwh"], r["export_kwh"], r["network_cost_eur"]) == (0.0, 10.0, 0.0)
    assert r["total_cost_eur"] == pytest.approx(20 * 0.1 - 30 * 0.1)


def test_impossible_battery_use_is_flagged(spark):
    rows = spark.createDataFrame([(1, 50.0, 0.0, 60.0, 0.0, 1.0, 1.0)], "day int, night double, load_kwh double, discharge_kwh double, actual_pv_kwh double, da_price double, id_price double")
    rows = rows.withColumns({"charge_kwh": F.lit(0.0), "curtailment_kwh": F.lit(0.0), "position_kwh": F.lit(0.0)})
    assert ledger.physical_ledger(rows, ["day"], "night", SC).first()["soc_violation"] == 1


def test_simple_ledger_units(spark):
    rows = spark.createDataFrame([("s", 100.0, 50.0, 0.07, 12.0, 2.0, 3.0, 6.0)], "strategy string, da_price double, id_price double, battery_cost_eur_per_kwh double, load_kwh double, discharge_kwh double, actual_pv_kwh double, position_kwh double")
    r = ledger.simple_ledger(rows, ["strategy"]).first()
    assert r["day_ahead_cost_eur"] == pytest.approx(0.6)
    assert r["intraday_cost_eur"] == pytest.approx(0.05)  # deviation of 1 kWh at 50 EUR/MWh
    assert r["battery_cost_eur"] == pytest.approx(0.14)


def test_unmatched_days_are_reported(spark):
    daily = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0), ("b", 3, 1.0)], "s string, d int, c double")
    got = sorted((r["s"], r["d"]) for r in ledger.unmatched_days(daily, "s", ["a", "b"], "a", ["d"]).collect())
    assert got == [("b", 2), ("b", 3)]


def test_capture_is_null_without_gap(spark):
    daily = spark.createDataFrame([("rule", 10.0), ("da", 10.0), ("oracle", 10.0)], "s string, c double")
    assert {r["capture_pct"] for r in ledger.opportunity_capture(daily, "s", "c", "rule", "oracle", ["da"]).collect()} == {None}


def test_infeasible_scenario_is_refused():
    with pytest.raises(ValueError):
        site(daily_load_kwh=10.0)
    with pytest.raises(ValueError):
        rate([("levies", "import", -0.1)], ("import",))

"""Bootstrap, copula and conformal rules."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourmark.functions import numeric as N
from hourmark.operators import metrics, uncertainty

DAY, HOUR = "day", "hour"


@pytest.fixture(scope="module")
def library(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=i), h, v, 10 * v, -5 * v) for i, v in enumerate((-1.0, 1.0)) for h in (6, 7)]
    return spark.createDataFrame(rows, "source_day date, hour int, pv double, price double, spread double")


@pytest.fixture(scope="module")
def points(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=i), h, 5.0, 50.0, 1.0) for i in range(1, 6) for h in (6, 7)]
    return spark.createDataFrame(rows, "day date, hour int, pv_point double, price_point double, spread_point double")


TARGETS = {"pv_s": ("pv_point", "pv"), "price_s": ("price_point", "price"), "spread_s": ("spread_point", "spread")}


def test_targets_share_one_source_day(points, library):
    draws = uncertainty.sample_source_days(points, library, DAY, 50, 1)
    rows = uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, TARGETS).collect()
    assert len(rows) == 50 * 5 * 2  # the second library day is itself a target: it sees only the first
    by_scenario = {}
    for r in rows:
        error = r["pv_s"] - 5.0
        assert r["price_s"] - 50.0 == pytest.approx(10 * error)
        assert r["spread_s"] - 1.0 == pytest.approx(-5 * error)
        assert r["source_day"] < r["day"]
        by_scenario.setdefault((r["day"], r["scenario_id"]), set()).add(error)
    assert all(len(v) == 1 for v in by_scenario.values())


def test_first_day_sees_only_earlier_days(points, library):
    draws = uncertainty.sample_source_days(points, library, DAY, 20, 2)
    early = draws.filter(F.col(DAY) == "2024-01-02").select("source_day").distinct().collect()
    assert [r["source_day"] for r in early] == [date(2024, 1, 1)]


def test_centring_uses_eligible_days(points, library):
    draws = uncertainty.sample_source_days(points, library, DAY, 20, 2)
    rows = uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, TARGETS, centre=True)
    # one eligible day: its own mean is subtracted, nothing is left
    only = rows.filter(F.col(DAY) == "2024-01-02").select("pv_s").distinct().collect()
    assert [r["pv_s"] for r in only] == [5.0]
    later = rows.filter(F.col(DAY) > "2024-01-03").select("pv_s").distinct().collect()
    assert sorted(r["pv_s"] for r in later) == [4.0, 6.0]


def test_bounds_clip_scenarios(points, library):
    draws = uncertainty.sample_source_days(points, library, DAY, 20, 2)
    rows = uncertainty.bootstrap_scenarios(points, library, draws, DAY, HOUR, TARGETS, bounds={"pv_s": (4.5, 5.5)})
    assert {r["pv_s"] for r in rows.select("pv_s").distinct().collect()} == {4.5, 5.5}


def test_draws_are_uniform(spark):
    n, cells = 40000, 29
    for seed, ordinal in ((1, 19700), (42, 19701), (7, 0)):
        counts = (
            spark.range(n).select(N.draw_index(F.col("id"), F.lit(ordinal), seed, F.lit(cells)).alias("i")).groupBy("i").count().collect()
        )
        observed = np.array([r["count"] for r in counts])
        assert len(observed) == cells
        chi2 = ((observed - n / cells) ** 2 / (n / cells)).sum()
        assert chi2 < 70  # 28 degrees of freedom, far tail


def test_draws_are_not_serially_related(spark):
    rows = spark.range(20000).select(N.draw_uniform(F.col("id"), F.lit(5), 3).alias("a"), N.draw_uniform(F.col("id") + 1, F.lit(5), 3).alias("b"))
    r = rows.agg(F.corr("a", "b").alias("c"), F.avg("a").alias("m")).first()
    assert abs(r["c"]) < 0.03 and abs(r["m"] - 0.5) < 0.02


def test_seasonal_weights_keep_distant_days(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2023-12-30')) as source_day")
    target = spark.sql("select date'2024-01-01' as day")
    w = uncertainty.seasonal_weights(target, days, DAY, 20.0, 0.1)
    stats = w.agg(F.sum("probability").alias("s"), F.min("probability").alias("lo"), F.count(F.lit(1)).alias("n")).first()
    assert stats["s"] == pytest.approx(1.0) and stats["lo"] >= 0.1 / stats["n"] - 1e-12
    near = {str(r["source_day"]): r["probability"] for r in w.filter("source_day in (date'2023-12-30', date'2023-07-01', date'2023-01-02')").collect()}
    assert near["2023-12-30"] > 5 * near["2023-07-01"] and near["2023-01-02"] > 5 * near["2023-07-01"]
    diagnostics = uncertainty.sampling_diagnostics(w, DAY).first()
    assert 1 < diagnostics["effective_sample_days"] <= diagnostics["eligible_days"]


def test_weighted_sampling_follows_probabilities(spark):
    w = spark.createDataFrame([(date(2024, 2, 1), date(2024, 1, d), p) for d, p in ((1, 0.1), (2, 0.6), (3, 0.3))], "day date, source_day date, probability double")
    counts = {r["source_day"].day: r["count"] / 20000 for r in uncertainty.sample_weighted(w, DAY, 20000, 9).groupBy("source_day").count().collect()}
    for d, p in ((1, 0.1), (2, 0.6), (3, 0.3)):
        assert counts[d] == pytest.approx(p, abs=0.02)


def test_copula_uses_one_row_for_all_targets(spark):
    ranks = spark.createDataFrame(
        [(date(2024, 1, i + 1), h, t, u) for i, u in enumerate((0.1, 0.5, 0.9)) for h in (6, 7) for t in ("pv", "price")], "source_day date, hour int, target string, u double"
    )
    quantiles = spark.createDataFrame([(date(2024, 1, 4), h, t, [3.0, 1.0, 2.0]) for h in (6, 7) for t in ("pv", "price")], "day date, hour int, target string, q array<double>")
    draws = uncertainty.sample_source_days(quantiles.select("day"), ranks, DAY, 30, 4)
    rows = uncertainty.copula_scenarios(draws, ranks, quantiles, DAY, HOUR, "target", (0.1, 0.5, 0.9)).collect()
    assert {round(r["value"], 9) for r in rows} <= {1.0, 2.0, 3.0}  # crossing repaired, ranks inverted
    per = {}
    for r in rows:
        per.setdefault(r["scenario_id"], set()).add(r["u"])
    assert all(len(v) == 1 for v in per.values()) and len(per) == 30


def _fit(spark, rows, levels=(0.1, 0.5, 0.9)):
    df = spark.createDataFrame(rows, "grp int, actual double, q10 double, q50 double, q90 double")
    return df, uncertainty.conformal_fit(df, "grp", "actual", ["q10", "q50", "q90"], levels)


def test_conformal_widens_to_the_data(spark):
    df, fitted = _fit(spark, [(0, y, 4.0, 5.0, 6.0) for y in [0.0] * 5 + [10.0] * 5])
    out = uncertainty.conformal_apply(df, fitted, "grp", ["q10", "q50", "q90"], (0.1, 0.5, 0.9)).select("q10", "q50", "q90").distinct().collect()
    assert [tuple(r) for r in out] == [(0.0, 5.0, 10.0)]


def test_conformal_never_shrinks(spark):
    _, fitted = _fit(spark, [(0, 5.0, 0.0, 5.0, 10.0)] * 20)
    assert fitted.first()["correction"] == 0.0


def test_conformal_by_group_and_bounds(spark):
    rows = [(0, 5.0, 2.0, 5.0, 8.0)] * 10 + [(1, y, 4.0, 5.0, 6.0) for y in [-3.0] * 5 + [13.0] * 5]
    df, fitted = _fit(spark, rows)
    out = uncertainty.conformal_apply(df, fitted, "grp", ["q10", "q50", "q90"], (0.1, 0.5, 0.9), 0.0, 10.0).select("grp", "q10", "q50", "q90").distinct().collect()
    assert {r["grp"]: (r["q10"], r["q50"], r["q90"]) for r in out} == {0: (2.0, 5.0, 8.0), 1: (0.0, 5.0, 10.0)}


def test_asymmetric_levels_are_refused():
    with pytest.raises(ValueError):
        uncertainty.central_pairs((0.1, 0.5, 0.8))


def test_crps_matches_definition(spark):
    rng = np.random.default_rng(0)
    members, actual = rng.normal(size=31), 0.4
    df = spark.createDataFrame([(1, float(v), actual) for v in members], "k int, v double, y double")
    want = np.abs(members - actual).mean() - np.abs(members[:, None] - members[None, :]).mean() / 2
    assert metrics.ensemble_crps(df, ["k"], "v", "y").first()["crps"] == pytest.approx(want)


def test_block_bootstrap_draws_whole_blocks(spark):
    daily = spark.createDataFrame([("s", date(2024, 1, 1) + timedelta(days=i), float(i)) for i in range(17)], "k string, day date, v double")
    rows = uncertainty.block_bootstrap(daily, "day", ["v"], 7, 25, 3, ["k"])
    sizes = {r["count"] for r in rows.groupBy("resample").count().collect()}
    assert sizes == {17}
    first = [r["v"] for r in rows.filter("resample = 0").collect()]
    assert min(first) >= 0 and max(first) <= 16

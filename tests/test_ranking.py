"""Distributed ranks, quantiles and tail means against brute force, hot groups included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from hourmark.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    # group 0 holds most rows; values repeat, so ties matter
    group = np.where(rng.random(6000) < 0.7, 0, rng.integers(1, 6, 6000))
    frame = pd.DataFrame({"g": group.astype("int64"), "v": np.round(rng.normal(0, 20, 6000), 1)})
    return frame, spark.createDataFrame(frame).repartition(7)


@pytest.mark.parametrize("held,sketch,slack", [(50_000, 4096, 0.003), (40, 64, 0.08), (10, 16, 0.3), (100_000, 16, 0.0)])
def test_quantiles_equal_numpy(skewed, held, sketch, slack, monkeypatch):
    """Also with brackets that are narrowed several times, and with ones so narrow that positions fall outside and are ranked in full."""
    frame, df = skewed
    monkeypatch.setattr(ranking.located, "__defaults__", (held, sketch, slack))
    got = ranking.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.995, 1.0], ["a", "b", "c", "d", "e"]).toPandas().set_index("g")
    want = frame.groupby("g")["v"].quantile([0.0, 0.1, 0.5, 0.995, 1.0]).unstack()
    np.testing.assert_allclose(got.loc[want.index, list("abcde")].to_numpy(), want.to_numpy(), atol=1e-9)


def test_quantiles_without_groups(skewed):
    frame, df = skewed
    got = ranking.exact_quantiles(df, [], "v", [0.25], ["q"]).first()["q"]
    assert got == pytest.approx(frame["v"].quantile(0.25))


def test_average_ranks_equal_pandas(skewed):
    frame, df = skewed
    got = ranking.average_ranks(df, ["g"], "v").select("g", "v", "rank").distinct().toPandas()
    want = frame.assign(rank=frame.groupby("g")["v"].rank(method="average")).drop_duplicates(["g", "v"])
    merged = want.merge(got, on=["g", "v"], suffixes=("", "_got"))
    assert len(merged) == len(want)
    np.testing.assert_allclose(merged["rank"], merged["rank_got"])


@pytest.mark.parametrize("alpha", [0.5, 0.95, 0.999])
def test_tail_means_equal_sort(skewed, alpha):
    frame, df = skewed
    got = ranking.upper_tail_means(df, ["g"], "v", alpha).toPandas().set_index("g")["cvar"]
    for g, part in frame.groupby("g")["v"]:
        count = max(1, int(np.ceil(round((1 - alpha) * len(part), 9))))
        assert got[g] == pytest.approx(np.sort(part)[-count:].mean())


def test_quantile_and_tail_in_one_pass(skewed):
    frame, df = skewed
    got = ranking.quantile_and_tail(df, ["g"], "v", 0.9, "q", "t").toPandas().set_index("g")
    tail = ranking.upper_tail_means(df, ["g"], "v", 0.9).toPandas().set_index("g")["cvar"]
    for g, part in frame.groupby("g")["v"]:
        assert got.loc[g, "q"] == pytest.approx(part.quantile(0.9))
        assert got.loc[g, "t"] == pytest.approx(tail[g])


def test_minimum_cvar_equals_threshold_search(skewed):
    frame, df = skewed
    got = ranking.minimum_cvar(df, ["g"], "v", 0.9).toPandas().set_index("g")["cvar"]
    for g, part in frame.groupby("g")["v"]:
        losses = part.to_numpy()
        want = min(eta + np.maximum(losses - eta, 0).mean() / 0.1 for eta in np.unique(losses))
        assert got[g] == pytest.approx(want)


def test_order_statistic_is_numpy_higher(skewed):
    from pyspark.sql import functions as F

    frame, df = skewed
    position = F.ceil((F.col("n_total") - 1) * 0.83) + 1
    got = ranking.order_statistic(df, ["g"], "v", position).toPandas().set_index("g")["value"]
    for g, part in frame.groupby("g")["v"]:
        assert got[g] == pytest.approx(np.quantile(part, 0.83, method="higher"))


def test_constant_and_single_value_groups(spark):
    df = spark.createDataFrame([(1, 5.0)] * 9 + [(2, 7.0)], "g int, v double")
    got = {r["g"]: r["q"] for r in ranking.exact_quantiles(df, ["g"], "v", [0.3], ["q"]).collect()}
    assert got == {1: 5.0, 2: 7.0}


def test_latest_per_key_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 3, "z"), ("b", 0, 0, "w")], "k string, t int, id int, v string")
    got = {r["k"]: r["v"] for r in ranking.latest_per_key(df, ["k"], ["t", "id"]).collect()}
    assert got == {"a": "z", "b": "w"}


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_result_does_not_depend_on_partitioning(spark, skewed, partitions):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = ranking.exact_quantiles(df.repartition(partitions), ["g"], "v", [0.37], ["q"]).orderBy("g").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    reference = ranking.exact_quantiles(df, ["g"], "v", [0.37], ["q"]).orderBy("g").collect()
    assert rows == reference


def test_a_value_with_most_copies_does_not_hold_up_the_search(spark, monkeypatch):
    values = np.concatenate([np.full(9000, 5.0), np.linspace(5.0, 6.0, 3000), np.linspace(-1, 5.0, 500)])
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values})).repartition(5)
    monkeypatch.setattr(ranking.located, "__defaults__", (60, 64, 0.05))
    monkeypatch.setattr(ranking, "SMALL", 20)
    levels = [0.01, 0.3, 0.77, 0.9, 0.999]
    got = ranking.exact_quantiles(df, ["g"], "v", levels, list("abcde")).first()
    np.testing.assert_allclose([got[c] for c in "abcde"], np.quantile(values, levels))
    tail = ranking.upper_tail_means(df, ["g"], "v", 0.5).first()
    assert tail["cvar"] == pytest.approx(np.sort(values)[-tail["tail_count"]:].mean())


def test_two_exchanges_per_quantile(spark):
    """The sketches and the counts are exchanged once each, whatever the number of levels."""
    df = spark.range(20_000).selectExpr("id % 3 as g", "cast(id * 7919 % 10007 as double) as v")
    seen = []
    settled = ranking._settled
    try:
        ranking._settled = lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or settled(d)
        ranking.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"]).collect()
    finally:
        ranking._settled = settled
    assert len(seen) == 2 and seen[0] == 1 and seen[1] <= 2

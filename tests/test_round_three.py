"""Models from fold sums, one-exchange merges, stored tables, file manifests and the newer streams."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourmark.operators import audit, features, fitting, metrics, shaping
from hourmark.sources import sinks
from hourmark.streaming import streams

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    n = 1500
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 100, 0]
    y = 2 + x @ [1, -0.3, 4] + rng.normal(size=n) * (0.5 + np.abs(x[:, 0] - 5))
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "fold": rng.integers(0, 4, n)})
    return frame, spark.createDataFrame(frame).repartition(3)


def test_fold_sums_equal_separate_fits(sample):
    frame, df = sample
    fits = fitting.leave_one_out_fits(fitting.fold_sums(df, "fold", X, "y"), X)
    for k, fit in fits.items():
        part = frame[frame.fold != k]
        w = np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[X]]), part.y, rcond=None)[0]
        np.testing.assert_allclose(fit.values, w, rtol=1e-9, atol=1e-9)
        assert fit.rows == len(part)
    scored = fitting.cross_fit_linear(df, "fold", X, "y").toPandas()
    want = [np.dot([1, *r[X]], fits[int(r.fold)].values) for _, r in scored.iterrows()]
    np.testing.assert_allclose(scored.prediction, want)


def test_fold_sums_take_one_exchange(sample):
    _, df = sample
    grouped = df.groupBy("fold").agg(F.sum(F.col("a") * F.col("b")))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(fold") == 1


def test_huber_equals_reweighting_by_hand(sample):
    frame, df = sample
    plain = fitting.leave_one_out_fits(fitting.fold_sums(df, "fold", X, "y"), X)
    fits = fitting.huber_fits(df, "fold", X, "y")
    for k in (0, 3):
        part = frame[frame.fold != k]
        m, y, w = np.column_stack([np.ones(len(part)), part[X]]), part.y.to_numpy(), np.array(plain[k].values)
        delta = 1.35 * np.sqrt(plain[k].rss / plain[k].rows)
        for _ in range(300):
            s = np.minimum(1, delta / np.maximum(np.abs(y - m @ w), 1e-300))
            w = np.linalg.solve((m * s[:, None]).T @ m, (m * s[:, None]).T @ y)
        np.testing.assert_allclose(fits[k].values, w, rtol=1e-6, atol=1e-6)


def test_constant_and_doubled_features_are_harmless(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 1.0, 3.0 * k + 1) for k in range(20)], "a double, b double, c double, y double")
    fit = fitting.solve_sums(fitting.fold_sums(df, None, X, "y")[fitting.ALL], X)
    assert fit.values[3] == 0 and fit.values[1] + 2 * fit.values[2] == pytest.approx(3) and fit.rss == pytest.approx(0, abs=1e-6)
    assert fitting.fold_sums(df.limit(0), None, X, "y") == {}


def test_quantiles_are_calibrated_and_never_cross(sample):
    frame, df = sample
    levels = [0.1, 0.25, 0.5, 0.75, 0.9]
    model = fitting.quantile_fits(df, "fold", X, "y", levels)
    got = df.withColumn("q", model.columns("fold")).toPandas()
    q = np.array(got.q.tolist())
    assert (np.diff(q, axis=1) > 0).all()
    np.testing.assert_allclose((got.y.to_numpy()[:, None] <= q).mean(axis=0), levels, atol=0.05)
    loss = lambda q: np.mean([np.where(got.y >= q[:, i], t * (got.y - q[:, i]), (t - 1) * (got.y - q[:, i])).mean() for i, t in enumerate(levels)])
    assert loss(q) < 0.5 * loss(np.tile(np.quantile(got.y, levels), (len(got), 1)))
    assert all(b <= a * 1.0001 for a, b in zip(model.losses, model.losses[1:])) or model.losses[-1] < model.losses[0]
    assert df.limit(0).withColumn("q", fitting.quantile_fits(df.limit(0), "fold", X, "y", levels).columns("fold")).count() == 0


def test_outer_merge_takes_one_exchange_and_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, u string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double")
    c = spark.createDataFrame([(3, True)], "k int, w boolean")
    merged = shaping.outer_on_time([a, b, c], ["k"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, merged.collect())) == [(1, "x", None, None), (2, None, 5.0, None), (3, None, 6.0, True)]
    assert merged.columns == ["k", "u", "v", "w"]
    with pytest.raises(Exception, match="holds a key twice"):
        shaping.outer_on_time([a.unionAll(a), b], ["k"]).collect()


def test_correlation_without_a_join(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))
    rows = [(d, f"v{j}", float(values[d, j])) for d in range(40) for j in range(4)]
    matrix = metrics.correlation_matrix(spark.createDataFrame(rows, "day int, variable string, x double"), "day", "variable", "x")
    assert "Join" not in matrix._jdf.queryExecution().executedPlan().toString()
    got = {(r["variable_i"], r["variable_j"]): r["correlation"] for r in matrix.collect()}
    want = np.corrcoef(values.T)
    assert len(got) == 16
    for (i, j), c in got.items():
        assert c == pytest.approx(want[int(i[1]), int(j[1])], abs=1e-9)


def test_lags_on_a_stored_table_need_no_exchange(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(s, start + dt.timedelta(hours=h), float(h)) for s in ("p", "q") for h in range(96) if h != 30]
    df = spark.createDataFrame(rows, "site string, t timestamp_ntz, value double")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    stored = sinks.save_clock_table(df, f"t_{uuid.uuid4().hex}", ["site"], "t", 4, str(tmp_path / "clock"))
    lagged = features.clock_lags(stored, ["site"], "t", ["value"], [1, 2])
    assert "Exchange" not in lagged._jdf.queryExecution().executedPlan().toString()
    got = {(r["site"], r["value"]): (r["value_lag_1d"], r["value_lag_2d"]) for r in lagged.collect()}
    assert got["p", 54.0] == (None, 6.0) and got["q", 60.0] == (36.0, 12.0) and len(got) == len(rows)
    # two stored tables on the same key join where they lie
    other = sinks.save_table(df.withColumnRenamed("value", "other"), f"t_{uuid.uuid4().hex}", 4, ["site", "t"], path=str(tmp_path / "b"))
    own = sinks.save_table(df, f"t_{uuid.uuid4().hex}", 4, ["site", "t"], path=str(tmp_path / "a"))
    joined = own.hint("merge").join(other, ["site", "t"])
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == len(rows)


def test_an_altered_file_is_named(spark, tmp_path):
    folder = str(tmp_path / "data")
    df = spark.range(300).select((F.col("id") % 3).alias("day"), F.timestamp_seconds(F.col("id") * 60).alias("t"))
    df.repartition("day").write.partitionBy("day").parquet(folder)
    known = spark.createDataFrame(audit.file_manifest(spark, folder, "t").collect())
    assert known.agg(F.sum("rows")).first()[0] == 300 and audit.changed_files(spark, folder, known).count() == 0
    tree = {r["part"]: r["digest"] for r in audit.manifest_tree(known).collect()}
    victim = known.orderBy("path").first()["path"]
    name = victim.removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    data[40] ^= 1
    open(name, "wb").write(data)
    os.utime(name, (2_000_000_000, 2_000_000_000))
    spare = [f for f in os.listdir(os.path.dirname(name)) if f.endswith(".crc") or f.startswith(".")]
    for f in spare:
        os.replace(os.path.join(os.path.dirname(name), f), os.path.join(str(tmp_path), f))
    changed = [tuple(r) for r in audit.changed_files(spark, folder, known).collect()]
    assert changed == [(victim, "altered")]
    again = known.withColumn("sha256", F.when(F.col("path") == victim, "other").otherwise(F.col("sha256")))
    after = {r["part"]: r["digest"] for r in audit.manifest_tree(again).collect()}
    assert after[-1] != tree[-1] and sum(after[k] != tree[k] for k in tree if k != -1) == 1


def _files(spark, folder, batches, schema):
    """A file per batch, in order of time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/raw{k}")
        part = next(f for f in os.listdir(f"{folder}/raw{k}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.link(f"{folder}/raw{k}/{part}", f"{folder}/in/f{k:03}.parquet")
        os.utime(f"{folder}/in/f{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def _at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minutes)


def test_keep_last_stream_over_files_late_rows_and_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    schema = "k int, t timestamp, v int"
    batches = [
        [(1, _at(0), 10), (2, _at(1), 20), (1, _at(3), 11)],
        [(1, _at(10), 12), (3, _at(20), 30), (3, _at(20), 29)],
        [(4, _at(200), 40)],
        [(2, _at(2), 99), (5, _at(205), 50)],  # key 2 comes far behind the watermark and is dropped
        [(6, _at(500), 60)],
    ]
    _files(spark, folder, batches[:3], schema)

    def drain():
        source = streams.read_parquet_stream(spark, f"{folder}/in", f"{folder}/in/f000.parquet", "*.parquet", files_per_batch=1)
        streams.run_to_parquet(streams.keep_last_stream(source, ["k"], "t", "30 minutes", 1800), f"{folder}/out", f"{folder}/state")
        return sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{folder}/out").collect())

    assert drain() == [(1, 12), (2, 20), (3, 30)]
    for k, rows in enumerate(batches[3:], 3):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/raw{k}")
        part = next(f for f in os.listdir(f"{folder}/raw{k}") if f.endswith(".parquet"))
        os.link(f"{folder}/raw{k}/{part}", f"{folder}/in/f{k:03}.parquet")
        os.utime(f"{folder}/in/f{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    # resumed from the checkpoint: nothing comes out twice, keys 4 and 5 are closed by key 6
    assert drain() == [(1, 12), (2, 20), (3, 30), (4, 40), (5, 50)]


def test_joined_error_stream_keeps_its_state_level(spark, tmp_path):
    folder = str(tmp_path)
    batches = [[(k * 100 + i, _at(k * 120 + i), float(i)) for i in range(60)] for k in range(12)]
    _files(spark, folder, batches, "k int, t timestamp, v double")

    def source():
        return streams.read_parquet_stream(spark, f"{folder}/in", f"{folder}/in/f000.parquet", "*.parquet", files_per_batch=1)

    forecasts = source().select("k", (F.col("t") - F.expr("INTERVAL 10 MINUTES")).alias("u"), (F.col("v") + F.col("k") % 5).alias("f"))
    joined = streams.joined_error_stream(source(), forecasts, ["k"], "t", "u", "v", "f", "30 minutes", "1 hour", "30 minutes")
    query = streams.run_to_parquet(joined, f"{folder}/out", f"{folder}/state")
    sizes = [p["stateOperators"][-1]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"] > 0]
    held = [max(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"] > 0]
    assert len(sizes) >= 10 and max(held[4:]) <= max(held[:5])
    got = {r["window_start"].replace(tzinfo=None): (r["rows"], r["mae"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    rows = [(t, abs(k % 5)) for b in batches for k, t, _ in b]
    for k in range(9):
        start = _at(k * 120)
        part = [e for t, e in rows if start <= t < start + dt.timedelta(hours=1)]
        assert got[start.replace(tzinfo=None)] == (len(part), pytest.approx(np.mean(part)))

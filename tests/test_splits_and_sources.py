"""Splits, payload parsing, sinks, streams and the query catalogue."""

from __future__ import annotations

import json
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from hourmark.operators import audit, splits
from hourmark.plans import ENTRIES
from hourmark.sources import payloads, readers, sinks

TABLES = os.environ.get("HOURMARK_TABLES", "/root/testdata/sf0.001")


def _folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="module")
def year(spark):
    return spark.sql("select explode(sequence(timestamp'2023-12-31 23:00:00', timestamp'2024-12-30 22:00:00', interval 6 hours)) as t")


def test_weeks_stay_whole_and_fill_all_splits(year):
    weeks = splits.week_table(year, "t")
    split = splits.seasonal_split(weeks).cache()
    assert split.count() == weeks.count()
    table = {(r["season"], r["split"]) for r in split.select("season", "split").distinct().collect()}
    assert table == {(s, p) for s in ("winter", "spring", "summer", "autumn") for p in ("train", "validation", "test")}
    indices = sorted(r["week_index"] for r in split.collect())
    assert indices == list(range(len(indices)))


def test_every_week_is_tested_once(year):
    folds = splits.seasonal_folds(splits.week_table(year, "t"), 5).collect()
    assert len({r["week_index"] for r in folds}) == len(folds)
    for season in ("winter", "spring", "summer", "autumn"):
        assert {r["fold"] for r in folds if r["season"] == season} == set(range(5))


def test_thin_season_has_no_split(spark):
    weeks = splits.week_table(spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-12', interval 1 day)) as t"), "t")
    assert {r["split"] for r in splits.seasonal_split(weeks).collect()} == {None}
    assert splits.missing_seasons(weeks, 3).first()["season"] == "winter"


def test_rolling_origin_never_trains_on_the_future(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-20')) as d")
    folds = splits.rolling_origin(days, "d", 8, 5)
    rows = splits.rolling_origin_rows(days, folds, "d").collect()
    assert {r["fold"] for r in rows} == {0, 1, 2}
    assert all(r["d"] < r["cutoff"] for r in rows if r["part"] == "train")
    assert all(r["d"] >= r["cutoff"] for r in rows if r["part"] == "test")
    assert sum(r["part"] == "test" for r in rows) == 12


def test_overlapping_windows_are_refused(spark):
    with pytest.raises(ValueError):
        splits.chronological_split(spark.range(1), "d", "2024-05-01", "2024-04-01", "2024-06-01")


def _record(status="available", n=2):
    return {
        "run_init_utc": "2024-06-01T00:00:00Z", "available_at_utc": "2024-06-01T06:00:00Z", "status": status,
        "response": {"hourly": {"time": ["2024-06-01T01:00", "2024-06-01T02:00"], "value": [1.5, None][:n]}},
    }


def test_run_record_hours_and_status(spark):
    out = _folder()
    for i, record in enumerate([_record(), _record("unavailable")]):
        with open(f"{out}/r{i}.json", "w") as f:
            json.dump(record, f, indent=1)
    rows = payloads.run_rows(payloads.read_records(spark, out, payloads.run_record_schema(["value"])), ["value"]).orderBy("valid_time_utc").collect()
    assert [r["weather_forecast_value"] for r in rows] == [1.5, None]
    assert rows[0]["available_at_utc"].hour == 6 and rows[1]["valid_time_utc"].hour == 2


def test_misaligned_series_fails(spark):
    out = _folder()
    with open(f"{out}/r.json", "w") as f:
        json.dump(_record(n=1), f)
    rows = payloads.run_rows(payloads.read_records(spark, out, payloads.run_record_schema(["value"])), ["value"])
    with pytest.raises(Exception, match="not aligned"):
        rows.collect()


def test_missing_series_fails(spark):
    items = spark.createDataFrame([(0, [1000, 2000], [("A",)], [1.0, 2.0])], "position int, xAxisValues array<bigint>, name array<struct<en:string>>, data array<double>")
    rows = payloads.series_rows(items, {"A": "a"}).orderBy("valid_time_utc").collect()
    assert [r["a"] for r in rows] == [1.0, 2.0]
    with pytest.raises(Exception, match="required series"):
        payloads.series_rows(items, {"A": "a", "B": "b"}).collect()


def test_duplicate_runs_fail_compaction(spark):
    df = spark.sql("select timestamp'2024-01-01' as run_init_utc, timestamp'2024-01-02' as valid_time_utc, 1.0 as v")
    with pytest.raises(Exception, match="duplicate run"):
        sinks.compact_archive(df.unionByName(df), _folder() + "/x")


def test_bad_stamps_become_null(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("junk",), (None,)], "s string").select(readers.parse_utc(F.col("s")).alias("t")).collect()
    assert [r["t"] is None for r in rows] == [False, True, True]


def test_manifest_hash_ignores_order(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("t"), (F.col("id") * 2).alias("v"))
    one = audit.manifest(df, "t", "x").first()
    two = audit.manifest(df.orderBy(F.col("v").desc()).repartition(7).select("v", "t"), "t", "x").first()
    assert one == two
    assert audit.manifest(df.withColumn("v", F.col("v") + 1), "t", "x").first()["content_hash"] != one["content_hash"]


def test_catalogue_names_and_statements():
    assert len(ENTRIES) > 180
    for name, entry in ENTRIES.items():
        assert re.fullmatch(r"[a-z][a-z0-9_]+", name)
        if entry.body:
            assert entry.sql.lstrip().upper().startswith(("WITH", "SELECT"))


#: A spread of operators small enough for every test run; set HOURMARK_ALL=1 for all.
SAMPLE = [
    "flagship_persistence_scores", "a04_run_archive_json", "a06_series_payload", "b04_holidays", "b12_freshest_layer", "c02_day_ahead_context",
    "c05_coarse_steps", "c16_coverage_reasons", "d04_hour_lags", "d06_asof_run", "e13_site_descriptives", "e17_metrics_over_sets", "e27_ensemble_crps",
    "e41_step_histogram", "f03_last_active_lags", "f05_week_index", "f08_latest_per_key", "h01_horizon_fanout", "i01_seasonal_split", "i03_rolling_rows",
    "j04_seasonal_weights", "j09_conformal_fit", "k08_load_bounds", "s01_hourly_stream", "dataset_canonical_hourly", "dataset_mpc_pv",
]
CHOSEN = [n for n, e in ENTRIES.items() if e.body] if os.environ.get("HOURMARK_ALL") else SAMPLE


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not present")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    from check_queries import compare, connect

    entry = ENTRIES[name]
    problem = compare(entry.run(spark, TABLES).toPandas(), connect(TABLES).execute(entry.sql).df())
    assert problem is None, problem

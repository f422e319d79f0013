"""Availability, as-of selection and calendar rules on small hand-made frames."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import contracts, features, pointintime, shaping

ARCHIVE = "location_id string, run_init_utc timestamp, available_at_utc timestamp, valid_time_utc timestamp, temperature_2m double"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def archive(spark):
    rows = [
        (loc, at(run), at(pub), at("2024-06-01 12:00"), value)
        for loc in ("north", "south")
        for run, pub, value in (("2024-05-31 00:00", "2024-05-31 06:00", 10.0), ("2024-06-01 00:00", "2024-06-01 06:00", 20.0))
    ]
    return spark.createDataFrame(rows, ARCHIVE)


def test_run_is_invisible_before_publication(spark, archive):
    requests = spark.createDataFrame(
        [(1, at("2024-06-01 05:00"), at("2024-06-01 12:00")), (2, at("2024-06-01 07:00"), at("2024-06-01 12:00"))],
        "request int, as_of_utc timestamp, valid_time_utc timestamp",
    )
    picked = pointintime.asof_per_location(requests, archive, ["request"], 2)
    got = {r["request"]: (r["temperature_2m_mean"], r["temperature_2m_std"]) for r in pointintime.spatial_summary(picked, ["request"], ["temperature_2m"]).collect()}
    assert got == {1: (10.0, 0.0), 2: (20.0, 0.0)}


def test_missing_location_drops_request(spark, archive):
    requests = spark.createDataFrame([(1, at("2024-06-01 07:00"), at("2024-06-01 12:00"))], "request int, as_of_utc timestamp, valid_time_utc timestamp")
    only_north = archive.filter("location_id = 'north'")
    assert pointintime.asof_per_location(requests, only_north, ["request"], 2).count() == 0


def test_latest_run_may_be_arbitrarily_old(spark):
    runs = spark.createDataFrame([(at("2024-01-01 00:00"), at("2024-01-01 06:00")), (at("2024-03-01 00:00"), at("2024-03-01 06:00"))], "run_init_utc timestamp, available_at_utc timestamp")
    decisions = spark.createDataFrame(
        [(i, at(t)) for i, t in enumerate(["2024-01-01 05:59", "2024-01-01 06:00", "2024-02-28 00:00", "2024-03-01 05:00", "2024-03-01 06:00"])], "d int, as_of_utc timestamp"
    )
    got = {r["d"]: r["run_init_utc"].month for r in pointintime.latest_available_run(decisions, runs, ["d"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 3}


def test_mask_hides_late_and_unknown_values(spark):
    df = spark.createDataFrame([(1.0, at("2024-01-01 10:00")), (2.0, at("2024-01-01 12:00")), (3.0, None)], "v double, at timestamp")
    got = [r["v"] for r in pointintime.mask_unavailable(df, F.lit("2024-01-01 11:00").cast("timestamp"), {"at": ["v"]}).collect()]
    assert got == [1.0, None, None]


def test_freshest_layer_needs_completeness(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, 6.0), (1.0, None, 5.0, 6.0), (1.0, None, None, 6.0)], "a_x double, a_y double, b_x double, b_y double"
    ).withColumns({"a_at": F.lit("2024-01-01").cast("timestamp"), "b_at": F.lit("2024-01-01").cast("timestamp")})
    rows = pointintime.freshest_complete_layer(df, ["x", "y"], [(24, "a_", "a_at"), (48, "b_", "b_at")], F.lit("2024-01-02").cast("timestamp"), "f_").collect()
    assert [(r["f_x"], r["f_lead_hours"]) for r in rows] == [(1.0, 24), (5.0, 48), (None, None)]


@pytest.mark.parametrize(
    ("day", "expected"),
    [("2024-01-15", "2024-01-14 10:00"), ("2024-07-15", "2024-07-14 09:00"), ("2024-04-01", "2024-03-31 09:00"), ("2024-10-28", "2024-10-27 10:00")],
)
def test_decision_is_eleven_on_the_wall_clock(spark, day, expected):
    got = spark.range(1).select(C.decision_time(F.lit(day).cast("date")).cast("string").alias("t")).first()["t"]
    assert got == f"{expected}:00"


@pytest.mark.parametrize(("year", "easter"), [(1995, "1995-04-16"), (2000, "2000-04-23"), (2024, "2024-03-31"), (2025, "2025-04-20"), (2038, "2038-04-25"), (2049, "2049-04-18"), (1981, "1981-04-19")])
def test_easter_dates(spark, year, easter):
    assert str(spark.range(1).select(C.easter_sunday(F.lit(year)).alias("e")).first()["e"]) == easter


def test_holidays_of_2024(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as d")
    got = {str(r["d"]) for r in days.filter(C.is_german_holiday(F.col("d"))).collect()}
    assert got == {"2024-01-01", "2024-03-29", "2024-04-01", "2024-05-01", "2024-05-09", "2024-05-20", "2024-10-03", "2024-12-25", "2024-12-26"}


def test_dst_days_are_not_regular(spark):
    hours = spark.sql("select explode(sequence(timestamp'2024-03-29 23:00:00', timestamp'2024-04-01 21:00:00', interval 1 hour)) as t")
    local = hours.select(C.local_date(F.col("t")).alias("day"), C.local_hour(F.col("t")).alias("hour"))
    got = {r["day"] for r in features.regular_days(local, [], "day", "hour").collect()}
    assert got == {date(2024, 3, 30), date(2024, 4, 1)}


def test_new_year_wraps_in_calendar_distance(spark):
    pair = spark.sql("select date'2023-12-31' as a, date'2024-01-01' as b, date'2023-03-01' as c, date'2024-03-01' as e")
    row = pair.select(
        C.circular_distance(C.calendar_ordinal(F.col("a")), C.calendar_ordinal(F.col("b"))).alias("x"),
        C.circular_distance(C.calendar_ordinal(F.col("c")), C.calendar_ordinal(F.col("e"))).alias("y"),
    ).first()
    assert (row["x"], row["y"]) == (1, 0)


def test_coarse_steps_follow_previous_row(spark):
    minutes = [0, 60, 75, 90, 105, 120, 181, 240, 300]
    df = spark.createDataFrame([(datetime(2025, 1, 1, m // 60, m % 60),) for m in minutes], "t timestamp")
    kept = sorted(r["t"].hour * 60 + r["t"].minute for r in shaping.coarse_steps(df, [], "t").collect())
    want = [m for i, m in enumerate(minutes) if i == 0 or m - minutes[i - 1] >= 60]
    assert kept == want


def test_lags_leave_gaps_null(spark):
    df = spark.createDataFrame([("s", at("2024-01-01 00:00"), 1.0), ("s", at("2024-01-01 02:00"), 3.0)], "k string, t timestamp, v double")
    got = {r["t"].hour: (r["v_lag_1h"], r["v_lag_2h"]) for r in features.hour_lags(df, ["k"], "t", ["v"], [1, 2]).collect()}
    assert got == {0: (None, None), 2: (None, 1.0)}


def test_contracts_report_and_raise(spark):
    df = spark.createDataFrame(
        [("a", at("2024-01-01 00:00"), 1.0), ("a", at("2024-01-01 00:00"), 2.0), ("a", at("2024-01-01 02:00"), None)], "k string, t timestamp, v double"
    )
    got = {r["rule"]: r["violations"] for r in contracts.series_contract(df, ["k"], "t", ["v"]).collect()}
    assert got == {"null_t": 0, "null_v": 1, "duplicate_k_t": 1, "gap_t": 1}
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.series_contract(df, ["k"], "t", ["v"]))
    with pytest.raises(KeyError):
        contracts.series_contract(df, ["k"], "t", ["absent"])


def test_causality_contract_counts(spark):
    df = spark.createDataFrame(
        [(at("2024-01-01 10:00"), at("2024-01-01 09:00"), at("2024-01-01 12:00"), at("2024-01-01 11:00"), 1), (at("2024-01-01 10:00"), at("2024-01-01 11:00"), at("2024-01-01 10:00"), at("2024-01-01 10:00"), 0)],
        "as_of_utc timestamp, f timestamp, target timestamp, valid timestamp, lead int",
    )
    got = {r["rule"]: r["violations"] for r in contracts.causality_contract(df, ["f"], "target", "valid", lead="lead").collect()}
    assert got == {"late_f": 1, "target_already_known": 1, "target_not_future": 1, "lead_out_of_range": 1}


def test_intraday_rows_are_causal(spark):
    hours = spark.sql("select explode(sequence(timestamp'2023-12-01 00:00:00', timestamp'2024-01-29 23:00:00', interval 1 hour)) as valid_time_utc")
    i = (F.unix_seconds("valid_time_utc") - 1701388800) / 3600
    hourly = hours.withColumns(
        {"da_price": F.lit(50.0) + i * 0.2, "delivery_date_local": C.local_date(F.col("valid_time_utc")), "hour_local": C.local_hour(F.col("valid_time_utc"))}
    ).withColumn("id_price", F.col("da_price") + F.sin(i / 3.0))
    rows = features.intraday_features(hourly, [], "v2").cache()
    counts = contracts.causality_contract(rows, [], "target_available_at_utc", "target_valid_time_utc", lead="lead_hours").collect()
    assert rows.count() > 0 and all(r["violations"] == 0 for r in counts)
    first = rows.orderBy("as_of_utc", "lead_hours").first()
    last_hour = hourly.filter(F.col("valid_time_utc") == F.lit(first["as_of_utc"]) - C.hours(1)).first()
    assert first["id_price_lag_1"] == pytest.approx(last_hour["id_price"])
    assert rows.groupBy("as_of_utc", "target_valid_time_utc").count().filter("count > 1").count() == 0
    rows.unpersist()

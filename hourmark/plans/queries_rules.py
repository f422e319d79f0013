"""Queries for filters, predicates and contracts (C-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import contracts, features, pointintime, shaping
from hourmark.plans import series as S
from hourmark.plans.catalog import query
from hourmark.plans.queries_calendar import AS_OF_SQL, FULL24, FULL48, LAYERS, SOLAR_SQL, solar_rows
from hourmark.plans.series import berlin

GROUPS = {"f24_available_at": ["f24_da_price", "f24_pv_kwh"], "f48_available_at": ["f48_da_price", "f48_pv_kwh"]}
MASK_SPEC = "valid_time_utc:t f24_da_price:f f24_pv_kwh:f f48_da_price:f f48_pv_kwh:f"


def mask_sql(as_of: str) -> str:
    return ", ".join(f"CASE WHEN {a} <= {as_of} THEN {v} END AS {v}" for a, vs in GROUPS.items() for v in vs)


@query("c01_availability_mask", MASK_SPEC, f"SELECT valid_time_utc, {mask_sql(AS_OF_SQL)} FROM layered_forecasts")
def availability_mask(spark: SparkSession, path: str) -> DataFrame:
    rows = S.layered_forecasts(S.settle(S.market(spark, path)))
    return pointintime.mask_unavailable(rows, C.decision_time(F.col("delivery_date_local")), GROUPS)


#: What a decision knows of the past: hours, published values, hours whose 24 h layer is complete.
def history_measures() -> dict[str, tuple]:
    return {
        "rows": (F.col("valid_time_utc"), F.lit(1)),
        "f24": (pointintime.known_at("valid_time_utc", "f24_available_at"), F.col("f24_da_price")),
        "f48": (pointintime.known_at("valid_time_utc", "f48_available_at"), F.col("f48_pv_kwh")),
        "lead24": (pointintime.known_at("valid_time_utc", "f24_available_at"), F.when(F.expr(FULL24), 1)),
    }


@query(
    "c02_day_ahead_context", "delivery_day:d part:s rows:i f24:f f48:f lead24:i",
    f"""WITH dec AS (SELECT DISTINCT delivery_date_local AS dd, {AS_OF_SQL} AS as_of FROM market),
      pairs AS (SELECT dd, as_of, 'delivery' AS part, l.* FROM dec JOIN layered_forecasts l ON l.delivery_date_local = dd
        UNION ALL SELECT dd, as_of, 'history', l.* FROM dec JOIN layered_forecasts l ON l.valid_time_utc <= as_of),
      m AS (SELECT dd, part, {mask_sql('as_of')} FROM pairs)
      SELECT dd AS delivery_day, part, count(*) AS rows, avg(f24_da_price) AS f24, avg(f48_pv_kwh) AS f48, count(*) FILTER (WHERE {FULL24}) AS lead24 FROM m GROUP BY ALL""",
)
def day_ahead_context(spark: SparkSession, path: str) -> DataFrame:
    """Delivery day and whole history of every decision, masked and layered."""
    hourly = S.settle(S.market(spark, path))
    decisions = hourly.select("delivery_date_local").distinct().withColumn("as_of_utc", C.decision_time(F.col("delivery_date_local")))
    rows = S.layered_forecasts(hourly)
    context = pointintime.delivery_context(rows, decisions, GROUPS)
    chosen = pointintime.freshest_complete_layer(context, ["da_price", "pv_kwh"], LAYERS, None, "fc_")
    delivery = chosen.groupBy(F.col("delivery_date_local").alias("delivery_day"), F.lit("delivery").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("f24_da_price").alias("f24"), F.avg("f48_pv_kwh").alias("f48"), F.count_if(F.col("fc_lead_hours") == 24).alias("lead24")
    )
    known = pointintime.known_totals(rows, decisions, history_measures(), ["delivery_date_local"]).filter("rows_n > 0")
    history = known.select(
        F.col("delivery_date_local").alias("delivery_day"), F.lit("history").alias("part"), F.col("rows_n").alias("rows"),
        F.expr("try_divide(f24_sum, f24_n)").alias("f24"), F.expr("try_divide(f48_sum, f48_n)").alias("f48"), F.col("lead24_n").alias("lead24"),
    )
    return delivery.unionByName(history)


@query(
    "c02_single_context", "part:s rows:i f24:f f48:f",
    f"""WITH p AS (SELECT 'delivery' AS part, * FROM layered_forecasts WHERE delivery_date_local = DATE '2024-01-20' UNION ALL
        SELECT 'history', * FROM layered_forecasts WHERE valid_time_utc <= TIMESTAMP '2024-01-19 10:00:00'),
      m AS (SELECT part, {mask_sql("TIMESTAMP '2024-01-19 10:00:00'")} FROM p)
      SELECT part, count(*) AS rows, avg(f24_da_price) AS f24, avg(f48_da_price) AS f48 FROM m GROUP BY 1""",
)
def single_context(spark: SparkSession, path: str) -> DataFrame:
    """One decision with its whole history."""
    rows = S.layered_forecasts(S.settle(S.market(spark, path)))
    day = F.lit("2024-01-20").cast("date")
    target, history = pointintime.context_at(
        rows, C.decision_time(day), C.wall_clock(day, 0, 0), C.wall_clock(F.date_add(day, 1), 0, 0), GROUPS
    )
    both = target.withColumn("part", F.lit("delivery")).unionByName(history.withColumn("part", F.lit("history")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.avg("f24_da_price").alias("f24"), F.avg("f48_da_price").alias("f48"))


@query(
    "c03_horizon_context", "as_of_utc:t part:s rows:i f24:f f48:f",
    f"""WITH p AS (SELECT d.valid_time_utc AS as_of_utc, CASE WHEN l.valid_time_utc <= d.valid_time_utc THEN 'observed' ELSE 'future' END AS part, l.* EXCLUDE (delivery_date_local)
        FROM market d JOIN layered_forecasts l ON l.valid_time_utc <= d.valid_time_utc + INTERVAL 36 HOUR),
      m AS (SELECT as_of_utc, part, {mask_sql('as_of_utc')} FROM p)
      SELECT as_of_utc, part, count(*) AS rows, avg(f24_da_price) AS f24, avg(f48_pv_kwh) AS f48 FROM m GROUP BY ALL""",
)
def horizon_context(spark: SparkSession, path: str) -> DataFrame:
    """All observed and 36 future hours of every decision hour."""
    hourly = S.settle(S.market(spark, path))
    decisions = hourly.select(F.col("valid_time_utc").alias("as_of_utc"))
    rows = S.layered_forecasts(hourly)
    future = pointintime.horizon_context(rows, decisions, GROUPS, 36).groupBy("as_of_utc", F.lit("future").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("f24_da_price").alias("f24"), F.avg("f48_pv_kwh").alias("f48")
    )
    observed = pointintime.known_totals(rows, decisions, history_measures(), []).filter("rows_n > 0")
    return future.unionByName(
        observed.select(
            "as_of_utc", F.lit("observed").alias("part"), F.col("rows_n").alias("rows"),
            F.expr("try_divide(f24_sum, f24_n)").alias("f24"), F.expr("try_divide(f48_sum, f48_n)").alias("f48"),
        )
    )


@query(
    "c04_year_filter", "year:i orders:i", f"SELECT year({berlin('valid_time_utc')}) AS year, count(*) AS orders FROM order_clock WHERE year({berlin('valid_time_utc')}) = 1997 GROUP BY 1"
)
def year_filter(spark: SparkSession, path: str) -> DataFrame:
    """Local-year filter; the raw day bounds let the scan skip other years."""
    rows = S.order_clock(spark, path).filter((F.col("o_orderdate") >= "1996-12-30") & (F.col("o_orderdate") < "1998-01-02"))
    rows = rows.withColumn("year", F.year(C.local_time(F.col("valid_time_utc")))).filter(F.col("year") == 1997)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "c05_coarse_steps", "site_id:s ts:t value:f",
    """WITH f AS (SELECT event_type AS site_id, ts, avg(value) AS value FROM events GROUP BY ALL), g AS (SELECT *, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS p FROM f)
      SELECT site_id, ts, value FROM g WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 3600000000""",
)
def coarse_steps(spark: SparkSession, path: str) -> DataFrame:
    """Stamps at least an hour after the previous stamp of their site."""
    stamps = S.readings(spark, path).groupBy("site_id", "ts").agg(F.avg("value").alias("value"))
    return shaping.coarse_steps(stamps, ["site_id"], "ts")


@query(
    "c06_outage_override", "quality_status:s rows:i value:f",
    "SELECT CASE WHEN CAST(ts AS DATE) IN (DATE '2024-01-10', DATE '2024-01-17') THEN 'suspected_source_outage' WHEN value > 100 THEN 'excluded' ELSE 'usable' END AS quality_status,"
    " count(*) AS rows, avg(value) AS value FROM events GROUP BY 1 HAVING quality_status <> 'excluded'",
)
def outage_override(spark: SparkSession, path: str) -> DataFrame:
    rows = S.readings(spark, path).select(F.to_date("ts").alias("day"), "value", F.when(F.col("value") > 100, "excluded").otherwise("usable").alias("quality_status"))
    rows = shaping.override_status(rows, "day", ("2024-01-10", "2024-01-17"), "quality_status", "suspected_source_outage")
    kept = rows.filter(F.col("quality_status") != "excluded")
    return kept.groupBy("quality_status").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("value"))


@query("c07_complete_cases", "valid_time_utc:t f24_da_price:f f24_pv_kwh:f",
       f"SELECT valid_time_utc, f24_da_price, f24_pv_kwh FROM layered_forecasts WHERE {FULL24} AND {FULL48}")
def complete_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = S.layered_forecasts(S.settle(S.market(spark, path)))
    return rows.dropna(subset=["f24_da_price", "f24_pv_kwh", "f48_da_price", "f48_pv_kwh"])


@query("c08_leakage_filter", "valid_time_utc:t as_of_utc:t da_price:f",
       f"SELECT valid_time_utc, {AS_OF_SQL} AS as_of_utc, da_price FROM layered_forecasts WHERE f24_available_at <= {AS_OF_SQL} AND f48_available_at <= {AS_OF_SQL} AND valid_time_utc + INTERVAL 1 HOUR > {AS_OF_SQL}")
def leakage_filter(spark: SparkSession, path: str) -> DataFrame:
    rows = S.layered_forecasts(S.settle(S.market(spark, path))).withColumns(
        {"as_of_utc": C.decision_time(F.col("delivery_date_local")), "target_at": F.col("valid_time_utc") + C.hours(1)}
    )
    return pointintime.causality_filter(rows, ["f24_available_at", "f48_available_at"], target_time="target_at")


@query(
    "c09_series_contract", "rule:s violations:i",
    """WITH s AS (SELECT site_id, valid_time_utc, CASE WHEN n > 1 THEN value END AS value FROM site_hours)
      SELECT 'null_valid_time_utc' AS rule, count(*) FILTER (WHERE valid_time_utc IS NULL) AS violations FROM s UNION ALL SELECT 'null_value', count(*) FILTER (WHERE value IS NULL) FROM s
      UNION ALL SELECT 'duplicate_site_id_valid_time_utc', count(*) FROM (SELECT 1 FROM s GROUP BY site_id, valid_time_utc HAVING count(*) > 1)
      UNION ALL SELECT 'gap_valid_time_utc', count(*) FROM (SELECT valid_time_utc, lead(valid_time_utc) OVER (PARTITION BY site_id ORDER BY valid_time_utc) AS nx FROM s) WHERE nx <> valid_time_utc + INTERVAL 1 HOUR""",
)
def series_contract(spark: SparkSession, path: str) -> DataFrame:
    """Nulls, duplicates and hourly gaps of the per-site series."""
    rows = S.settle(S.site_hours(spark, path).withColumn("value", F.when(F.col("n") > 1, F.col("value"))))
    return contracts.series_contract(rows, ["site_id"], "valid_time_utc", ["value"])


@query(
    "c10_causality_contract", "rule:s violations:i",
    f"""WITH r AS (SELECT d.valid_time_utc AS as_of, t.valid_time_utc AS v, t.valid_time_utc + INTERVAL 1 HOUR AS target_at, t.f24_available_at AS a, t.hour_local - d.hour_local AS lead
        FROM market d JOIN layered_forecasts t ON t.delivery_date_local = d.delivery_date_local AND t.hour_local >= d.hour_local)
      SELECT 'late_f24_available_at' AS rule, count(*) FILTER (WHERE a > as_of) AS violations FROM r UNION ALL SELECT 'target_already_known', count(*) FILTER (WHERE target_at <= as_of) FROM r
      UNION ALL SELECT 'target_not_future', count(*) FILTER (WHERE v <= as_of) FROM r UNION ALL SELECT 'lead_out_of_range', count(*) FILTER (WHERE lead NOT BETWEEN 1 AND 23) FROM r""",
)
def causality_contract(spark: SparkSession, path: str) -> DataFrame:
    """Rule counts on pairs that wrongly include the decision hour itself."""
    hourly = S.settle(S.market(spark, path))
    decisions = hourly.select("delivery_date_local", F.col("valid_time_utc").alias("as_of_utc"), F.col("hour_local").alias("decision_hour"))
    pairs = decisions.join(S.layered_forecasts(hourly), "delivery_date_local").filter(F.col("hour_local") >= F.col("decision_hour"))
    pairs = pairs.withColumns({"lead": F.col("hour_local") - F.col("decision_hour"), "target_at": F.col("valid_time_utc") + C.hours(1)})
    return contracts.causality_contract(pairs, ["f24_available_at"], "target_at", "valid_time_utc", lead="lead")


@query("c11_regular_days", "delivery_date_local:d", "SELECT delivery_date_local FROM market GROUP BY 1 HAVING count(*) = 24 AND count(DISTINCT hour_local) = 24")
def regular_days(spark: SparkSession, path: str) -> DataFrame:
    return features.regular_days(S.market(spark, path), [], "delivery_date_local", "hour_local")


@query(
    "c12_contiguous_windows", "site_id:s as_of_utc:t",
    """SELECT site_id, valid_time_utc AS as_of_utc FROM (SELECT site_id, valid_time_utc, lag(valid_time_utc, 6) OVER (PARTITION BY site_id ORDER BY valid_time_utc) AS p FROM site_hours)
       WHERE p = valid_time_utc - INTERVAL 6 HOUR""",
)
def contiguous_windows(spark: SparkSession, path: str) -> DataFrame:
    """Decisions preceded by six present hours."""
    rows = S.settle(S.site_hours(spark, path).withColumns({"delivery_date_local": C.local_date(F.col("valid_time_utc")), "hour_local": C.local_hour(F.col("valid_time_utc"))}))
    decisions = rows.select("site_id", F.col("valid_time_utc").alias("as_of_utc"))
    return features.recent_window(decisions, rows, ["site_id"], "valid_time_utc", ["value"])


_ACTIVE_SQL = f"SELECT o_orderkey % 50 AS plant, t AS valid_time_utc, CAST({berlin('t')} AS DATE) AS d, hour({berlin('t')}) AS h FROM order_clock JOIN ({SOLAR_SQL}) ON t = valid_time_utc WHERE ghi >= 20"


@query(
    "c13_solar_active_days", "plant:i d:d h:i",
    f"WITH a AS (SELECT DISTINCT plant, d, h FROM ({_ACTIVE_SQL})) SELECT plant, d, h FROM a WHERE (plant, d) IN (SELECT (plant, d) FROM a GROUP BY plant, d HAVING max(h) - min(h) + 1 = count(*))",
)
def solar_active_days(spark: SparkSession, path: str) -> DataFrame:
    """Active hours of days whose active hours form one run."""
    rows = S.order_clock(spark, path).select((F.col("o_orderkey") % 50).alias("plant"), "valid_time_utc").distinct()
    # settled: a filter pushed below would repeat every solar term
    sunny = S.settle(solar_rows(rows)).filter(F.col("clear_sky_ghi") >= 20.0)
    hours = sunny.select("plant", C.local_date(F.col("valid_time_utc")).alias("d"), C.local_hour(F.col("valid_time_utc")).alias("h")).distinct()
    return shaping.contiguous_days(hours, ["plant"], "d", "h")


@query(
    "c14_bands_and_windows", "band:s rows:i value:f",
    "SELECT 'working_hours' AS band, count(*) AS rows, avg(da_price) AS value FROM market WHERE hour_local BETWEEN 6 AND 21 UNION ALL SELECT 'early_window', count(*), avg(da_price) FROM market WHERE delivery_date_local <= DATE '2024-01-15'"
    " UNION ALL SELECT 'late_window', count(*), avg(da_price) FROM market WHERE delivery_date_local > DATE '2024-01-15'",
)
def bands_and_windows(spark: SparkSession, path: str) -> DataFrame:
    """Hour band and two non-overlapping windows in one pass."""
    early = F.col("delivery_date_local") <= F.lit("2024-01-15").cast("date")
    bands = F.filter(
        F.array(F.when(F.col("hour_local").between(6, 21), "working_hours"), F.when(early, "early_window").otherwise("late_window")), lambda b: b.isNotNull()
    )
    return S.market(spark, path).withColumn("band", F.explode(bands)).groupBy("band").agg(F.count(F.lit(1)).alias("rows"), F.avg("da_price").alias("value"))


@query(
    "c15_common_complete_days", "day:d",
    """WITH s AS (SELECT site_id, CAST(valid_time_utc AS DATE) AS day, hour(valid_time_utc) AS h FROM site_hours WHERE hour(valid_time_utc) BETWEEN 6 AND 21)
      SELECT day FROM s WHERE site_id = 'view' GROUP BY 1 HAVING count(DISTINCT h) = 16 INTERSECT SELECT day FROM s WHERE site_id = 'click' GROUP BY 1 HAVING count(DISTINCT h) = 16""",
)
def common_complete_days(spark: SparkSession, path: str) -> DataFrame:
    rows = S.settle(S.site_hours(spark, path).select("site_id", F.to_date("valid_time_utc").alias("day"), F.hour("valid_time_utc").alias("h")))
    working = rows.filter(F.col("h").between(6, 21))
    return shaping.common_complete_days(working.filter("site_id = 'view'"), working.filter("site_id = 'click'"), "day", "h", S.WORKING)


@query(
    "c16_coverage_reasons", "day:d status:s",
    """WITH sp AS (SELECT CAST(unnest(generate_series(min(valid_time_utc)::DATE - 2, max(valid_time_utc)::DATE + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM pooled_hours),
        full_days AS (SELECT CAST(valid_time_utc AS DATE) AS day FROM pooled_hours GROUP BY 1 HAVING count(*) = 24),
        v AS (SELECT CAST(valid_time_utc AS DATE) AS day FROM site_hours WHERE site_id = 'view' GROUP BY 1 HAVING count(*) = 24), p AS (SELECT CAST(valid_time_utc AS DATE) AS day FROM site_hours WHERE site_id = 'purchase' GROUP BY 1 HAVING count(*) >= 23)
      SELECT day, CASE WHEN day NOT IN (SELECT day FROM full_days) THEN 'non_regular_day' WHEN day NOT IN (SELECT day FROM v) THEN 'missing_pv' WHEN day NOT IN (SELECT day FROM p) THEN 'missing_price' ELSE 'used' END AS status FROM sp""",
)
def coverage_reasons(spark: SparkSession, path: str) -> DataFrame:
    """First missing reason of every calendar day, from two days before the first reading to three after the last."""
    rows = S.settle(S.site_hours(spark, path).select("site_id", "valid_time_utc", F.to_date("valid_time_utc").alias("day")))
    hours = rows.groupBy("day").agg(
        F.count_distinct("valid_time_utc").alias("pooled"), F.count_if(F.col("site_id") == "view").alias("view"), F.count_if(F.col("site_id") == "purchase").alias("purchase")
    )
    spine = rows.agg(F.date_sub(F.min("day"), 2).alias("a"), F.date_add(F.max("day"), 3).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return shaping.coverage_reasons(
        spine, "day",
        [("non_regular_day", hours.filter("pooled = 24")), ("missing_pv", hours.filter("view = 24")), ("missing_price", hours.filter("purchase >= 23"))],
    )


@query("c17_library_completeness", "source_day:d hours:i", "SELECT source_day, count(*) AS hours FROM residuals GROUP BY 1")
def library_completeness(spark: SparkSession, path: str) -> DataFrame:
    """Residual days holding every working hour without nulls."""
    pts = S.points(S.settle(S.market(spark, path)))
    lib = pts.select(
        F.col("delivery_date_local").alias("source_day"), "hour_local", (F.col("pv_kwh") - F.col("pv_kwh_point")).alias("pv_residual"),
        (F.col("da_price") - F.col("da_price_point")).alias("price_residual"), (F.col("spread") - F.col("spread_point")).alias("spread_residual"),
    )
    whole = shaping.complete_day_rows(lib, [], "source_day", "hour_local", S.WORKING, ["pv_residual", "price_residual", "spread_residual"])
    return whole.groupBy("source_day").agg(F.count(F.lit(1)).alias("hours"))


@query(
    "c18_frozen_points", "compared:i different:i",
    "WITH b AS (SELECT delivery_date_local, hour_local, CASE WHEN hour_local = 5 THEN da_price + 1 ELSE da_price END AS v FROM market WHERE hour_local <> 7)"
    " SELECT count(*) AS compared, count(*) FILTER (WHERE da_price IS DISTINCT FROM v) AS different FROM market FULL JOIN b USING (delivery_date_local, hour_local)",
)
def frozen_points(spark: SparkSession, path: str) -> DataFrame:
    """A stored artifact with changed and missing points is detected."""
    left = S.settle(S.market(spark, path)).select("delivery_date_local", "hour_local", "da_price")
    right = left.filter("hour_local <> 7").withColumn("da_price", F.when(F.col("hour_local") == 5, F.col("da_price") + 1).otherwise(F.col("da_price")))
    return contracts.unequal_points(left, right, ["delivery_date_local", "hour_local"], "da_price")


@query(
    "c19_site_contract", "rule:s violations:i",
    """WITH e AS (SELECT * FROM site_hours)
      SELECT 'null_value' AS rule, count(*) FILTER (WHERE value IS NULL) AS violations FROM e UNION ALL SELECT 'unknown_site', count(*) FILTER (WHERE site_id NOT IN ('click', 'purchase', 'view')) FROM e UNION ALL SELECT 'thin_hour', count(*) FILTER (WHERE n < 2) FROM e
      UNION ALL SELECT 'duplicate_site_id_valid_time_utc', count(*) FROM (SELECT 1 FROM e GROUP BY site_id, valid_time_utc HAVING count(*) > 1)""",
)
def site_contract(spark: SparkSession, path: str) -> DataFrame:
    """Rows of sites that are not eligible, null targets, thin hours, repeated rows: counted over all sites."""
    eligible = ["click", "purchase", "view"]
    hourly = S.settle(S.site_hours(spark, path))
    rules = {"null_value": F.col("value").isNull(), "unknown_site": ~F.col("site_id").isin(eligible), "thin_hour": F.col("n") < 2}
    return contracts.rule_counts(hourly, rules).unionByName(contracts.duplicate_count(hourly, ["site_id", "valid_time_utc"]))

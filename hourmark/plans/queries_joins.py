"""Queries for joins (D-*) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import contracts, features, metrics, pointintime, shaping
from hourmark.plans import series as S
from hourmark.plans.catalog import query
from hourmark.plans.series import berlin


@query(
    "flagship_persistence_scores", "hour_local:i rows:i mae:f rmse:f bias:f",
    f"""SELECT hour({berlin('a.valid_time_utc')}) AS hour_local, count(*) AS rows, avg(abs(p.value - a.value)) AS mae, sqrt(avg((p.value - a.value) ^ 2)) AS rmse, avg(p.value - a.value) AS bias
      FROM pooled_hours a JOIN pooled_hours p ON p.valid_time_utc = a.valid_time_utc - INTERVAL 24 HOUR GROUP BY 1""",
)
def flagship(spark: SparkSession, path: str) -> DataFrame:
    """Hourly series, yesterday-same-hour forecast known at decision time, scores by local hour."""
    hourly = S.settle(S.pooled_hours(spark, path))
    lagged = features.hour_lags(hourly, [], "valid_time_utc", ["value"], [24], names="forecast").dropna(subset=["forecast"])
    rows = lagged.withColumns(
        {
            "as_of_utc": F.col("valid_time_utc") - C.hours(12), "forecast_at": F.col("valid_time_utc") - C.hours(23),
            "target_at": F.col("valid_time_utc") + C.hours(1), "hour_local": C.local_hour(F.col("valid_time_utc")),
        }
    )
    usable = pointintime.causality_filter(rows, ["forecast_at"], target_time="target_at")
    return metrics.point_metrics(usable, ["hour_local"], "value", "forecast")


@query(
    "d01_canonical_outer", "valid_time_utc:t click:f error:f purchase:f view:f",
    "SELECT coalesce(coalesce(coalesce(a.valid_time_utc, b.valid_time_utc), c.valid_time_utc), d.valid_time_utc) AS valid_time_utc, a.value AS click, b.value AS error, c.value AS purchase, d.value AS view"
    " FROM (SELECT * FROM site_hours WHERE site_id = 'click') a FULL JOIN (SELECT * FROM site_hours WHERE site_id = 'error') b USING (valid_time_utc)"
    " FULL JOIN (SELECT * FROM site_hours WHERE site_id = 'purchase') c USING (valid_time_utc) FULL JOIN (SELECT * FROM site_hours WHERE site_id = 'view') d USING (valid_time_utc)",
)
def canonical_outer(spark: SparkSession, path: str) -> DataFrame:
    """Four hourly sources joined on the hour, keeping hours any of them has."""
    hourly = S.settle(S.site_hours(spark, path))
    sources = [
        hourly.filter(F.col("site_id") == s).select("valid_time_utc", F.col("value").alias(s)) for s in ("click", "error", "purchase", "view")
    ]
    return shaping.outer_on_time(sources, ["valid_time_utc"])


@query(
    "d02_declared_cardinality", "o_orderkey:i customer:s lines:i",
    "SELECT o_orderkey, c_name AS customer, coalesce(n, 0) AS lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def declared_cardinality(spark: SparkSession, path: str) -> DataFrame:
    """Many-to-one and one-to-one left joins; the one side is unique by key."""
    customers = S.table(spark, path, "customer", "c_custkey", "c_name").withColumnsRenamed({"c_custkey": "o_custkey", "c_name": "customer"})
    lines = S.table(spark, path, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    rows = S.table(spark, path, "orders", "o_orderkey", "o_custkey").join(customers, "o_custkey", "left").join(lines, "o_orderkey", "left")
    return rows.withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("d02_cardinality_contract", "rule:s violations:i",
       "SELECT 'duplicate_c_custkey' AS rule, count(*) AS violations FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1) UNION ALL SELECT 'duplicate_l_orderkey', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def cardinality_contract(spark: SparkSession, path: str) -> DataFrame:
    """Uniqueness of the sides a join declares as one."""
    return contracts.duplicate_count(S.table(spark, path, "customer", "c_custkey"), ["c_custkey"]).unionByName(
        contracts.duplicate_count(S.table(spark, path, "lineitem", "l_orderkey"), ["l_orderkey"])
    )


@query("d03_target_join", "site_id:s valid_time_utc:t target:f da_price:f",
       "SELECT site_id, s.valid_time_utc, value AS target, da_price FROM site_hours s JOIN market m USING (valid_time_utc) WHERE n >= 3")
def target_join(spark: SparkSession, path: str) -> DataFrame:
    targets = S.site_hours(spark, path).filter("n >= 3").select("site_id", "valid_time_utc", F.col("value").alias("target"))
    return targets.join(S.market(spark, path).select("valid_time_utc", "da_price"), "valid_time_utc")


@query(
    "d04_hour_lags", "site_id:s valid_time_utc:t value:f value_lag_24h:f value_lag_168h:f value_lag_336h:f value_lag_504h:f value_lag_672h:f",
    "SELECT s.site_id, s.valid_time_utc, s.value, " + ", ".join(f"l{k}.value AS value_lag_{k}h" for k in (24, 168, 336, 504, 672)) + " FROM site_hours s "
    + " ".join(f"LEFT JOIN site_hours l{k} ON l{k}.site_id = s.site_id AND l{k}.valid_time_utc = s.valid_time_utc - INTERVAL {k} HOUR" for k in (24, 168, 336, 504, 672)),
)
def hour_lags(spark: SparkSession, path: str) -> DataFrame:
    return features.hour_lags(S.settle(S.site_hours(spark, path)), ["site_id"], "valid_time_utc", ["value"], [24, 168, 336, 504, 672])


def _window_sql(back: int = 0) -> str:
    """SQL: six previous hours of every market hour, optionally at an earlier local day."""
    base = (
        "SELECT d.valid_time_utc AS as_of_utc, r.valid_time_utc AS t, r.delivery_date_local AS dd, r.hour_local AS hh FROM market d JOIN market r"
        " ON r.valid_time_utc >= d.valid_time_utc - INTERVAL 6 HOUR AND r.valid_time_utc < d.valid_time_utc"
    )
    return (
        f"SELECT as_of_utc, list(h.id_price ORDER BY t) AS w, list(h.spread ORDER BY t) AS ws FROM ({base}) b JOIN market h ON h.delivery_date_local = b.dd - {back} AND h.hour_local = b.hh"
        " GROUP BY 1 HAVING count(*) = 6"
    )


def _decisions(hourly: DataFrame) -> DataFrame:
    return hourly.select(F.col("valid_time_utc").alias("as_of_utc"), "delivery_date_local", F.col("hour_local").alias("decision_hour_local"))


@query("d05_last_six_hours", "as_of_utc:t " + " ".join(f"lag_{i}:f" for i in range(1, 7)),
       "SELECT as_of_utc, " + ", ".join(f"w[{7 - i}] AS lag_{i}" for i in range(1, 7)) + f" FROM ({_window_sql()})")
def last_six_hours(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    rows = features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["id_price"])
    return rows.select("as_of_utc", *[F.element_at("id_price_window", -i).alias(f"lag_{i}") for i in range(1, 7)])


@query(
    "d06_asof_run", "as_of_utc:t run_init_utc:t valid_time_utc:t location_id:s forecast:f snapshot_lead_hours:i snapshot_age_hours:i",
    """WITH runs AS (SELECT DISTINCT run_init_utc, available_at_utc FROM forecast_archive),
      chosen AS (SELECT d.valid_time_utc AS as_of_utc, d.delivery_date_local, r.run_init_utc, r.available_at_utc FROM market d ASOF JOIN runs r ON d.valid_time_utc >= r.available_at_utc)
      SELECT c.as_of_utc, c.run_init_utc, t.valid_time_utc, a.location_id, a.forecast, date_diff('hour', c.run_init_utc, t.valid_time_utc) AS snapshot_lead_hours,
        date_diff('hour', c.available_at_utc, c.as_of_utc) AS snapshot_age_hours
      FROM chosen c JOIN market t ON t.delivery_date_local = c.delivery_date_local AND t.valid_time_utc > c.as_of_utc
      JOIN forecast_archive a ON a.run_init_utc = c.run_init_utc AND a.valid_time_utc = t.valid_time_utc""",
)
def asof_run(spark: SparkSession, path: str) -> DataFrame:
    """Newest published run of every decision hour, then its rows at the remaining hours of the day."""
    hourly = S.settle(S.market(spark, path))
    archive = S.settle(S.forecast_archive(spark, path))
    targets = hourly.select("delivery_date_local", "valid_time_utc")
    return pointintime.snapshot_join(_decisions(hourly), targets, archive)


_LOCATIONS_SQL = """SELECT q.as_of_utc, q.valid_time_utc, a.location_id, a.run_init_utc, a.forecast,
    row_number() OVER (PARTITION BY q.as_of_utc, q.valid_time_utc, a.location_id ORDER BY a.available_at_utc DESC, a.run_init_utc DESC) AS rn
  FROM (SELECT valid_time_utc, valid_time_utc - INTERVAL 9 HOUR AS as_of_utc FROM market) q JOIN forecast_archive a ON a.valid_time_utc = q.valid_time_utc AND a.available_at_utc <= q.as_of_utc"""
_FULL_LOCATIONS_SQL = f"SELECT *, count(*) OVER (PARTITION BY as_of_utc, valid_time_utc) AS n FROM ({_LOCATIONS_SQL}) WHERE rn = 1"


def requests_at(hourly: DataFrame, lead: int) -> DataFrame:
    return hourly.select("valid_time_utc", (F.col("valid_time_utc") - C.hours(lead)).alias("as_of_utc"))


@query("d07_asof_per_location", "as_of_utc:t valid_time_utc:t location_id:s run_init_utc:t forecast:f",
       f"SELECT as_of_utc, valid_time_utc, location_id, run_init_utc, forecast FROM ({_FULL_LOCATIONS_SQL}) WHERE n = 5")
def asof_per_location(spark: SparkSession, path: str) -> DataFrame:
    """Latest record per request and location, only where all locations answer."""
    hourly = S.settle(S.market(spark, path).select("valid_time_utc"))
    return pointintime.asof_per_location(requests_at(hourly, 9), S.forecast_archive(spark, path), [], len(S.SITES))


@query("d07_incomplete_requests", "as_of_utc:t valid_time_utc:t found:i",
       """SELECT q.as_of_utc, q.valid_time_utc, count(DISTINCT a.location_id) AS found FROM (SELECT valid_time_utc, valid_time_utc - INTERVAL 9 HOUR AS as_of_utc FROM market) q
      LEFT JOIN forecast_archive a ON a.valid_time_utc = q.valid_time_utc AND a.available_at_utc <= q.as_of_utc GROUP BY 1, 2 HAVING count(DISTINCT a.location_id) < 5""")
def incomplete_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests that lack a location, so that none is lost unseen."""
    hourly = S.settle(S.market(spark, path).select("valid_time_utc"))
    return pointintime.incomplete_requests(requests_at(hourly, 9), S.forecast_archive(spark, path), [], len(S.SITES))


@query("d08_decision_targets", "delivery_date_local:d decision_hour_local:i target_hour_local:i lead_hours:i da_price:f",
       "SELECT d.delivery_date_local, d.hour_local AS decision_hour_local, t.hour_local AS target_hour_local, t.hour_local - d.hour_local AS lead_hours, t.da_price FROM market d JOIN market t ON t.delivery_date_local = d.delivery_date_local AND t.hour_local > d.hour_local")
def decision_targets(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    targets = hourly.select("delivery_date_local", F.col("hour_local").alias("target_hour_local"), "da_price")
    return features.decision_targets(_decisions(hourly), targets, [], "delivery_date_local", "decision_hour_local", "target_hour_local")


@query(
    "d09_same_clock_history", "delivery_date_local:d hour_local:i id_price_d1:f id_price_d7:f id_price_d14:f",
    "SELECT m.delivery_date_local, m.hour_local, a.id_price AS id_price_d1, b.id_price AS id_price_d7, c.id_price AS id_price_d14 FROM market m "
    + " ".join(f"JOIN market {n} ON {n}.delivery_date_local = m.delivery_date_local - {k} AND {n}.hour_local = m.hour_local" for n, k in (("a", 1), ("b", 7), ("c", 14))),
)
def same_clock_history(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.market(spark, path))
    return features.same_clock_history(hourly.select("delivery_date_local", "hour_local"), hourly, [], "delivery_date_local", "hour_local", ["id_price"], (1, 7, 14))


@query("d10_history_windows", "as_of_utc:t mean_d7:f mean_d14:f",
       f"SELECT a.as_of_utc, list_avg(a.w) AS mean_d7, list_avg(b.w) AS mean_d14 FROM ({_window_sql(7)}) a JOIN ({_window_sql(14)}) b USING (as_of_utc)")
def history_windows(spark: SparkSession, path: str) -> DataFrame:
    """Six-hour windows at the same clock hours one and two weeks back."""
    hourly = S.settle(S.market(spark, path))
    means = [
        features.recent_window(_decisions(hourly), hourly, [], "valid_time_utc", ["id_price"], local_days_back=k).select(
            "as_of_utc", features.array_stats(F.col("id_price_window"), "w")["w_mean"].alias(f"mean_d{k}")
        )
        for k in (7, 14)
    ]
    return means[0].join(means[1], "as_of_utc")


@query(
    "d11_previous_curve", "delivery_date_local:d hour_local:i " + " ".join(f"prev_h{h:02d}:f" for h in range(24)) + " da_price_d1:f da_price_d2:f da_price_d7:f da_price_d14:f",
    "WITH reg AS (SELECT * FROM market WHERE delivery_date_local IN (SELECT delivery_date_local FROM market GROUP BY 1 HAVING count(*) = 24 AND count(DISTINCT hour_local) = 24)),"
    " cur AS (SELECT delivery_date_local + 1 AS delivery_date_local, " + ", ".join(f"max(da_price) FILTER (WHERE hour_local = {h}) AS prev_h{h:02d}" for h in range(24)) + " FROM reg GROUP BY 1)"
    " SELECT cur.*, m.hour_local, " + ", ".join(f"l{k}.da_price AS da_price_d{k}" for k in (1, 2, 7, 14)) + " FROM reg m JOIN cur USING (delivery_date_local) "
    + " ".join(f"JOIN reg l{k} ON l{k}.delivery_date_local = m.delivery_date_local - {k} AND l{k}.hour_local = m.hour_local" for k in (1, 2, 7, 14)),
)
def previous_curve(spark: SparkSession, path: str) -> DataFrame:
    """Yesterday's 24 prices as columns plus same-hour lags, regular days only."""
    hourly = S.settle(S.market(spark, path))
    regular = features.only_regular_days(hourly, [], "delivery_date_local", "hour_local")
    curve = features.previous_curve(regular, [], "delivery_date_local", "hour_local", "da_price", "prev")
    lagged = features.same_clock_history(regular.select("delivery_date_local", "hour_local"), regular, [], "delivery_date_local", "hour_local", ["da_price"], (1, 2, 7, 14))
    return lagged.join(curve, "delivery_date_local")


@query("d12_location_columns", "valid_time_utc:t " + " ".join(f"spatial_{s}_value:f" for s in S.SITES),
       "SELECT valid_time_utc, " + ", ".join(f"max(value) FILTER (WHERE site_id = '{s}') AS spatial_{s}_value" for s in S.SITES) + " FROM site_hours GROUP BY 1")
def location_columns(spark: SparkSession, path: str) -> DataFrame:
    """Ten successive joins become one conditional aggregation."""
    return features.location_columns(S.site_hours(spark, path), ["valid_time_utc"], "site_id", S.SITES, ["value"])


@query(
    "d13_snapshot_attach", "delivery_date_local:d decision_hour_local:i valid_time_utc:t pv_kwh:f forecast:f",
    """WITH runs AS (SELECT DISTINCT run_init_utc, available_at_utc FROM forecast_archive),
      chosen AS (SELECT d.valid_time_utc AS as_of_utc, d.delivery_date_local, d.hour_local, r.run_init_utc FROM market d ASOF JOIN runs r ON d.valid_time_utc >= r.available_at_utc),
      snap AS (SELECT run_init_utc, valid_time_utc, avg(forecast) AS forecast FROM forecast_archive GROUP BY 1, 2)
      SELECT c.delivery_date_local, c.hour_local AS decision_hour_local, t.valid_time_utc, t.pv_kwh, s.forecast FROM chosen c JOIN market t ON t.delivery_date_local = c.delivery_date_local AND t.hour_local > c.hour_local AND t.valid_time_utc > c.as_of_utc
      JOIN snap s ON s.run_init_utc = c.run_init_utc AND s.valid_time_utc = t.valid_time_utc""",
)
def snapshot_attach(spark: SparkSession, path: str) -> DataFrame:
    """Mean of the locations in the run known to the decision, attached on (day, decision, valid time)."""
    hourly = S.settle(S.market(spark, path))
    targets = hourly.select("delivery_date_local", F.col("hour_local").alias("target_hour_local"), "valid_time_utc", "pv_kwh")
    pairs = features.decision_targets(_decisions(hourly), targets, [], "delivery_date_local", "decision_hour_local", "target_hour_local")
    archive = S.settle(S.forecast_archive(spark, path))
    located = pointintime.snapshot_join(_decisions(hourly), hourly.select("delivery_date_local", "valid_time_utc"), archive)
    key = ["delivery_date_local", "decision_hour_local", "valid_time_utc"]
    return pairs.join(located.groupBy(*key).agg(F.avg("forecast").alias("forecast")), key)


@query("d14_aligned_keys", "side:s rows:i",
       "WITH a AS (SELECT valid_time_utc FROM site_hours WHERE site_id = 'view'), b AS (SELECT valid_time_utc FROM site_hours WHERE site_id = 'click')"
       " SELECT 'aligned' AS side, count(*) AS rows FROM a WHERE valid_time_utc IN (SELECT * FROM b) UNION ALL SELECT 'missing', count(*) FROM a WHERE valid_time_utc NOT IN (SELECT * FROM b)"
       " UNION ALL SELECT 'extra', count(*) FROM b WHERE valid_time_utc NOT IN (SELECT * FROM a)")
def aligned_keys(spark: SparkSession, path: str) -> DataFrame:
    """One frame restricted to another's keys, with both leftovers counted."""
    hourly = S.settle(S.site_hours(spark, path))
    a, b = (hourly.filter(F.col("site_id") == s).select("valid_time_utc") for s in ("view", "click"))
    aligned = a.join(b, "valid_time_utc", "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("aligned").alias("side"), "rows")
    sides = contracts.unexpected_and_missing(a, b, ["valid_time_utc"]).agg(
        F.count_if(F.col("status") == "missing").alias("m"), F.count_if(F.col("status") == "extra").alias("e")
    )
    return aligned.unionByName(sides.selectExpr("stack(2, 'missing', m, 'extra', e) as (side, rows)"))


@query("d15_paired_variants", "day:d hour:i baseline:f challenger:f improvement:f",
       "SELECT b.day, b.hour, b.value AS baseline, c.value AS challenger, b.value - c.value AS improvement FROM (SELECT CAST(valid_time_utc AS DATE) AS day, hour(valid_time_utc) AS hour, value FROM site_hours WHERE site_id = 'click') b"
       " JOIN (SELECT CAST(valid_time_utc AS DATE) AS day, hour(valid_time_utc) AS hour, value FROM site_hours WHERE site_id = 'view') c USING (day, hour)")
def paired_variants(spark: SparkSession, path: str) -> DataFrame:
    rows = S.site_hours(spark, path).select("site_id", "value", F.to_date("valid_time_utc").alias("day"), F.hour("valid_time_utc").alias("hour"))
    rows = rows.filter(F.col("site_id").isin("click", "view"))
    return metrics.paired_improvement(rows, "site_id", "click", "view", ["day", "hour"], "value").dropna()


@query("d16_variant_wide", "day:d hour:i click:f error:f view:f",
       "SELECT CAST(valid_time_utc AS DATE) AS day, hour(valid_time_utc) AS hour, a.value AS click, b.value AS error, c.value AS view FROM (SELECT * FROM site_hours WHERE site_id = 'click') a"
       " JOIN (SELECT * FROM site_hours WHERE site_id = 'error') b USING (valid_time_utc) JOIN (SELECT * FROM site_hours WHERE site_id = 'view') c USING (valid_time_utc)")
def variant_wide(spark: SparkSession, path: str) -> DataFrame:
    """Variants side by side on their common keys: one pivot instead of chained joins."""
    rows = features.location_columns(S.site_hours(spark, path), ["valid_time_utc"], "site_id", ["click", "error", "view"], ["value"], "v").dropna()
    return rows.select(F.to_date("valid_time_utc").alias("day"), F.hour("valid_time_utc").alias("hour"), *[F.col(f"v_{s}_value").alias(s) for s in ("click", "error", "view")])


@query("d17_spread", "valid_time_utc:t spread:f", "SELECT a.valid_time_utc, a.value - b.value AS spread FROM site_hours a JOIN site_hours b USING (valid_time_utc) WHERE a.site_id = 'view' AND b.site_id = 'purchase'")
def spread(spark: SparkSession, path: str) -> DataFrame:
    hourly = S.settle(S.site_hours(spark, path))
    intraday = hourly.filter("site_id = 'view'").select("valid_time_utc", F.col("value").alias("a"))
    auction = hourly.filter("site_id = 'purchase'").select("valid_time_utc", F.col("value").alias("b"))
    return intraday.join(auction, "valid_time_utc").withColumn("spread", F.col("a") - F.col("b"))


@query(
    "d18_forecast_matrix", "delivery_date_local:d execution_hour:i hour_local:i value:f",
    """SELECT m.delivery_date_local, e AS execution_hour, m.hour_local, CASE WHEN e >= 1 AND m.hour_local = e AND u.hour_local IS NOT NULL THEN u.id_price ELSE m.da_price END AS value
      FROM market m CROSS JOIN range(24) AS r(e) LEFT JOIN market u ON u.delivery_date_local = m.delivery_date_local AND u.hour_local = e - 1""",
)
def forecast_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Day-ahead curve per execution hour with next-hour updates revealed."""
    hourly = S.settle(S.market(spark, path))
    curve = hourly.select("delivery_date_local", "hour_local", F.col("da_price").alias("value"))
    updates = hourly.select("delivery_date_local", F.col("hour_local").alias("decision_hour_local"), F.lit(1).alias("lead_hours"), F.col("id_price").alias("update"))
    return shaping.forecast_matrix(curve, updates, ["delivery_date_local"])


@query("d20_paired_days", "day:d candidate:s baseline_cost:f candidate_cost:f saving:f",
       "WITH c AS (SELECT site_id, CAST(valid_time_utc AS DATE) AS day, avg(value) AS cost FROM site_hours GROUP BY ALL)"
       " SELECT b.day, c.site_id AS candidate, b.cost AS baseline_cost, c.cost AS candidate_cost, b.cost - c.cost AS saving FROM c JOIN c b ON b.day = c.day AND b.site_id = 'view' WHERE c.site_id <> 'view'")
def paired_days(spark: SparkSession, path: str) -> DataFrame:
    """Each strategy's day beside the baseline's."""
    from hourmark.operators.ledger import paired_days as pair

    daily = S.settle(S.site_hours(spark, path).groupBy("site_id", F.to_date("valid_time_utc").alias("day")).agg(F.avg("value").alias("cost")))
    return pair(daily, "site_id", "view", ["day"], "cost").withColumnRenamed("site_id", "candidate")

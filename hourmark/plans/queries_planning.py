"""Queries for plans, settlement and strategy comparison (K-*, E-32..E-38, J-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.operators import ledger, planning, ranking, uncertainty
from hourmark.params import CHARGES_2025, site
from hourmark.plans import series as S
from hourmark.plans.catalog import query, sql_view
from hourmark.plans.queries_calendar import DAY_RATE, NIGHT_RATE, SEASON_SQL, TYPE_SQL
from hourmark.plans.queries_metrics import draw_sql
from hourmark.plans.queries_uncertainty import scenarios_from

SC, TARIFF = site(), CHARGES_2025
DAY, HOUR = "delivery_date_local", "hour_local"
PLAN_SPEC = f"{DAY}:d {HOUR}:i load_kwh:f discharge_kwh:f position_kwh:f"

sql_view(
    "full_points",
    "SELECT * FROM points WHERE delivery_date_local IN (SELECT delivery_date_local FROM points WHERE da_price IS NOT NULL AND da_price_point IS NOT NULL GROUP BY 1 HAVING count(*) = 24)",
)
sql_view(
    "night_refs",
    """SELECT d, night FROM (SELECT d, avg(p) OVER w AS night, count(*) OVER w AS n FROM (SELECT delivery_date_local + (hour_local >= 22)::INT + 1 AS d, greatest(avg(da_price), 0) AS p
      FROM market WHERE hour_local IN (22, 23, 0, 1, 2, 3, 4, 5, 6) GROUP BY 1) WINDOW w AS (ORDER BY d ROWS 13 PRECEDING)) WHERE n = 14""",
)
sql_view("plan_inputs", "SELECT f.*, n.night, n.night / 1000 / 0.9604 + 0.05 AS cost FROM full_points f JOIN night_refs n ON n.d = f.delivery_date_local")


def merit_sql(price: str, pv: str, source: str = "plan_inputs", group: str = "delivery_date_local") -> str:
    """SQL: two merit-order fills per day."""
    return f"""SELECT *, load_kwh - {pv} - discharge_kwh AS position_kwh FROM (
      SELECT *, lo + greatest(0, least(flex, 200 - tot_lo - coalesce(sum(flex) OVER (PARTITION BY {group} ORDER BY {price}, hour_local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS load_kwh,
        greatest(0, least(offer, 44.16 - coalesce(sum(offer) OVER (PARTITION BY {group} ORDER BY {price} DESC, hour_local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS discharge_kwh
      FROM (SELECT *, CASE WHEN hour_local BETWEEN 6 AND 21 THEN 5.0 ELSE 0 END AS lo, CASE WHEN hour_local BETWEEN 6 AND 21 THEN 15.0 ELSE 0 END AS flex,
          CASE WHEN hour_local BETWEEN 6 AND 21 AND {price} / 1000 > cost THEN 5.0 ELSE 0 END AS offer, sum(CASE WHEN hour_local BETWEEN 6 AND 21 THEN 5.0 ELSE 0 END) OVER (PARTITION BY {group}) AS tot_lo FROM {source}))"""


def world(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The settled market series and its persistence points: one raw scan per query."""
    hourly = S.settle(S.market(spark, path))
    return hourly, S.settle(S.points(hourly))


def whole_days(points: DataFrame) -> DataFrame:
    """Rows of days with all 24 prices and points."""
    whole = points.filter(F.col("da_price").isNotNull() & F.col("da_price_point").isNotNull()).groupBy(DAY).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 24")
    return points.join(whole.select(DAY), DAY, "left_semi")


def plan_inputs(hourly: DataFrame, points: DataFrame) -> DataFrame:
    """Complete days with points, actuals and the battery cost of the last 14 nights, without and with grid charges."""
    night = planning.night_reference(hourly, [], DAY, HOUR, "da_price").select(F.col("reference_day").alias(DAY), F.col("night_reference").alias("night"))
    costs = {
        "battery_cost_eur_per_kwh": planning.battery_cost(F.col("night"), SC)["battery_cost_eur_per_kwh"],
        "grid_battery_cost_eur_per_kwh": planning.battery_cost(F.col("night"), SC, TARIFF)["battery_cost_eur_per_kwh"],
    }
    return S.settle(whole_days(points).join(night, DAY).withColumns(costs))


def day_ahead_plan(rows: DataFrame) -> DataFrame:
    return planning.merit_order_plan(rows, [DAY], HOUR, "da_price_point", "pv_kwh_point", SC)


def oracle_plan(rows: DataFrame) -> DataFrame:
    return planning.merit_order_plan(rows, [DAY], HOUR, "da_price", "pv_kwh", SC)


@query("k01_merit_order_plan", PLAN_SPEC, merit_sql("da_price_point", "pv_kwh_point"))
def merit_order_plan(spark: SparkSession, path: str) -> DataFrame:
    """Day-ahead plan on forecast prices and PV."""
    return day_ahead_plan(plan_inputs(*world(spark, path)))


@query("k02_oracle_plan", PLAN_SPEC, merit_sql("da_price", "pv_kwh"))
def perfect_plan(spark: SparkSession, path: str) -> DataFrame:
    """The same plan with perfect information."""
    return oracle_plan(plan_inputs(*world(spark, path)))


def day_scenarios(points: DataFrame) -> DataFrame:
    return S.settle(scenarios_from(points, False))


sql_view("mean_prices", "SELECT delivery_date_local, hour_local, avg(price) AS mean_price FROM raw_scenarios GROUP BY 1, 2")
sql_view("saa_inputs", "SELECT p.*, coalesce(m.mean_price, p.da_price_point) AS saa_price FROM plan_inputs p LEFT JOIN mean_prices m USING (delivery_date_local, hour_local) WHERE p.delivery_date_local IN (SELECT delivery_date_local FROM mean_prices)")


def saa_plan(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Risk-neutral plan: linear cost, so the scenario mean price is sufficient."""
    means = members.groupBy(DAY, HOUR).agg(F.avg("price").alias("mean_price"))
    covered = rows.join(members.select(DAY).distinct(), DAY, "left_semi").join(means, [DAY, HOUR], "left")
    priced = covered.withColumn("saa_price", F.coalesce("mean_price", "da_price_point"))
    return planning.merit_order_plan(priced, [DAY], HOUR, "saa_price", "pv_kwh_point", SC)


@query("k03_saa_plan", PLAN_SPEC, merit_sql("saa_price", "pv_kwh_point", "saa_inputs"))
def risk_neutral_plan(spark: SparkSession, path: str) -> DataFrame:
    hourly, points = world(spark, path)
    return saa_plan(plan_inputs(hourly, points), day_scenarios(points))


sql_view("saa_plans", merit_sql("saa_price", "pv_kwh_point", "saa_inputs"))
sql_view("saa_costs", "SELECT s.delivery_date_local, s.scenario_id, sum(s.price / 1000 * (p.load_kwh - s.pv - p.discharge_kwh) + p.cost * p.discharge_kwh) AS c FROM raw_scenarios s JOIN saa_plans p USING (delivery_date_local, hour_local) GROUP BY 1, 2")


def _scenario_costs(spark: SparkSession, path: str) -> DataFrame:
    hourly, points = world(spark, path)
    members = day_scenarios(points)
    plan = saa_plan(plan_inputs(hourly, points), members)
    return planning.scenario_costs(plan, members, [DAY], HOUR, "price", "pv")


@query("k03_expected_cost", f"{DAY}:d scenarios:i expected_cost_eur:f", "SELECT delivery_date_local, count(*) AS scenarios, avg(c) AS expected_cost_eur FROM saa_costs GROUP BY 1")
def expected_cost(spark: SparkSession, path: str) -> DataFrame:
    """Expected cost of the risk-neutral plan over its scenarios."""
    return _scenario_costs(spark, path).groupBy(DAY).agg(F.count(F.lit(1)).alias("scenarios"), F.avg("scenario_cost_eur").alias("expected_cost_eur"))


@query("e36_minimum_cvar", f"{DAY}:d cvar:f",
       "SELECT delivery_date_local, min(o) AS cvar FROM (SELECT a.delivery_date_local, a.c, a.c + avg(greatest(b.c - a.c, 0)) / 0.1 AS o FROM (SELECT DISTINCT delivery_date_local, c FROM saa_costs) a JOIN saa_costs b USING (delivery_date_local) GROUP BY 1, 2) GROUP BY 1")
def minimum_cvar(spark: SparkSession, path: str) -> DataFrame:
    """Exact empirical CVaR of each day's scenario costs by running sums."""
    return ranking.minimum_cvar(S.settle(_scenario_costs(spark, path)), [DAY], "scenario_cost_eur", 0.9)


@query(
    "k04_capped_allocation", f"{DAY}:d {HOUR}:i load_kwh:f",
    """WITH w AS (SELECT delivery_date_local, hour_local, 17.0 - row_number() OVER (PARTITION BY delivery_date_local ORDER BY da_price, hour_local) AS w FROM full_points WHERE hour_local BETWEEN 6 AND 21),
      c AS (SELECT delivery_date_local, 5 / w AS a FROM w UNION SELECT delivery_date_local, 20 / w FROM w), f AS (SELECT c.delivery_date_local, a, sum(least(greatest(a * w, 5), 20)) AS f FROM c JOIN w USING (delivery_date_local) GROUP BY 1, 2),
      s AS (SELECT delivery_date_local, max(a) FILTER (WHERE f <= 200) AS a0, max(f) FILTER (WHERE f <= 200) AS f0, min(a) FILTER (WHERE f >= 200) AS a1, min(f) FILTER (WHERE f >= 200) AS f1 FROM f GROUP BY 1)
      SELECT delivery_date_local, hour_local, least(greatest(w * CASE WHEN f1 = f0 THEN a0 ELSE a0 + (a1 - a0) * (200 - f0) / (f1 - f0) END, 5), 20) AS load_kwh FROM w JOIN s USING (delivery_date_local)""",
)
def capped_allocation(spark: SparkSession, path: str) -> DataFrame:
    """Weights by inverse price rank, scaled between bounds to meet 200 kWh."""
    rows = whole_days(world(spark, path)[1]).filter(F.col(HOUR).between(6, 21))
    ranked = planning.price_ranks(rows, [DAY], HOUR, "da_price").withColumn("w", 17.0 - F.col("price_rank"))
    return planning.capped_allocation(ranked, [DAY], "w", 200.0, 5.0, 20.0)


sql_view(
    "shape_rows",
    f"SELECT {SEASON_SQL.format(d='delivery_date_local')} AS season, {TYPE_SQL.format(d='delivery_date_local')} AS day_type, hour_local, da_price FROM market WHERE delivery_date_local < (SELECT min(delivery_date_local) FROM plan_inputs)",
)
sql_view(
    "rule_scored",
    f"""SELECT p.*, coalesce(s.m, g.m) AS score FROM plan_inputs p LEFT JOIN (SELECT season, day_type, hour_local, median(da_price) AS m FROM shape_rows GROUP BY 1, 2, 3) s ON s.season = {SEASON_SQL.format(d='p.delivery_date_local')} AND s.day_type = {TYPE_SQL.format(d='p.delivery_date_local')} AND s.hour_local = p.hour_local
      LEFT JOIN (SELECT day_type, hour_local, median(da_price) AS m FROM shape_rows GROUP BY 1, 2) g ON g.day_type = {TYPE_SQL.format(d='p.delivery_date_local')} AND g.hour_local = p.hour_local WHERE p.hour_local BETWEEN 6 AND 21""",
)
# with ranks 1..16 the common scale a solves sum(clip(a*w, 5, 20)) = 200 for w = 1..16
sql_view(
    "rule_scale",
    """SELECT a0 + (a1 - a0) * (200 - f0) / nullif(f1 - f0, 0) AS a FROM (SELECT max(a) FILTER (WHERE f <= 200) AS a0, max(f) FILTER (WHERE f <= 200) AS f0, min(a) FILTER (WHERE f > 200) AS a1, min(f) FILTER (WHERE f > 200) AS f1 FROM
      (SELECT a, sum(least(greatest(a * w, 5), 20)) AS f FROM (SELECT 5.0 / w AS a FROM range(1, 17) AS r(w) UNION SELECT 20.0 / w FROM range(1, 17) AS r(w)), range(1, 17) AS q(w) GROUP BY 1))""",
)


def rule_sql(threshold: str) -> str:
    return f"""SELECT *, load_kwh AS position_kwh, greatest(0, least(offer, 44.16 - coalesce(sum(offer) OVER (PARTITION BY delivery_date_local ORDER BY score DESC, hour_local ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS discharge_kwh
      FROM (SELECT *, least(greatest((17 - price_rank) * a, 5), 20) AS load_kwh, CASE WHEN score > ({threshold}) * 1000 THEN 5.0 ELSE 0 END AS offer
        FROM (SELECT *, row_number() OVER (PARTITION BY delivery_date_local ORDER BY score, hour_local) AS price_rank FROM rule_scored), rule_scale)"""


sql_view("rule_plans", rule_sql("cost"))
sql_view("grid_rule_plans", rule_sql(f"cost + {NIGHT_RATE!r} / 0.9604 - {DAY_RATE!r}"))


def rule_plan(rows: DataFrame, hourly: DataFrame, with_grid: bool = False) -> DataFrame:
    """Rule policy on a shape fitted to all days before the first planned one.

    Energy prices alone decide unless ``with_grid``: then the battery's cost and
    the import it saves both carry their grid charges.
    """
    first = rows.agg(F.min(DAY)).scalar()
    shape = planning.price_shape(hourly.filter(F.col(DAY) < first), DAY, HOUR, "da_price")
    scored = planning.shape_scores(rows, shape, DAY, HOUR)
    if with_grid:
        return planning.rule_plan(scored, [DAY], HOUR, SC, TARIFF, "grid_battery_cost_eur_per_kwh")
    return planning.rule_plan(scored, [DAY], HOUR, SC)


@query("k05_rule_plan", PLAN_SPEC + " price_score:f price_rank:i", "SELECT *, score AS price_score FROM rule_plans")
def rule_based(spark: SparkSession, path: str) -> DataFrame:
    """Load by inverse rank of the seasonal shape, discharge in its dearest hours."""
    hourly, points = world(spark, path)
    return rule_plan(plan_inputs(hourly, points), hourly)


sql_view(
    "settled_hours",
    """SELECT delivery_date_local, hour_local, load_kwh, discharge_kwh, position_kwh, 0.0 AS charge_kwh, pv_kwh * 2 AS actual_pv_kwh, CASE WHEN da_price < 0 THEN greatest(pv_kwh * 2, 0) ELSE 0 END AS curtailment_kwh,
      da_price, id_price, night FROM grid_rule_plans""",
)


def settled_hours(spark: SparkSession, path: str) -> DataFrame:
    """The rule plan with grid charges beside the hours it is settled on: doubled PV, none stored, curtailed at negative prices."""
    hourly, points = world(spark, path)
    plan = rule_plan(plan_inputs(hourly, points), hourly, with_grid=True)
    sunshine = F.col("pv_kwh") * 2.0
    return plan.withColumns({
        "charge_kwh": F.lit(0.0), "actual_pv_kwh": sunshine,
        "curtailment_kwh": F.when(F.col("da_price") < 0, F.greatest(sunshine, F.lit(0.0))).otherwise(0.0),
    })


@query("k06_stored_energy", f"{DAY}:d {HOUR}:i discharge_kwh:f soc_start_kwh:f soc_end_kwh:f soc_violation:i",
       """SELECT *, (soc_end_kwh < -1e-7 OR soc_end_kwh > 44.16 + 1e-7)::INT AS soc_violation FROM (SELECT *, soc_end_kwh + discharge_kwh / 0.98 AS soc_start_kwh FROM
         (SELECT delivery_date_local, hour_local, discharge_kwh, 44.16 - sum(discharge_kwh / 0.98) OVER (PARTITION BY delivery_date_local ORDER BY hour_local ROWS UNBOUNDED PRECEDING) AS soc_end_kwh FROM settled_hours))""")
def stored_energy(spark: SparkSession, path: str) -> DataFrame:
    """Stored energy along each planned day, and the hours in which the plan asks for more than there is."""
    return planning.stored_energy(settled_hours(spark, path), [DAY], HOUR, SC)


EXCHANGE = "load_kwh + charge_kwh - (actual_pv_kwh - curtailment_kwh) - discharge_kwh"


@query("k07_hourly_decisions", f"strategy:s {DAY}:d {HOUR}:i grid_exchange_kwh:f grid_import_kwh:f grid_export_kwh:f charge_cost:f cheaper:i",
       f"SELECT 'rule_based' AS strategy, delivery_date_local, hour_local, {EXCHANGE} AS grid_exchange_kwh, greatest({EXCHANGE}, 0) AS grid_import_kwh, greatest(-({EXCHANGE}), 0) AS grid_export_kwh, da_price / 1000 + {DAY_RATE!r} AS charge_cost, (da_price / 1000 + {DAY_RATE!r} < greatest(night, 0) / 1000 + {NIGHT_RATE!r})::INT AS cheaper FROM settled_hours")
def hourly_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Hourly decision rows with physical exchange and charging economics."""
    rows = ledger.physical_exchange(settled_hours(spark, path), "load_kwh", "charge_kwh", "actual_pv_kwh", "discharge_kwh", "curtailment_kwh")
    econ = ledger.charge_economics(F.col("da_price"), F.col("night"), TARIFF)
    return rows.withColumns({"strategy": F.lit("rule_based"), "charge_cost": econ["grid_charge_cost_eur_per_kwh"], "cheaper": econ["grid_charge_cheaper"]})


@query("k08_load_bounds", f"{DAY}:d minimum_kwh:f maximum_kwh:f feasible:i",
       "SELECT delivery_date_local, 5.0 * c AS minimum_kwh, 20.0 * c AS maximum_kwh, (200 BETWEEN 5 * c AND 20 * c)::INT AS feasible FROM (SELECT delivery_date_local, count(*) FILTER (WHERE hour_local BETWEEN 6 AND 21) AS c FROM market GROUP BY 1)")
def load_bounds(spark: SparkSession, path: str) -> DataFrame:
    rows = S.market(spark, path).withColumns(planning.load_bounds(F.col(HOUR), SC))
    return planning.load_feasibility(rows, [DAY], SC.daily_load_kwh)


def _ladder_rows(spark: SparkSession, path: str) -> DataFrame:
    """Hourly plans of all rungs beside the actuals they are settled on."""
    hourly, points = world(spark, path)
    rows = plan_inputs(hourly, points)
    plans = {
        "rule_based": rule_plan(rows, hourly), "day_ahead_only": day_ahead_plan(rows),
        "stochastic": saa_plan(rows, day_scenarios(points)), "oracle": oracle_plan(rows),
    }
    keep = [DAY, HOUR, "load_kwh", "discharge_kwh", "position_kwh", "da_price", "id_price", "battery_cost_eur_per_kwh", F.col("pv_kwh").alias("actual_pv_kwh")]
    stacked = None
    for name, plan in plans.items():
        part = plan.select(*keep).withColumn("strategy", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.join(plans["stochastic"].select(DAY).distinct(), DAY, "left_semi")


_PLAN_COLS = "delivery_date_local, hour_local, load_kwh, discharge_kwh, position_kwh, da_price, id_price, cost, pv_kwh"
sql_view(
    "ladder",
    " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, {_PLAN_COLS} FROM {src}"
        for n, src in (
            ("rule_based", "rule_plans"), ("day_ahead_only", f"({merit_sql('da_price_point', 'pv_kwh_point')})"),
            ("stochastic", "saa_plans"), ("oracle", f"({merit_sql('da_price', 'pv_kwh')})"),
        )
    ),
)
sql_view(
    "daily_costs",
    """SELECT delivery_date_local, strategy, sum(da_price / 1000 * position_kwh) AS day_ahead_cost_eur, sum(id_price / 1000 * (load_kwh - pv_kwh - discharge_kwh - position_kwh)) AS intraday_cost_eur, sum(cost * discharge_kwh) AS battery_cost_eur,
      sum(da_price / 1000 * position_kwh + id_price / 1000 * (load_kwh - pv_kwh - discharge_kwh - position_kwh) + cost * discharge_kwh) AS total_cost_eur
      FROM ladder WHERE delivery_date_local IN (SELECT delivery_date_local FROM saa_plans) GROUP BY 1, 2""",
)
LEDGER_SPEC = f"{DAY}:d strategy:s day_ahead_cost_eur:f intraday_cost_eur:f battery_cost_eur:f total_cost_eur:f"


def daily_costs(spark: SparkSession, path: str) -> DataFrame:
    return S.settle(ledger.simple_ledger(_ladder_rows(spark, path), [DAY, "strategy"]))


@query("e32_simple_ledger", LEDGER_SPEC, "SELECT * FROM daily_costs")
def simple_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Day-ahead, deviation and battery cost per day and strategy."""
    return daily_costs(spark, path)


@query(
    "e33_physical_ledger", f"{DAY}:d day_ahead_cost_eur:f intraday_cost_eur:f terminal_soc_kwh:f soc_violation:i curtailment_violation:i terminal_recharge_kwh:f night_energy_cost_eur:f degradation_cost_eur:f network_cost_eur:f total_cost_eur:f",
    f"""WITH d AS (SELECT delivery_date_local, sum(da_price / 1000 * position_kwh) AS da, sum(id_price / 1000 * ({EXCHANGE} - position_kwh)) AS idc, sum(charge_kwh) AS ch, sum(discharge_kwh) AS dis, sum(greatest({EXCHANGE}, 0)) AS imp, max(night) AS night, count(*) FILTER (WHERE curtailment_kwh < -1e-7 OR curtailment_kwh > greatest(actual_pv_kwh, 0) + 1e-7) AS bad FROM settled_hours GROUP BY 1),
      t AS (SELECT *, 44.16 + 0.98 * ch - dis / 0.98 AS raw, least(greatest(44.16 + 0.98 * ch - dis / 0.98, 0), 44.16) AS soc FROM d), u AS (SELECT *, (44.16 - soc) / 0.98 AS refill FROM t)
      SELECT delivery_date_local, da AS day_ahead_cost_eur, idc AS intraday_cost_eur, soc AS terminal_soc_kwh, (raw < -1e-7 OR raw > 44.16 + 1e-7)::INT AS soc_violation, bad AS curtailment_violation, refill AS terminal_recharge_kwh, refill * greatest(night, 0) / 1000 AS night_energy_cost_eur, dis * 0.05 AS degradation_cost_eur, imp * 0.0549 AS network_cost_eur,
        da + idc + refill * greatest(night, 0) / 1000 + refill * {NIGHT_RATE!r} + dis * 0.05 + imp * {DAY_RATE!r} AS total_cost_eur FROM u""",
)
def physical_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Full settlement of the rule plan: grid charges, terminal recharge, degradation."""
    return ledger.physical_ledger(settled_hours(spark, path), [DAY], "night", SC, TARIFF)


@query(
    "e34_strategy_summary", "strategy:s days:i total_cost:f mean_daily_cost:f std_daily_cost:f max_daily_cost:f p95_daily_cost:f cvar_daily_cost:f total_battery_cost_eur:f",
    """SELECT strategy, days, total_cost, mean_daily_cost, std_daily_cost, max_daily_cost, p95_daily_cost, total_battery_cost_eur, cvar_daily_cost FROM
      (SELECT strategy, count(*) AS days, sum(total_cost_eur) AS total_cost, avg(total_cost_eur) AS mean_daily_cost, stddev_samp(total_cost_eur) AS std_daily_cost, max(total_cost_eur) AS max_daily_cost, quantile_cont(total_cost_eur, 0.95) AS p95_daily_cost, sum(battery_cost_eur) AS total_battery_cost_eur FROM daily_costs GROUP BY 1)
      JOIN (SELECT strategy, avg(c) AS cvar_daily_cost FROM (SELECT strategy, total_cost_eur AS c, row_number() OVER (PARTITION BY strategy ORDER BY total_cost_eur DESC) AS rk, count(*) OVER (PARTITION BY strategy) AS n FROM daily_costs) WHERE rk <= greatest(1, ceil(round(0.05 * n, 9))) GROUP BY 1) USING (strategy)""",
)
def strategy_summary(spark: SparkSession, path: str) -> DataFrame:
    return ledger.strategy_summary(daily_costs(spark, path), ["strategy"], "total_cost_eur", 0.95, ["battery_cost_eur"])


@query("e35_upper_tail_mean", "o_custkey:i cvar:f tail_count:i",
       "SELECT o_custkey, avg(o_totalprice) AS cvar, count(*) AS tail_count FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= greatest(1, ceil(round(0.2 * n, 9))) GROUP BY 1")
def upper_tail_mean(spark: SparkSession, path: str) -> DataFrame:
    """Mean of each customer's largest fifth of orders, by distributed counting."""
    return ranking.upper_tail_means(S.table(spark, path, "orders", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 0.8)


@query(
    "e37_paired_savings", "strategy:s days:i total_saving:f mean_saving:f median_saving:f share_cheaper:f share_dearer:f mean_saving_worst_days:f",
    """WITH p AS (SELECT c.strategy, c.delivery_date_local, b.total_cost_eur AS base, b.total_cost_eur - c.total_cost_eur AS s, row_number() OVER (PARTITION BY c.strategy ORDER BY b.total_cost_eur DESC, c.delivery_date_local) AS rk, count(*) OVER (PARTITION BY c.strategy) AS n
        FROM daily_costs c JOIN daily_costs b ON b.delivery_date_local = c.delivery_date_local AND b.strategy = 'day_ahead_only' WHERE c.strategy <> 'day_ahead_only')
      SELECT strategy, count(*) AS days, sum(s) AS total_saving, avg(s) AS mean_saving, median(s) AS median_saving, avg((s > 1e-9)::INT) AS share_cheaper, avg((s < -1e-9)::INT) AS share_dearer, avg(s) FILTER (WHERE rk <= greatest(1, ceil(round(0.05 * n, 9)))) AS mean_saving_worst_days FROM p GROUP BY 1""",
)
def paired_savings(spark: SparkSession, path: str) -> DataFrame:
    """Savings of each strategy against the day-ahead plan."""
    pairs = S.settle(ledger.paired_days(daily_costs(spark, path), "strategy", "day_ahead_only", [DAY], "total_cost_eur"))
    return ledger.paired_savings(pairs, ["strategy"], DAY)


@query("d20_unmatched_days", "strategy:s unmatched:i",
       """WITH c AS (SELECT DISTINCT strategy, delivery_date_local AS d FROM daily_costs WHERE strategy <> 'stochastic' OR day(delivery_date_local) % 5 > 0), b AS (SELECT d FROM c WHERE strategy = 'day_ahead_only'), n AS (SELECT DISTINCT strategy FROM daily_costs)
         SELECT strategy, (SELECT count(*) FROM b) + count(d) - 2 * count(d) FILTER (WHERE d IN (SELECT d FROM b)) AS unmatched FROM n LEFT JOIN c USING (strategy) GROUP BY 1""")
def unmatched_days(spark: SparkSession, path: str) -> DataFrame:
    """Days of each strategy without a partner, on costs of which one strategy has lost every fifth day of the month."""
    daily = daily_costs(spark, path)
    damaged = daily.filter((F.col("strategy") != "stochastic") | (F.dayofmonth(DAY) % 5 > 0))
    names = ["rule_based", "day_ahead_only", "stochastic", "oracle"]
    gaps = ledger.unmatched_days(damaged, "strategy", names, "day_ahead_only", [DAY]).groupBy("strategy").agg(F.count(F.lit(1)).alias("_n"))
    return daily.select("strategy").distinct().join(gaps, "strategy", "left").withColumn("unmatched", F.coalesce("_n", F.lit(0)))


_T = "(SELECT sum(total_cost_eur) FROM daily_costs WHERE strategy = '{s}')"
_R, _O = _T.format(s="rule_based"), _T.format(s="oracle")
_STEPS = ["rule_based", "day_ahead_only", "stochastic", "oracle"]


@query("e38_opportunity_capture", "strategy:s total_cost:f saving_vs_rule:f incremental_saving:f gap_to_oracle:f capture_pct:f",
       " UNION ALL ".join(
           f"SELECT '{s}' AS strategy, {_T.format(s=s)} AS total_cost, {_R} - {_T.format(s=s)} AS saving_vs_rule, {_T.format(s=_STEPS[max(i - 1, 0)])} - {_T.format(s=s)} AS incremental_saving, {_T.format(s=s)} - {_O} AS gap_to_oracle, CASE WHEN abs({_R} - {_O}) > 1e-12 THEN 100 * ({_R} - {_T.format(s=s)}) / ({_R} - {_O}) END AS capture_pct"
           for i, s in enumerate(_STEPS)
       ))
def opportunity_capture(spark: SparkSession, path: str) -> DataFrame:
    """Share of the rule-to-oracle gap each rung captures."""
    return ledger.opportunity_capture(daily_costs(spark, path), "strategy", "total_cost_eur", "rule_based", "oracle", ["day_ahead_only", "stochastic"])


@query("k09_strategy_ladder", "strategy:s days:i total_cost_eur:f objective_eur:f",
       "SELECT strategy, count(DISTINCT delivery_date_local) AS days, sum(da_price / 1000 * position_kwh + id_price / 1000 * (load_kwh - pv_kwh - discharge_kwh - position_kwh) + cost * discharge_kwh) AS total_cost_eur, sum(da_price / 1000 * position_kwh + cost * discharge_kwh) AS objective_eur FROM ladder WHERE delivery_date_local IN (SELECT delivery_date_local FROM saa_plans) GROUP BY 1")
def strategy_ladder(spark: SparkSession, path: str) -> DataFrame:
    """All rungs through one ledger, beside their cost at day-ahead prices."""
    rows = S.settle(_ladder_rows(spark, path))
    costs = ledger.simple_ledger(rows, [DAY, "strategy"]).groupBy("strategy").agg(F.count(F.lit(1)).alias("days"), F.sum("total_cost_eur").alias("total_cost_eur"))
    objective = planning.plan_objective(rows, ["strategy"], "da_price")
    return costs.join(objective, "strategy")


BLOCK, RESAMPLES = 7, 5000


@query(
    "j13_block_bootstrap", "strategy:s saving_low:f saving_high:f cvar_low:f cvar_high:f",
    f"""WITH p AS (SELECT c.strategy, b.total_cost_eur AS base, c.total_cost_eur AS cand, row_number() OVER (PARTITION BY c.strategy ORDER BY c.delivery_date_local) - 1 AS pos, count(*) OVER (PARTITION BY c.strategy) AS n
        FROM daily_costs c JOIN daily_costs b ON b.delivery_date_local = c.delivery_date_local AND b.strategy = 'day_ahead_only' WHERE c.strategy <> 'day_ahead_only'),
      z AS (SELECT DISTINCT strategy, n FROM p), g AS (SELECT strategy, n, r, bl, ({draw_sql('r', 'bl', 21)} % (n - {BLOCK} + 1)) AS st FROM z, range({RESAMPLES}) AS a(r), range(10) AS b(bl) WHERE bl < ceil(n / {BLOCK}.0)),
      s AS (SELECT g.strategy, g.r, p.base, p.cand, g.n FROM g, range({BLOCK}) AS c(k) JOIN p ON p.strategy = g.strategy AND p.pos = g.st + k WHERE g.bl * {BLOCK} + k < g.n),
      k AS (SELECT *, row_number() OVER (PARTITION BY strategy, r ORDER BY base DESC) AS rb, row_number() OVER (PARTITION BY strategy, r ORDER BY cand DESC) AS rc, greatest(1, ceil(round(0.05 * n, 9))) AS t FROM s),
      m AS (SELECT strategy, r, avg(base - cand) * max(n) AS saving, avg(base) FILTER (WHERE rb <= t) - avg(cand) FILTER (WHERE rc <= t) AS cvar FROM k GROUP BY 1, 2)
      SELECT strategy, quantile_cont(saving, 0.025) AS saving_low, quantile_cont(saving, 0.975) AS saving_high, quantile_cont(cvar, 0.025) AS cvar_low, quantile_cont(cvar, 0.975) AS cvar_high FROM m GROUP BY 1""",
)
def block_bootstrap(spark: SparkSession, path: str) -> DataFrame:
    """Paired moving-block intervals of total saving and tail-mean reduction."""
    pairs = S.settle(ledger.paired_days(daily_costs(spark, path), "strategy", "day_ahead_only", [DAY], "total_cost_eur"))
    drawn = S.settle(uncertainty.block_bootstrap(pairs, DAY, ["baseline_cost", "candidate_cost", "saving"], BLOCK, RESAMPLES, 21, ["strategy"]))
    keys = ["strategy", "resample"]
    base = drawn.groupBy(*keys).agg((F.avg("saving") * F.count(F.lit(1))).alias("saving"))
    # one resample holds one row per day: a small group, so a plain window limit ranks its tail
    tails = [
        ranking.small_group_tail_mean(drawn, keys, c, 0.95, f"{c}_tail") for c in ("baseline_cost", "candidate_cost")
    ]
    rows = base.join(tails[0], keys).join(tails[1], keys).withColumn("cvar", F.col("baseline_cost_tail") - F.col("candidate_cost_tail"))
    rows = S.settle(rows)
    saving = ranking.exact_quantiles(rows, ["strategy"], "saving", [0.025, 0.975], ["saving_low", "saving_high"])
    return saving.join(ranking.exact_quantiles(rows, ["strategy"], "cvar", [0.025, 0.975], ["cvar_low", "cvar_high"]), "strategy")

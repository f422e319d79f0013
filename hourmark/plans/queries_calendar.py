"""Queries for projections and scalar functions (B-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.functions import numeric as N
from hourmark.operators import ledger, planning, pointintime, shaping
from hourmark.params import CHARGES_2025, DAY_IMPORT, NIGHT_IMPORT, QUANTILE_LEVELS, SITE_LATITUDE, SITE_LONGITUDE, rate, site
from hourmark.plans import series as S
from hourmark.plans.catalog import query
from hourmark.plans.series import berlin, to_utc

LOC = berlin("valid_time_utc")


@query(
    "b01_calendar_features",
    "o_orderkey:i valid_time_local:s delivery_date_local:d hour_local:i day_of_week:i day_of_year:i month:i is_weekend:i",
    f"""SELECT o_orderkey, strftime(l, '%Y-%m-%d %H:%M:%S') AS valid_time_local, l::DATE AS delivery_date_local, hour(l) AS hour_local,
      isodow(l) - 1 AS day_of_week, dayofyear(l) AS day_of_year, month(l) AS month, (isodow(l) >= 6)::INT AS is_weekend
      FROM (SELECT o_orderkey, {LOC} AS l FROM order_clock)""",
)
def calendar_features(spark: SparkSession, path: str) -> DataFrame:
    return C.with_calendar(S.order_clock(spark, path))


@query(
    "b02_cyclical", "o_orderkey:i hour_sin:f hour_cos:f day_of_year_sin:f day_of_year_cos:f",
    f"""SELECT o_orderkey, sin(2 * pi() * hour(l) / 24) AS hour_sin, cos(2 * pi() * hour(l) / 24) AS hour_cos,
      sin(2 * pi() * dayofyear(l) / 366) AS day_of_year_sin, cos(2 * pi() * dayofyear(l) / 366) AS day_of_year_cos
      FROM (SELECT o_orderkey, {LOC} AS l FROM order_clock)""",
)
def cyclical(spark: SparkSession, path: str) -> DataFrame:
    return C.with_calendar(S.order_clock(spark, path))


EASTER = "(VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'), (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'), (2001, DATE '2001-04-15'), (2002, DATE '2002-03-31'))"


@query(
    "b03_easter", "year:i easter:d orders:i",
    f"SELECT y AS year, e AS easter, count(*) AS orders FROM orders JOIN {EASTER} AS t(y, e) ON year(o_orderdate) = y GROUP BY ALL",
)
def easter(spark: SparkSession, path: str) -> DataFrame:
    """Computed Easter dates (the SQL side holds the published ones)."""
    years = S.table(spark, path, "orders", "o_orderdate").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return years.withColumn("easter", C.easter_sunday(F.col("year")))


HOLIDAYS = f"""SELECT make_date(y, m, d) AS h FROM {EASTER} AS t(y, e), (VALUES (1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) AS f(m, d)
  UNION SELECT (e + o)::DATE FROM {EASTER} AS t(y, e), (VALUES (-2), (1), (39), (50)) AS g(o)"""


@query(
    "b04_holidays", "day:d is_holiday_de:i is_pre_holiday_de:i is_post_holiday_de:i orders:i",
    f"""WITH hol AS ({HOLIDAYS}) SELECT o_orderdate::DATE AS day, max((o_orderdate::DATE IN (SELECT h FROM hol))::INT) AS is_holiday_de,
      max(((o_orderdate::DATE + 1) IN (SELECT h FROM hol))::INT) AS is_pre_holiday_de, max(((o_orderdate::DATE - 1) IN (SELECT h FROM hol))::INT) AS is_post_holiday_de,
      count(*) AS orders FROM orders GROUP BY 1""",
)
def holidays(spark: SparkSession, path: str) -> DataFrame:
    days = S.table(spark, path, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return days.withColumns(C.holiday_columns(F.col("day")))


def _market_clock(name: str, days_back: int, hour: int, column, doc: str) -> None:
    local_day = f"CAST({LOC} AS DATE)"
    sql = f"SELECT o_orderkey, {local_day} AS day, {to_utc(f'({local_day} - {days_back})::TIMESTAMP + INTERVAL {hour} HOUR')} AS instant FROM order_clock"

    def run(spark: SparkSession, path: str) -> DataFrame:
        rows = S.order_clock(spark, path).withColumn("day", C.local_date(F.col("valid_time_utc")))
        return rows.select("o_orderkey", "day", column(F.col("day")).alias("instant"))

    run.__doc__ = doc
    query(name, "o_orderkey:i day:d instant:t", sql)(run)


_market_clock("b05_decision_time", 1, 11, C.decision_time, "D-1 11:00 local as an instant, DST included.")
_market_clock("b06_publication_time", 1, 13, C.publication_time, "Auction outcome of the delivery day.")
_market_clock("b06_history_curve_time", 2, 13, C.history_curve_time, "Publication of the previous day's curve.")


@query(
    "b07_fixed_delay", "o_orderkey:i measured_at:t layer24_at:t layer48_at:t run_at:t",
    "SELECT o_orderkey, valid_time_utc + INTERVAL 1 HOUR AS measured_at, valid_time_utc - INTERVAL 24 HOUR AS layer24_at,"
    " valid_time_utc - INTERVAL 48 HOUR AS layer48_at, valid_time_utc + INTERVAL 6 HOUR AS run_at FROM order_clock",
)
def fixed_delay(spark: SparkSession, path: str) -> DataFrame:
    t = F.col("valid_time_utc")
    return S.order_clock(spark, path).select(
        "o_orderkey", (t + C.hours(1)).alias("measured_at"), (t - C.hours(24)).alias("layer24_at"),
        (t - C.hours(48)).alias("layer48_at"), (t + C.hours(6)).alias("run_at"),
    )


@query(
    "b08_horizon_hours", "o_orderkey:i horizon_hours:i",
    f"SELECT o_orderkey, date_diff('hour', {to_utc(f'(CAST({LOC} AS DATE) - 1)::TIMESTAMP + INTERVAL 11 HOUR')}, valid_time_utc) AS horizon_hours FROM order_clock",
)
def horizon(spark: SparkSession, path: str) -> DataFrame:
    t = F.col("valid_time_utc")
    return S.order_clock(spark, path).select("o_orderkey", C.horizon_hours(t, C.decision_time(C.local_date(t))).alias("horizon_hours"))


SEASON_SQL = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'winter' WHEN month({d}) IN (3, 4, 5) THEN 'spring' WHEN month({d}) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END"
TYPE_SQL = "CASE WHEN isodow({d}) >= 6 THEN 'weekend' ELSE 'workday' END"


@query(
    "b09_season_day_type", "season:s day_type:s orders:i",
    f"SELECT {SEASON_SQL.format(d='o_orderdate')} AS season, {TYPE_SQL.format(d='o_orderdate')} AS day_type, count(*) AS orders FROM orders GROUP BY ALL",
)
def season_day_type(spark: SparkSession, path: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    rows = S.table(spark, path, "orders", "o_orderdate").select(C.season(F.month(d)).alias("season"), C.day_type(d).alias("day_type"))
    return rows.groupBy("season", "day_type").agg(F.count(F.lit(1)).alias("orders"))


LAT, LON = SITE_LATITUDE, SITE_LONGITUDE
SOLAR_SQL = f"""SELECT *, CASE WHEN az < 0 THEN az + 360 ELSE az END AS azimuth, CASE WHEN sin(radians(elevation)) > 0
    THEN 1098.0 * sin(radians(elevation)) * exp(-0.057 / sin(radians(elevation))) ELSE 0 END AS ghi
  FROM (SELECT t, degrees(asin(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(ha))) AS elevation,
      degrees(atan2(-cos(dec) * sin(ha), cos(lat) * sin(dec) - sin(lat) * cos(dec) * cos(ha))) AS az
    FROM (SELECT t, radians({LAT}) AS lat, dec, radians((minute_ + eq + 4 * {LON}) / 4 - 180) AS ha
      FROM (SELECT t, minute_, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS eq,
          0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS dec
        FROM (SELECT t, hour(t) * 60 + minute(t) + second(t) / 60.0 AS minute_, 2 * pi() / 365 * (dayofyear(t) - 1 + (hour(t) + minute(t) / 60.0 + second(t) / 3600.0 - 12) / 24) AS g
          FROM (SELECT DISTINCT valid_time_utc AS t FROM order_clock)))))"""


def solar_rows(rows: DataFrame) -> DataFrame:
    """Solar columns as a plain projection: a score of trigonometric terms costs less than a shuffle."""
    placed = C.with_solar_position(rows, "valid_time_utc", LAT, LON)
    return placed.withColumn("clear_sky_ghi", C.haurwitz_ghi(F.col("solar_elevation_deg")))


@query(
    "b10_solar_position", "o_orderkey:i solar_elevation_deg:f solar_azimuth_deg:f",
    f"SELECT o_orderkey, elevation AS solar_elevation_deg, azimuth AS solar_azimuth_deg FROM order_clock JOIN ({SOLAR_SQL}) ON t = valid_time_utc",
)
def solar_position(spark: SparkSession, path: str) -> DataFrame:
    return solar_rows(S.order_clock(spark, path))


@query(
    "b11_clear_sky_index", "o_orderkey:i clear_sky_ghi:f clear_sky_index:f valid:i",
    f"SELECT o_orderkey, ghi AS clear_sky_ghi, CASE WHEN ghi >= 20 THEN o_totalprice / 1000 / ghi ELSE -999 END AS clear_sky_index, (ghi >= 20)::INT AS valid"
    f" FROM order_clock JOIN ({SOLAR_SQL}) ON t = valid_time_utc",
)
def clear_sky(spark: SparkSession, path: str) -> DataFrame:
    return solar_rows(S.order_clock(spark, path)).withColumns(
        {
            "clear_sky_index": N.clear_sky_index(F.col("o_totalprice") / 1000.0, F.col("clear_sky_ghi"), 20.0),
            "valid": (F.col("clear_sky_ghi") >= 20.0).cast("int"),
        }
    )


LAYERS = [(24, "f24_", "f24_available_at"), (48, "f48_", "f48_available_at")]
AS_OF_SQL = to_utc("(delivery_date_local - 1)::TIMESTAMP + INTERVAL 11 HOUR")
LAYER_SPEC = "valid_time_utc:t fc_da_price:f fc_pv_kwh:f fc_lead_hours:i fc_available_at_utc:t"


def _layer_sql(use24: str, use48: str) -> str:
    pick = lambda a, b: f"CASE WHEN {use24} THEN {a} WHEN {use48} THEN {b} END"
    return (
        f"SELECT valid_time_utc, {pick('f24_da_price', 'f48_da_price')} AS fc_da_price, {pick('f24_pv_kwh', 'f48_pv_kwh')} AS fc_pv_kwh,"
        f" {pick('24', '48')} AS fc_lead_hours, {pick('f24_available_at', 'f48_available_at')} AS fc_available_at_utc"
        f" FROM (SELECT *, {AS_OF_SQL} AS as_of_utc FROM layered_forecasts)"
    )


FULL24, FULL48 = "f24_da_price IS NOT NULL AND f24_pv_kwh IS NOT NULL", "f48_da_price IS NOT NULL AND f48_pv_kwh IS NOT NULL"


def _layered(spark: SparkSession, path: str) -> DataFrame:
    rows = S.layered_forecasts(S.settle(S.market(spark, path)))
    return rows.withColumn("as_of_utc", C.decision_time(F.col("delivery_date_local")))


@query("b12_freshest_layer", LAYER_SPEC, _layer_sql(f"f24_available_at <= as_of_utc AND {FULL24}", f"f48_available_at <= as_of_utc AND {FULL48}"))
def freshest_layer(spark: SparkSession, path: str) -> DataFrame:
    """24 h layer when complete and available at D-1 11:00, else 48 h, else null."""
    return pointintime.freshest_complete_layer(_layered(spark, path), ["da_price", "pv_kwh"], LAYERS, F.col("as_of_utc"), "fc_")


@query(
    "b13_per_variable_fallback", "valid_time_utc:t fc_da_price:f fc_da_price_lead_hours:i fc_pv_kwh:f fc_pv_kwh_lead_hours:i",
    "SELECT valid_time_utc, " + ", ".join(
        f"CASE WHEN a24 AND f24_{v} IS NOT NULL THEN f24_{v} WHEN a48 THEN f48_{v} END AS fc_{v},"
        f" CASE WHEN a24 AND f24_{v} IS NOT NULL THEN 24 WHEN a48 AND f48_{v} IS NOT NULL THEN 48 END AS fc_{v}_lead_hours"
        for v in ("da_price", "pv_kwh")
    ) + f" FROM (SELECT *, f24_available_at <= {AS_OF_SQL} AS a24, f48_available_at <= {AS_OF_SQL} AS a48 FROM layered_forecasts)",
)
def per_variable_fallback(spark: SparkSession, path: str) -> DataFrame:
    return pointintime.per_variable_fallback(_layered(spark, path), ["da_price", "pv_kwh"], LAYERS, F.col("as_of_utc"), "fc_")


@query("b14_masked_layer", LAYER_SPEC, _layer_sql(f"f24_available_at <= as_of_utc AND {FULL24}", f"f48_available_at <= as_of_utc AND {FULL48}"))
def masked_layer(spark: SparkSession, path: str) -> DataFrame:
    """Layer choice on values masked by availability first."""
    masked = pointintime.mask_unavailable(
        _layered(spark, path), F.col("as_of_utc"),
        {"f24_available_at": ["f24_da_price", "f24_pv_kwh"], "f48_available_at": ["f48_da_price", "f48_pv_kwh"]},
    )
    return pointintime.freshest_complete_layer(masked, ["da_price", "pv_kwh"], LAYERS, None, "fc_")


@query("b15_unit_scaling", "event_id:i energy_kwh:f scaled_kwh:f", "SELECT event_id, value / 1000 AS energy_kwh, value / 1000 * 20 AS scaled_kwh FROM events")
def unit_scaling(spark: SparkSession, path: str) -> DataFrame:
    energy = F.col("value") / 1000.0
    return S.table(spark, path, "events", "event_id", "value").select("event_id", energy.alias("energy_kwh"), (energy * site().pv_scale).alias("scaled_kwh"))


@query(
    "b16_ratio_sentinel", "l_orderkey:i l_linenumber:i ratio:f valid:i",
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) <= 1e-8 THEN -99 ELSE l_tax / l_discount END AS ratio, (abs(l_discount) > 1e-8)::INT AS valid FROM lineitem",
)
def ratio_sentinel(spark: SparkSession, path: str) -> DataFrame:
    rows = S.table(spark, path, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return rows.withColumns(
        {"ratio": N.ratio_or_sentinel(F.col("l_tax"), F.col("l_discount")), "valid": (F.abs("l_discount") > 1e-8).cast("int")}
    )


@query(
    "b17_calibrated_blend", "l_orderkey:i l_linenumber:i blended:f",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_extendedprice + 0.7 * (l_quantity * 1000 - l_extendedprice) ELSE l_extendedprice END AS blended FROM lineitem",
)
def calibrated_blend(spark: SparkSession, path: str) -> DataFrame:
    """Line number stands for the lead: only lead 1 is moved."""
    rows = S.table(spark, path, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    blended = N.blend_at_lead(F.col("l_extendedprice"), F.col("l_quantity") * 1000.0, 0.7, F.col("l_linenumber"))
    return rows.withColumn("blended", blended)


@query(
    "b18_one_hot_sites", "site_id:s site_click:i site_error:i site_purchase:i site_signup:i site_view:i rows:i invalid:i",
    "SELECT CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE event_type END AS site_id, " + ", ".join(f"max((event_id % 10 <> 0 AND event_type = '{s}')::INT) AS site_{s}" for s in S.SITES)
    + ", count(*) AS rows, count(*) FILTER (WHERE event_id % 10 = 0) AS invalid FROM events GROUP BY 1",
)
def one_hot_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site flags; every tenth reading gets a site outside the list, which the row-sum check counts."""
    named = F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(F.col("event_type")).alias("site_id")
    rows = shaping.one_hot(S.table(spark, path, "events", "event_id", "event_type").select(named), "site_id", S.SITES, "site_")
    total = sum((F.col(f"site_{s}") for s in S.SITES), F.lit(0))
    return rows.groupBy("site_id").agg(
        *[F.max(f"site_{s}").alias(f"site_{s}") for s in S.SITES], F.count(F.lit(1)).alias("rows"), F.count_if(total != 1).alias("invalid")
    )


@query(
    "b19_night_labels", "valid_time_utc:t night_end:d reference_day:d",
    "SELECT valid_time_utc, delivery_date_local + (hour_local >= 22)::INT AS night_end, delivery_date_local + (hour_local >= 22)::INT + 1 AS reference_day FROM market",
)
def night_labels(spark: SparkSession, path: str) -> DataFrame:
    night = C.night_end_date(F.col("delivery_date_local"), F.col("hour_local"))
    return S.market(spark, path).select("valid_time_utc", night.alias("night_end"), F.date_add(night, 1).alias("reference_day"))


_JAN = f"(SELECT m.valid_time_utc, m.pv_kwh, m.pv_kwh - p.pv_kwh AS delta FROM market m JOIN market p ON p.valid_time_utc = m.valid_time_utc - INTERVAL 24 HOUR)"


@query("b20_weather_refresh", "valid_time_utc:t level:f delta:f log_index:f valid:i",
       f"SELECT valid_time_utc, pv_kwh AS level, delta, CASE WHEN ghi > 0 THEN ln(1 + pv_kwh / ghi) ELSE -999 END AS log_index, (ghi > 0)::INT AS valid FROM {_JAN} JOIN ({SOLAR_SQL.replace('order_clock', 'market')}) ON t = valid_time_utc")
def weather_refresh(spark: SparkSession, path: str) -> DataFrame:
    """Refreshed level, its change against the day-ahead layer, and its share of clear-sky irradiance.

    The index is shown as ``ln(1 + index)``: near the horizon the ratio has no bound.
    """
    from hourmark.operators.features import hour_lags

    rows = hour_lags(S.settle(S.market(spark, path)), [], "valid_time_utc", ["pv_kwh"], [24], names="{value}_lag{lag}").dropna(subset=["pv_kwh_lag24"])
    delta = F.col("pv_kwh") - F.col("pv_kwh_lag24")
    sunny = F.col("clear_sky_ghi") > 0
    return solar_rows(rows).select(
        "valid_time_utc", F.col("pv_kwh").alias("level"), delta.alias("delta"),
        F.when(sunny, F.log1p(F.col("pv_kwh") / F.col("clear_sky_ghi"))).otherwise(-999.0).alias("log_index"), sunny.cast("int").alias("valid"),
    )


@query(
    "b22_monotone_quantiles", "valid_time_utc:t " + " ".join(f"{c}:f" for c in S.Q_COLUMNS),
    "SELECT valid_time_utc, " + ", ".join(f"list_sort([{', '.join(S.Q_COLUMNS)}])[{i + 1}] AS {c}" for i, c in enumerate(S.Q_COLUMNS)) + " FROM quantile_forecasts",
)
def monotone_quantiles(spark: SparkSession, path: str) -> DataFrame:
    rows = S.quantile_forecasts(S.points(S.settle(S.market(spark, path)))).withColumn("_q", N.sorted_quantiles(list(S.Q_COLUMNS)))
    return rows.select("valid_time_utc", *[F.col("_q")[i].alias(c) for i, c in enumerate(S.Q_COLUMNS)])


def inverse_sql(rank: str, values: str, levels=QUANTILE_LEVELS) -> str:
    """SQL: clamp the rank and interpolate between neighbouring levels."""
    u = f"least(greatest({rank}, {levels[0]}), {levels[-1]})"
    arms = " ".join(
        f"WHEN {u} < {levels[i + 1]} THEN {values}[{i + 1}] + ({u} - {levels[i]}) / ({levels[i + 1]} - {levels[i]}) * ({values}[{i + 2}] - {values}[{i + 1}])"
        for i in range(len(levels) - 1)
    )
    return f"CASE {arms} ELSE {values}[{len(levels)}] END"


@query(
    "b23_inverse_marginal", "valid_time_utc:t rank:f value:f",
    f"SELECT valid_time_utc, u AS rank, {inverse_sql('u', 'q')} AS value FROM (SELECT valid_time_utc, (hour_local * 31 + day(delivery_date_local) * 17) % 100 / 100.0 AS u,"
    f" list_sort([{', '.join(S.Q_COLUMNS)}]) AS q FROM quantile_forecasts)",
)
def inverse_marginal(spark: SparkSession, path: str) -> DataFrame:
    rows = S.quantile_forecasts(S.points(S.settle(S.market(spark, path))))
    rank = (F.col("hour_local") * 31 + F.dayofmonth("delivery_date_local") * 17) % 100 / 100.0
    rows = rows.withColumns({"rank": rank, "_q": N.sorted_quantiles(list(S.Q_COLUMNS))})
    return rows.withColumn("value", N.inverse_marginal(F.col("rank"), F.col("_q"), QUANTILE_LEVELS))


@query("b24_physical_clip", "event_id:i clipped:f", "SELECT event_id, least(greatest(value - 20, 0), 60) AS clipped FROM events")
def physical_clip(spark: SparkSession, path: str) -> DataFrame:
    return S.table(spark, path, "events", "event_id", "value").withColumn("clipped", N.clip(F.col("value") - 20.0, 0.0, 60.0))


@query(
    "b25_circular_distance", "o_orderkey:i distance:i",
    "SELECT o_orderkey, least(abs(a - 15), 366 - abs(a - 15)) AS distance FROM (SELECT o_orderkey, dayofyear(make_date(2000, month(o_orderdate), day(o_orderdate))) AS a FROM orders)",
)
def circular_distance(spark: SparkSession, path: str) -> DataFrame:
    """Calendar distance of each order day to 15 January."""
    here = C.calendar_ordinal(F.to_date("o_orderdate"))
    return S.table(spark, path, "orders", "o_orderkey", "o_orderdate").withColumn("distance", C.circular_distance(here, F.lit(15)))


@query(
    "b26_feature_sets", "feature_set:s valid_time_utc:t f1:f f2:f",
    "SELECT 'legacy' AS feature_set, valid_time_utc, da_price AS f1, pv_kwh AS f2 FROM layered_forecasts UNION ALL SELECT 'replace', valid_time_utc, f24_da_price, f24_pv_kwh FROM layered_forecasts"
    " UNION ALL SELECT 'revision', valid_time_utc, f24_da_price - f48_da_price, f24_pv_kwh - f48_pv_kwh FROM layered_forecasts",
)
def feature_sets(spark: SparkSession, path: str) -> DataFrame:
    """Named feature lists selected from one frame: legacy levels, replaced levels, revisions only."""
    rows = S.layered_forecasts(S.settle(S.market(spark, path)))
    lists = {
        "legacy": (F.col("da_price"), F.col("pv_kwh")), "replace": (F.col("f24_da_price"), F.col("f24_pv_kwh")),
        "revision": (F.col("f24_da_price") - F.col("f48_da_price"), F.col("f24_pv_kwh") - F.col("f48_pv_kwh")),
    }
    variants = F.array(*[F.struct(F.lit(n).alias("feature_set"), a.alias("f1"), b.alias("f2")) for n, (a, b) in lists.items()])
    return rows.select("valid_time_utc", F.inline(variants))


DAY_RATE, NIGHT_RATE = rate(CHARGES_2025, DAY_IMPORT), rate(CHARGES_2025, NIGHT_IMPORT)


@query(
    "b27_charge_economics", "valid_time_utc:t grid_import_kwh:f grid_export_kwh:f grid_charge_cost:f overnight_cost:f cheaper:i",
    f"""SELECT valid_time_utc, greatest(5 - pv_kwh, 0) AS grid_import_kwh, greatest(pv_kwh - 5, 0) AS grid_export_kwh, da_price / 1000 + {DAY_RATE!r} AS grid_charge_cost,
      greatest(id_price, 0) / 1000 + {NIGHT_RATE!r} AS overnight_cost, (da_price / 1000 + {DAY_RATE!r} < greatest(id_price, 0) / 1000 + {NIGHT_RATE!r})::INT AS cheaper FROM market""",
)
def charge_economics(spark: SparkSession, path: str) -> DataFrame:
    rows = S.market(spark, path).withColumns({"load": F.lit(5.0), "zero": F.lit(0.0)})
    rows = ledger.physical_exchange(rows, "load", "zero", "pv_kwh", "zero", "zero")
    econ = ledger.charge_economics(F.col("da_price"), F.col("id_price"), CHARGES_2025)
    return rows.withColumns({"grid_charge_cost": econ["grid_charge_cost_eur_per_kwh"], "overnight_cost": econ["overnight_cost_eur_per_kwh"], "cheaper": econ["grid_charge_cheaper"]})


@query(
    "b28_battery_cost", "valid_time_utc:t night_energy:f night_grid:f degradation:f battery_cost:f stored_value:f unfloored_cost:f",
    f"""SELECT valid_time_utc, greatest(da_price, 0) / 1000 / 0.9604 AS night_energy, {NIGHT_RATE!r} / 0.9604 AS night_grid, 0.05 AS degradation,
      greatest(da_price, 0) / 1000 / 0.9604 + {NIGHT_RATE!r} / 0.9604 + 0.05 AS battery_cost, (greatest(da_price, 0) / 1000 + {NIGHT_RATE!r}) / 0.98 AS stored_value,
      da_price / 1000 / 0.9604 + 0.05 AS unfloored_cost FROM market""",
)
def battery_cost(spark: SparkSession, path: str) -> DataFrame:
    cost = planning.battery_cost(F.col("da_price"), site(), CHARGES_2025)
    plain = planning.battery_cost(F.col("da_price"), site(), floor=False)
    names = {"night_energy": "night_energy_eur_per_kwh", "night_grid": "night_grid_eur_per_kwh", "degradation": "degradation_eur_per_kwh",
             "battery_cost": "battery_cost_eur_per_kwh", "stored_value": "terminal_soc_value_eur_per_kwh"}
    return S.market(spark, path).select(
        "valid_time_utc", *[cost[v].alias(k) for k, v in names.items()], plain["battery_cost_eur_per_kwh"].alias("unfloored_cost")
    )


@query(
    "b29_tariff_rates", "segment:s daytime:f nighttime:f fixed_daily:f customers:i",
    "SELECT c_mktsegment AS segment, 0.0549 + 0.02651 + 0.0199 + 0.0005 AS daytime, 0.0275 + 0.02651 + 0.0199 + 0.0005 AS nighttime, (80 + 29.21) / 365 AS fixed_daily, count(*) AS customers FROM customer GROUP BY 1",
)
def tariff_rates(spark: SparkSession, path: str) -> DataFrame:
    rates = ledger.tariff_rates(CHARGES_2025)
    counts = S.table(spark, path, "customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    return counts.withColumns({"daytime": rates["daytime_import_eur_per_kwh"], "nighttime": rates["nighttime_import_eur_per_kwh"], "fixed_daily": rates["fixed_daily_eur"]})


@query(
    "b30_persistence_baselines", "site_id:s valid_time_utc:t lag_forecast:f corrected_forecast:f",
    """SELECT a.site_id, a.valid_time_utc, d.value AS lag_forecast, CASE WHEN h.value - g.value IS NOT NULL THEN greatest(d.value + h.value - g.value, 0) END AS corrected_forecast FROM site_hours a
      JOIN site_hours d ON d.site_id = a.site_id AND d.valid_time_utc = a.valid_time_utc - INTERVAL 24 HOUR
      LEFT JOIN site_hours h ON h.site_id = a.site_id AND h.valid_time_utc = a.valid_time_utc - INTERVAL 2 HOUR
      LEFT JOIN site_hours g ON g.site_id = a.site_id AND g.valid_time_utc = a.valid_time_utc - INTERVAL 26 HOUR
""",
)
def persistence_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Same hour yesterday, and that base plus the last completed hour's residual."""
    from hourmark.operators.features import hour_lags

    rows = hour_lags(S.settle(S.site_hours(spark, path)), ["site_id"], "valid_time_utc", ["value"], [2, 24, 26], names="lag{lag}").dropna(subset=["lag24"])
    residual = F.col("lag2") - F.col("lag26")
    return rows.select("site_id", "valid_time_utc", F.col("lag24").alias("lag_forecast"),
                       F.when(residual.isNotNull(), N.clip(F.col("lag24") + residual, 0.0)).alias("corrected_forecast"))

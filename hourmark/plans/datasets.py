"""The energy feature tables, built from typed sources to named columns.

Sources use the column names of the public data dictionary (15-minute profiles,
hourly actual weather, fixed-lead forecasts, auction prices). Builders return
lazy frames; settle or write the canonical table once and branch from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmark.functions import calendar as C
from hourmark.operators import contracts, features, pointintime, shaping, splits
from hourmark.params import LOCAL_TZ, OUTAGE_DATES, WEATHER_VARIABLES

DA_PRICE = "day_ahead_price_eur_per_mwh"
FORECAST_LAYERS = [(24, "weather_fcst24_", "weather_fcst24_available_at_utc"), (48, "weather_fcst48_", "weather_fcst48_available_at_utc")]
BASE_COLUMNS = [
    "as_of_utc", "valid_time_utc", "valid_time_local", "delivery_date_local", "horizon_hours", "hour_local", "day_of_week",
    "day_of_year", "month", "is_weekend", "hour_sin", "hour_cos", "day_of_year_sin", "day_of_year_cos",
]


def availability_groups(variables: Sequence[str] = WEATHER_VARIABLES) -> dict[str, list[str]]:
    """Availability column of the canonical table -> values it governs."""
    return {
        "pv_available_at_utc": ["pv_power_mean_w", "pv_energy_kwh", "pv_intervals", "pv_quality_status"],
        "weather_actual_available_at_utc": [f"weather_actual_{v}" for v in variables],
        "weather_fcst24_available_at_utc": [f"weather_fcst24_{v}" for v in variables],
        "weather_fcst48_available_at_utc": [f"weather_fcst48_{v}" for v in variables],
        "day_ahead_price_available_at_utc": [DA_PRICE],
    }


def canonical_hourly(
    pv: DataFrame, actual: DataFrame, forecast: DataFrame, prices: DataFrame, profile: str,
    variables: Sequence[str] = WEATHER_VARIABLES, outages: Sequence[str] = OUTAGE_DATES, tz: str = LOCAL_TZ,
) -> DataFrame:
    """One row per UTC hour any source has, each value group with its availability time."""
    t = F.col("valid_time_utc")
    power = shaping.resample_hourly(pv, [], "valid_time_utc", profile, "pv_quality_status").withColumnsRenamed(
        {"power_mean_w": "pv_power_mean_w", "intervals": "pv_intervals", "quality_status": "pv_quality_status", "energy_kwh": "pv_energy_kwh", "available_at_utc": "pv_available_at_utc"}
    )
    observed = actual.select(
        "valid_time_utc", *[F.col(v).alias(f"weather_actual_{v}") for v in variables], (t + C.hours(1)).alias("weather_actual_available_at_utc")
    )
    layers = forecast.select(
        "valid_time_utc",
        *[F.col(f"{v}_previous_day{d}").alias(f"weather_fcst{24 * d}_{v}") for d in (1, 2) for v in variables],
        *[(t - C.hours(24 * d)).alias(f"weather_fcst{24 * d}_available_at_utc") for d in (1, 2)],
    )
    hourly_prices = shaping.coarse_steps(prices, [], "valid_time_utc").select(
        "valid_time_utc", DA_PRICE, C.publication_time(C.local_date(t, tz), tz).alias("day_ahead_price_available_at_utc")
    )
    joined = shaping.outer_on_time([observed, layers, hourly_prices, power], ["valid_time_utc"])
    out = C.with_calendar(joined, "valid_time_utc", tz)
    return shaping.override_status(out, "delivery_date_local", outages, "pv_quality_status", "suspected_source_outage")


def _with_decision(canonical: DataFrame, tz: str) -> DataFrame:
    as_of = C.decision_time(F.col("delivery_date_local"), tz)
    return canonical.withColumn("as_of_utc", as_of).withColumn("horizon_hours", C.horizon_hours(F.col("valid_time_utc"), F.col("as_of_utc")))


def _of_year(df: DataFrame, year: int) -> DataFrame:
    return df.filter(F.year("delivery_date_local") == year)


def day_ahead_pv(canonical: DataFrame, year: int, variables: Sequence[str] = WEATHER_VARIABLES, tz: str = LOCAL_TZ) -> DataFrame:
    """PV targets with the weather layer known at D-1 11:00, usable complete cases only."""
    rows = _with_decision(_of_year(canonical, year), tz)
    rows = pointintime.freshest_complete_layer(rows, variables, FORECAST_LAYERS, F.col("as_of_utc"))
    forecast = [f"weather_forecast_{v}" for v in variables]
    rows = rows.filter(F.col("pv_quality_status") == "usable").dropna(subset=["valid_time_utc", "as_of_utc", "pv_power_mean_w", "pv_energy_kwh", *forecast])
    rows = splits.with_week_index(rows, "valid_time_utc", tz)
    return rows.select(
        *BASE_COLUMNS, "week_index", *forecast,
        (F.col("weather_forecast_shortwave_radiation") > 0).cast("int").alias("forecast_shortwave_is_daylight"),
        "weather_forecast_lead_hours", "weather_forecast_available_at_utc", F.col("pv_available_at_utc").alias("target_available_at_utc"),
        "pv_power_mean_w", "pv_energy_kwh", "pv_quality_status",
    )


def oracle_pv(canonical: DataFrame, targets: DataFrame, variables: Sequence[str] = WEATHER_VARIABLES) -> DataFrame:
    """The day-ahead PV rows seen with actual weather instead of forecasts."""
    actual = [f"weather_actual_{v}" for v in variables]
    weather = canonical.select("valid_time_utc", *actual, "weather_actual_available_at_utc")
    rows = targets.join(weather, "valid_time_utc", "left").dropna(subset=["pv_power_mean_w", "pv_energy_kwh", *actual])
    return rows.select(
        *BASE_COLUMNS, "week_index", *actual, "weather_actual_available_at_utc", "target_available_at_utc", "pv_power_mean_w", "pv_energy_kwh", "pv_quality_status"
    )


PRICE_LAGS = (24, 168, 336, 504, 672)


def day_ahead_price(canonical: DataFrame, year: int, variables: Sequence[str] = WEATHER_VARIABLES, tz: str = LOCAL_TZ) -> DataFrame:
    """Price targets with elapsed-hour lags, their availability, and the weather layer."""
    history = canonical.select("valid_time_utc", F.col(DA_PRICE).alias("price"), F.col("day_ahead_price_available_at_utc").alias("at"))
    values = features.hour_lags(history, [], "valid_time_utc", ["price"], PRICE_LAGS)
    times = features.hour_lags(history, [], "valid_time_utc", ["at"], PRICE_LAGS[:2], names="price_lag_{lag}h_available_at_utc")
    lags = values.select("valid_time_utc", *[f"price_lag_{k}h" for k in PRICE_LAGS]).join(
        times.select("valid_time_utc", *[f"price_lag_{k}h_available_at_utc" for k in PRICE_LAGS[:2]]), "valid_time_utc"
    )
    rows = _with_decision(_of_year(canonical, year), tz).join(lags, "valid_time_utc")
    rows = pointintime.freshest_complete_layer(rows, variables, FORECAST_LAYERS, F.col("as_of_utc"))
    forecast = [f"weather_forecast_{v}" for v in variables]
    rows = rows.dropna(subset=[DA_PRICE, "price_lag_24h", "price_lag_168h", *forecast])
    usable = pointintime.causality_filter(
        rows, ["weather_forecast_available_at_utc", "price_lag_24h_available_at_utc", "price_lag_168h_available_at_utc"]
    )
    four_weeks = features.mean_skipping_nulls([f"price_lag_{k}h" for k in PRICE_LAGS[1:]])
    return usable.select(
        *BASE_COLUMNS, *forecast, "weather_forecast_lead_hours", "weather_forecast_available_at_utc", *[f"price_lag_{k}h" for k in PRICE_LAGS],
        four_weeks.alias("price_same_hour_4w_mean"), "price_lag_24h_available_at_utc", "price_lag_168h_available_at_utc",
        F.col("day_ahead_price_available_at_utc").alias("target_available_at_utc"), DA_PRICE,
    )


def mpc_pv(canonical: DataFrame, year: int, horizons: int = 10) -> DataFrame:
    """Intraday PV targets for leads 1..``horizons`` with the newest completed hour."""
    series = canonical.select("valid_time_utc", "pv_power_mean_w", "pv_available_at_utc")
    lags = features.hour_lags(series.select("valid_time_utc", F.col("pv_power_mean_w").alias("v")), [], "valid_time_utc", ["v"], (24, 168), names="pv_target_lag_{lag}h_w")
    usable = _of_year(canonical, year).filter(F.col("pv_quality_status") == "usable")
    targets = usable.join(lags.drop("v"), "valid_time_utc")
    fan = features.horizon_fanout(targets, "valid_time_utc", horizons)
    rows = features.last_observed(fan, series, [], "valid_time_utc", "pv_power_mean_w", "pv_available_at_utc", "pv_last_observed_w")
    rows = rows.dropna(subset=["pv_power_mean_w", "pv_energy_kwh", "pv_last_observed_w", "pv_target_lag_24h_w", "pv_target_lag_168h_w"])
    rows = pointintime.causality_filter(rows, ["pv_last_observed_w_available_at_utc"])
    return rows.select(
        *BASE_COLUMNS, "pv_last_observed_w", "pv_target_lag_24h_w", "pv_target_lag_168h_w",
        F.col("pv_last_observed_w_available_at_utc").alias("pv_last_observation_available_at_utc"), "pv_power_mean_w", "pv_energy_kwh", "pv_quality_status",
    )


def multisite_pv(base: DataFrame, pv: DataFrame, profiles: Sequence[str], eligible: Sequence[str]) -> DataFrame:
    """Base feature rows repeated per eligible profile with that profile's complete hours."""
    unknown = sorted(set(profiles) - set(eligible))
    if unknown or not profiles:
        raise ValueError(f"profiles not eligible: {unknown}")
    stacked = shaping.unpivot_profiles(pv.filter(F.col("valid_time_utc").isNotNull()), ["valid_time_utc"], profiles)
    hourly = shaping.complete_hours(shaping.resample_hourly(stacked, ["site_id"], "valid_time_utc", "power_w"))
    targets = hourly.select(
        "site_id", "valid_time_utc", F.col("power_mean_w").alias("pv_power_mean_w"), F.col("energy_kwh").alias("pv_energy_kwh"),
        F.col("available_at_utc").alias("target_available_at_utc"),
    )
    shared = base.drop("pv_power_mean_w", "pv_energy_kwh", "target_available_at_utc", "pv_quality_status")
    return shaping.one_hot(shared.join(targets, "valid_time_utc"), "site_id", profiles, "site_id_")


def spatial_price_features(prices: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Curve-based price features on regular days: previous curve, lags, statistics, holidays, cut-offs."""
    day, hour, price = "delivery_date_local", "hour_local", DA_PRICE
    t = F.col("valid_time_utc")
    unique = prices.dropna(subset=["valid_time_utc", price]).groupBy("valid_time_utc").agg(F.min(price).alias(price))
    rows = unique.withColumns({day: C.local_date(t, tz), hour: C.local_hour(t, tz)})
    regular = features.only_regular_days(rows, [], day, hour)
    curve = features.previous_curve(regular, [], day, hour, price, "price_prev_day")
    week = features.trailing_days_stats(regular, [], day, price, 7, "price_recent_7d")
    lagged = features.same_clock_history(
        regular, regular, [], day, hour, [price], (1, 2, 7, 14, 21, 28), names="price_lag_d{lag}_same_hour"
    )
    out = lagged.join(curve, day).join(week, day)
    d = F.col(day)
    out = out.withColumns(
        {
            "price_same_hour_4w_mean": features.strict_mean([f"price_lag_d{k}_same_hour" for k in (7, 14, 21, 28)]),
            "as_of_utc": C.decision_time(d, tz), "target_available_at_utc": C.publication_time(d, tz),
            "price_history_available_at_utc": C.history_curve_time(d, tz), **C.holiday_columns(d), **C.calendar_columns(t, tz),
        }
    )
    out = out.withColumns(C.cyclical_columns(F.col(hour), F.col("day_of_year"))).drop("price_lag_d21_same_hour", "price_lag_d28_same_hour")
    return pointintime.causality_filter(out, ["price_history_available_at_utc"], target_time="target_available_at_utc")


def with_spatial_weather(rows: DataFrame, weather: DataFrame, locations: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Per-location weather chosen at each row's decision, all locations as columns in one pivot."""
    asked = rows.select("valid_time_utc", "as_of_utc").join(weather, "valid_time_utc")
    chosen = pointintime.freshest_complete_layer(asked, variables, FORECAST_LAYERS, F.col("as_of_utc"), "")
    wide = features.location_columns(chosen, ["valid_time_utc"], "location_id", locations, [*variables, "lead_hours"])
    complete = wide.dropna(subset=[f"spatial_{loc}_{v}" for loc in locations for v in variables])
    return rows.join(complete, "valid_time_utc")


def dataset_contract(df: DataFrame, keys: Sequence[str], feature_times: Sequence[str]) -> DataFrame:
    """Uniqueness and causality violations of a feature table."""
    late = {f"late_{c}": F.coalesce(F.col(c) > F.col("as_of_utc"), F.lit(True)) for c in feature_times}
    late["target_already_known"] = F.coalesce(F.col("target_available_at_utc") <= F.col("as_of_utc"), F.lit(True))
    return contracts.rule_counts(df, late).unionByName(contracts.duplicate_count(df, keys))


def mpc_context(canonical: DataFrame, decisions: DataFrame, ahead_hours: int, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Future canonical rows of many decisions, masked at each ``as_of_utc``."""
    return pointintime.horizon_context(canonical, decisions, groups or availability_groups(), ahead_hours)

"""Calendar, market-clock and solar column expressions.

Instants are UTC ``TIMESTAMP`` columns; market days follow a local zone, so
anything called ``local`` is the wall clock of ``tz`` and offsets such as
"the day before at 11:00" are taken on that wall clock.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmark.params import DECISION_HOUR, LOCAL_TZ, PUBLICATION_HOUR


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def local_time(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column, tz: str = LOCAL_TZ) -> Column:
    return F.hour(local_time(ts, tz))


def calendar_columns(ts: Column, tz: str = LOCAL_TZ) -> dict[str, Column]:
    """Local calendar fields; Monday is day 0."""
    local = local_time(ts, tz)
    dow = F.weekday(local)
    return {
        "valid_time_local": F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
        "delivery_date_local": F.to_date(local),
        "hour_local": F.hour(local),
        "day_of_week": dow,
        "day_of_year": F.dayofyear(local),
        "month": F.month(local),
        "is_weekend": (dow >= 5).cast("int"),
    }


def cyclical_columns(hour: Column, day_of_year: Column) -> dict[str, Column]:
    """Sine/cosine of the hour (period 24) and the day of year (period 366)."""
    hour_angle = hour * F.lit(2.0 * pi) / 24.0
    day_angle = day_of_year * F.lit(2.0 * pi) / 366.0
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "day_of_year_sin": F.sin(day_angle),
        "day_of_year_cos": F.cos(day_angle),
    }


def with_calendar(df: DataFrame, ts: str = "valid_time_utc", tz: str = LOCAL_TZ) -> DataFrame:
    """Append the calendar fields and their cyclical encoding."""
    out = df.withColumns(calendar_columns(F.col(ts), tz))
    return out.withColumns(cyclical_columns(F.col("hour_local"), F.col("day_of_year")))


def _floordiv(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def easter_sunday(year: Column) -> Column:
    """Western Easter as a day of March, by Lichtenberg's form of Gauss's rule."""
    y = year.cast("bigint")
    century = _floordiv(y, 100)
    skipped = _floordiv(century * 3 + 3, 4)
    secular_moon = skipped + 15 - _floordiv(century * 8 + 13, 25)
    lunar = y % 19
    first_moon = (lunar * 19 + secular_moon) % 30
    correction = _floordiv(first_moon + _floordiv(lunar, 11), 29)
    full_moon = first_moon + 21 - correction
    first_sunday = F.lit(7) - F.pmod(y + _floordiv(y, 4) + 2 - skipped, F.lit(7))
    to_sunday = F.lit(7) - F.pmod(full_moon - first_sunday, F.lit(7))
    return F.date_add(
        F.make_date(year.cast("int"), F.lit(3), F.lit(1)), (full_moon + to_sunday - 1).cast("int")
    )


#: German national holidays, fixed values: (month, day) and days after Easter Sunday.
FIXED_HOLIDAYS = ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))
EASTER_OFFSETS = (-2, 1, 39, 50)


def is_german_holiday(day: Column) -> Column:
    monthday = F.month(day) * 100 + F.dayofmonth(day)
    from_easter = F.datediff(day, easter_sunday(F.year(day)))
    return monthday.isin([m * 100 + d for m, d in FIXED_HOLIDAYS]) | from_easter.isin(
        list(EASTER_OFFSETS)
    )


def holiday_columns(day: Column) -> dict[str, Column]:
    """Holiday today, tomorrow (pre) and yesterday (post), as 0/1."""
    return {
        "is_holiday_de": is_german_holiday(day).cast("int"),
        "is_pre_holiday_de": is_german_holiday(F.date_add(day, 1)).cast("int"),
        "is_post_holiday_de": is_german_holiday(F.date_sub(day, 1)).cast("int"),
    }


def wall_clock(day: Column, days_back: int, hour: int, tz: str = LOCAL_TZ) -> Column:
    """UTC instant of ``hour`` o'clock local, ``days_back`` local days before ``day``."""
    local = F.date_sub(day, days_back).cast("timestamp") + hours(hour)
    return F.to_utc_timestamp(local, tz)


def decision_time(day: Column, tz: str = LOCAL_TZ, hour: int = DECISION_HOUR) -> Column:
    """Day-ahead decision for a delivery day: D-1 at 11:00 on the wall clock."""
    return wall_clock(day, 1, hour, tz)


def publication_time(day: Column, tz: str = LOCAL_TZ, hour: int = PUBLICATION_HOUR) -> Column:
    """Auction outcome for a delivery day: D-1 at 13:00."""
    return wall_clock(day, 1, hour, tz)


def history_curve_time(day: Column, tz: str = LOCAL_TZ, hour: int = PUBLICATION_HOUR) -> Column:
    """The D-1 curve was published on D-2 at 13:00."""
    return wall_clock(day, 2, hour, tz)


def horizon_hours(valid: Column, as_of: Column) -> Column:
    return F.timestamp_diff("HOUR", as_of, valid).cast("int")


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .otherwise("autumn")
    )


def day_type(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "weekend").otherwise("workday")


def night_end_date(day: Column, hour: Column) -> Column:
    """22:00 and 23:00 belong to the night that ends the next morning."""
    return F.date_add(day, F.when(hour >= 22, 1).otherwise(0))


def calendar_ordinal(day: Column) -> Column:
    """Day of year on a leap reference year, so 1 March is 61 in every year."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(day), F.dayofmonth(day)))


def circular_distance(left: Column, right: Column) -> Column:
    """Days between two calendar ordinals around a 366-day circle."""
    direct = F.abs(left - right)
    return F.least(direct, F.lit(366) - direct)


def with_solar_position(df: DataFrame, ts: str, latitude: float, longitude: float) -> DataFrame:
    """Add solar elevation and azimuth in degrees (published NOAA general formulas).

    Built in stages so each intermediate angle is computed once per row.
    """
    t = F.col(ts)
    staged = df.withColumn("_minute", F.hour(t) * 60 + F.minute(t) + F.second(t) / 60.0)
    year_angle = (F.dayofyear(t) - 1 + (F.col("_minute") / 60.0 - 12.0) / 24.0) * F.lit(2.0 * pi / 365.0)
    staged = staged.withColumn("_gamma", year_angle)
    g = F.col("_gamma")
    equation = (
        F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849
    ) * 229.18
    declination = (
        F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758
        + F.sin(g * 2) * 0.000907 - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    )
    staged = staged.withColumns({"_eq": equation, "_dec": declination})
    hour_angle = F.radians((F.col("_minute") + F.col("_eq") + 4.0 * longitude) / 4.0 - 180.0)
    staged = staged.withColumns(
        {"_cha": F.cos(hour_angle), "_sha": F.sin(hour_angle), "_sd": F.sin("_dec"), "_cd": F.cos("_dec")}
    )
    sin_lat, cos_lat = F.sin(F.radians(F.lit(latitude))), F.cos(F.radians(F.lit(latitude)))
    up = sin_lat * F.col("_sd") + cos_lat * F.col("_cd") * F.col("_cha")
    east = -F.col("_cd") * F.col("_sha")
    north = cos_lat * F.col("_sd") - sin_lat * F.col("_cd") * F.col("_cha")
    staged = staged.withColumns({"solar_elevation_deg": F.degrees(F.asin(up)), "_az": F.degrees(F.atan2(east, north))})
    azimuth = F.when(F.col("_az") < 0, F.col("_az") + 360.0).otherwise(F.col("_az"))
    return staged.withColumn("solar_azimuth_deg", azimuth).drop(
        "_minute", "_gamma", "_eq", "_dec", "_cha", "_sha", "_sd", "_cd", "_az"
    )


def haurwitz_ghi(elevation_deg: Column) -> Column:
    """Clear-sky global irradiance from elevation (Haurwitz 1945), W/m2, 0 at night."""
    cos_zenith = F.sin(F.radians(elevation_deg))
    return F.when(cos_zenith > 0, cos_zenith * 1098.0 * F.exp(F.lit(-0.057) / cos_zenith)).otherwise(0.0)

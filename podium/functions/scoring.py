"""Wind bands, units, handicap scoring and rates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from podium.functions.text import as_col

LOW_MAX_KT, HIGH_MIN_KT = 9.0, 14.0  # fixed values: ends of the middle wind band
KMH_PER_KT = 1.852

COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()

# Weather codes of the public WMO table 4677, as the weather service reports them.
CONDITIONS = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle", 61: "Light rain", 63: "Moderate rain",
    65: "Heavy rain", 71: "Light snow", 73: "Moderate snow", 75: "Heavy snow", 80: "Light rain showers",
    81: "Moderate rain showers", 82: "Heavy rain showers", 95: "Thunderstorm",
}


def wind_band(knots: Column | str) -> Column:
    """low, medium or high; medium when the wind is not known."""
    k = as_col(knots)
    return F.when(k <= LOW_MAX_KT, "low").when(k >= HIGH_MIN_KT, "high").otherwise("medium")


def knots(kmh: Column | str) -> Column:
    return as_col(kmh) / F.lit(KMH_PER_KT)


def speed_kt(distance_nm: Column | str, seconds: Column | str) -> Column:
    return as_col(distance_nm) / (as_col(seconds) / F.lit(3600.0))


def compass(degrees: Column | str) -> Column:
    """Name of the nearest of the 16 points."""
    point = F.pmod(F.floor(as_col(degrees) / F.lit(22.5) + F.lit(0.5)).cast("int"), F.lit(16))
    return F.get(F.array(*[F.lit(p) for p in COMPASS]), point)


def condition(code: Column | str) -> Column:
    c = as_col(code)
    table = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])
    named = F.try_element_at(table, c.cast("int"))
    return F.when(c.isNotNull(), F.coalesce(named, F.concat(F.lit("Code "), c.cast("string"))))


def by_band(band: Column | str, low: Column, medium: Column, high: Column) -> Column:
    b = as_col(band)
    return F.when(b == "low", low).when(b == "high", high).otherwise(medium)


def time_on_time(elapsed: Column | str, factor: Column) -> Column:
    return as_col(elapsed) * factor


def time_on_distance(elapsed: Column | str, distance_nm: Column | str, allowance: Column) -> Column:
    return as_col(elapsed) - as_col(distance_nm) * allowance


def rate3(part: Column | str, whole: Column | str) -> Column:
    """Share to three places; 0 when there is nothing to share."""
    from podium.operators.measures import half_up

    return F.coalesce(half_up(as_col(part), as_col(whole), 3), F.lit(0.0))

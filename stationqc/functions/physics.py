"""Physics of moist air and of the globe, as column expressions.  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_KM


def guarded(value: Column, *inputs: Column) -> Column:
    """``value``, but null where an input is: greatest and least skip nulls."""
    for i in inputs:
        value = F.when(i.isNotNull(), value)
    return value


def sat_vp(t: Column) -> Column:
    """Saturation vapour pressure in hPa (Magnus)."""
    return 6.112 * F.exp(17.67 * t / (t + 243.5))


def vapour_pressure(t: Column, rh: Column) -> Column:
    return rh / 100.0 * sat_vp(t)


def dewpoint(t: Column, rh: Column) -> Column:
    e = F.greatest(vapour_pressure(t, F.greatest(rh, F.lit(0.5))), F.lit(1e-6))
    g = F.ln(e / 6.112)
    return guarded(243.5 * g / (17.67 - g), t, rh)


def rh_from_dew(t: Column, td: Column) -> Column:
    return guarded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * sat_vp(td) / sat_vp(t))), t, td)


def station_pressure(elev: Column) -> Column:
    """Standard-atmosphere pressure in hPa at an elevation in metres."""
    return 1013.25 * F.pow(1 - 2.25577e-5 * elev, F.lit(5.25588))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def fraction_hour(time: Column) -> Column:
    return F.hour(time) + F.minute(time) / 60.0


def hour_of(minute: Column) -> Column:
    """Whole hour of the day of a minute number that counts from a midnight."""
    return F.floor(F.pmod(minute, F.lit(1440)) / 60).cast("int")


def hour_interp(table: Column, minute: Column) -> Column:
    """Circular linear interpolation of a 24-value array at the time of day of ``minute``."""
    h = hour_of(minute)
    a, b = F.get(table, h), F.get(table, (h + 1) % 24)
    return a + (b - a) * (F.pmod(minute, F.lit(60)) / 60.0)


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def median_of(values: Column) -> Column:
    """Median of an array without nulls, in any order; null if it is empty."""
    return once(F.sort_array(values), array_median)


def quantile(value: Column | str, at: float | list[float], exact: bool = True) -> Column:
    """Percentile by linear interpolation, or (``exact`` false) by a sketch whose size doesn't grow with the rows."""
    points = F.array(*map(F.lit, at)) if isinstance(at, list) else F.lit(at)
    return F.percentile(value, points) if exact else F.percentile_approx(value, points, F.lit(10_000))


def array_median(values: Column) -> Column:
    """Median of a sorted array without nulls; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0)

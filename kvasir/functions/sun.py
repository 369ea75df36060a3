"""Sun positions by the closed-form low-precision formulas (about 0.01 degrees between 1950 and 2050); times in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvasir.functions import vectors


def _days(at: Column) -> Column:
    """Days since noon of 1 January 2000."""
    return F.unix_micros(at.cast("timestamp")) / F.lit(86_400_000_000.0) - F.lit(10957.5)


def _ecliptic(d: Column) -> tuple[Column, Column, Column]:
    """Longitude, obliquity, mean longitude in degrees."""
    mean = F.pmod(F.lit(280.460) + F.lit(0.9856474) * d, F.lit(360.0))
    g = F.radians(F.pmod(F.lit(357.528) + F.lit(0.9856003) * d, F.lit(360.0)))
    return mean + F.lit(1.915) * F.sin(g) + F.lit(0.020) * F.sin(2 * g), F.lit(23.439) - F.lit(4e-7) * d, mean


def _hour_angle(longitude: Column, at: Column) -> tuple[Column, Column]:
    """Hour angle and declination, in radians."""
    d = _days(at)
    lam, eps, _ = _ecliptic(d)
    lam, eps = F.radians(lam), F.radians(eps)
    ascension = F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam))
    sidereal = F.radians(F.pmod(F.lit(280.46061837) + F.lit(360.98564736629) * d, F.lit(360.0)) + longitude)
    return sidereal - ascension, F.asin(F.sin(eps) * F.sin(lam))


def altitude(latitude: Column, longitude: Column, at: Column) -> Column:
    """Degrees above the horizon, without refraction."""
    h, dec = _hour_angle(longitude, at)
    lat = F.radians(latitude)
    return F.degrees(F.asin(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(h)))


def azimuth(latitude: Column, longitude: Column, at: Column) -> Column:
    """Degrees clockwise from north."""
    h, dec = _hour_angle(longitude, at)
    lat = F.radians(latitude)
    return F.pmod(F.degrees(F.atan2(-F.sin(h), F.tan(dec) * F.cos(lat) - F.sin(lat) * F.cos(h))) + 360, F.lit(360.0))


def direction(latitude: Column, longitude: Column, at: Column) -> Column:
    """A unit vector to the sun."""
    return vectors.by_azimuth_altitude(azimuth(latitude, longitude, at), altitude(latitude, longitude, at))


def day_length(latitude: Column, at: Column) -> Column:
    """Hours between sunrise and sunset (altitude -0.833 degrees) of the day; 0 or 24 in polar night or day."""
    _, dec = _hour_angle(F.lit(0.0), at)
    lat = F.radians(latitude)
    c = (F.sin(F.radians(F.lit(-0.833))) - F.sin(lat) * F.sin(dec)) / (F.cos(lat) * F.cos(dec))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))) / F.lit(7.5)

"""Position of the sun as column expressions: the low-precision series in Julian centuries since J2000.

Angles are in degrees; instants are seconds since 1970 in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def _unit(x: Column) -> Column:
    """Held to [-1, 1]: rounding may carry a cosine a little outside."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def centuries(seconds: Column) -> Column:
    return (seconds / 86400.0 + F.lit(2440587.5) - 2451545.0) / 36525.0


def elements(t: Column) -> Column:
    """``struct(lon, anomaly, decl, obliquity, ecc)``: mean longitude, mean anomaly, declination, obliquity, eccentricity."""
    lon = F.pmod(F.lit(280.46646) + t * (F.lit(36000.76983) + t * 0.0003032), F.lit(360.0))
    m = F.lit(357.52911) + t * (F.lit(35999.05029) - t * 0.0001537)
    centre = _sin(m) * (F.lit(1.914602) - t * (F.lit(0.004817) + t * 0.000014)) + _sin(m * 2) * (F.lit(0.019993) - t * 0.000101) + _sin(m * 3) * 0.000289
    node = F.lit(125.04) - t * 1934.136
    apparent = lon + centre - 0.00569 - _sin(node) * 0.00478
    seconds = F.lit(21.448) - t * (F.lit(46.815) + t * (F.lit(0.00059) - t * 0.001813))
    tilt = F.lit(23.0) + (F.lit(26.0) + seconds / 60.0) / 60.0 + _cos(node) * 0.00256
    decl = F.degrees(F.asin(_sin(tilt) * _sin(apparent)))
    ecc = F.lit(0.016708634) - t * (F.lit(0.000042037) + t * 0.0000001267)
    return F.struct(lon.alias("lon"), m.alias("anomaly"), decl.alias("decl"), tilt.alias("obliquity"), ecc.alias("ecc"))


def equation_of_time(s: Column) -> Column:
    """Minutes that true solar time runs ahead of mean solar time; ``s`` comes from :func:`elements`."""
    y = F.pow(F.tan(F.radians(s["obliquity"] / 2)), F.lit(2.0))
    e, m, lon = s["ecc"], s["anomaly"], s["lon"]
    total = y * _sin(lon * 2) - e * 2 * _sin(m) + e * y * 4 * _sin(m) * _cos(lon * 2) - y * y * 0.5 * _sin(lon * 4) - e * e * 1.25 * _sin(m * 2)
    return F.degrees(total) * 4


def position(lat: Column, lon: Column, seconds: Column, s: Column) -> Column:
    """``struct(altitude, azimuth)``: degrees above the horizon, and clockwise from north."""
    solar = F.pmod(F.pmod(seconds, F.lit(86400.0)) / 60.0 + equation_of_time(s) + lon * 4, F.lit(1440.0))
    hour = solar / 4 - 180
    up = _unit(_sin(lat) * _sin(s["decl"]) + _cos(lat) * _cos(s["decl"]) * _cos(hour))
    zenith = F.degrees(F.acos(up))
    side = _cos(lat) * _sin(zenith)
    raw = F.degrees(F.acos(_unit((_sin(lat) * _cos(zenith) - _sin(s["decl"])) / side)))
    turned = F.when(hour > 0, F.pmod(raw + 180, F.lit(360.0))).otherwise(F.pmod(F.lit(540.0) - raw, F.lit(360.0)))
    azimuth = F.when(F.abs(side) > 1e-9, turned).otherwise(F.when(lat > 0, 180.0).otherwise(0.0))
    return F.struct((F.lit(90.0) - zenith).alias("altitude"), azimuth.alias("azimuth"))


def day_length(lat: Column, decl: Column) -> Column:
    """``struct(hours, rise, set, polar)`` in solar hours; rise and set are null on polar days and nights."""
    c = (F.lit(-0.014537808) - _sin(lat) * _sin(decl)) / (_cos(lat) * _cos(decl))
    polar = F.when(c <= -1, "day").when(c >= 1, "night")
    half = F.when(polar.isNull(), F.degrees(F.acos(_unit(c))) / 15)
    hours = F.when(polar == "day", 24.0).when(polar == "night", 0.0).otherwise(half * 2)
    return F.struct(hours.alias("hours"), (F.lit(12.0) - half).alias("rise"), (half + 12).alias("set"), polar.alias("polar"))


def day_altitudes(lat: Column, decl: Column, step_min: int = 15) -> Column:
    """``array<struct<h, altitude>>`` through a day, both midnights included."""

    def at(minute: Column) -> Column:
        h = minute / 60.0
        up = _sin(lat) * _sin(decl) + _cos(lat) * _cos(decl) * _cos((h - 12) * 15)
        return F.struct(h.alias("h"), F.degrees(F.asin(_unit(up))).alias("altitude"))

    return F.transform(F.sequence(F.lit(0), F.lit(1440), F.lit(step_min)), at)

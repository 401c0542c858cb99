"""Sun and moon by low-precision series, as Column expressions. Days are UTC dates, hours decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _col
from .numbers import julian_day, phase_name


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def _sun(day, lon, hour) -> tuple[Column, Column]:
    """Hour angle and declination in radians. The almanac's low-precision solar coordinates."""
    d = julian_day(day) - 2451545 - 0.5 + _col(hour) / 24
    g = 357.529 + 0.98560028 * d
    ecl = 280.459 + 0.98564736 * d + 1.915 * _sin(g) + 0.020 * _sin(2 * g)
    tilt = 23.439 - 0.00000036 * d
    ra = F.atan2(_cos(tilt) * _sin(ecl), _cos(ecl))
    dec = F.asin(_sin(tilt) * _sin(ecl))
    sidereal = (18.697374558 + 24.06570982441908 * d) % 24
    return F.radians((sidereal + _col(lon) / 15) * 15) - ra, dec


def sun_elevation(day, lat, lon, hour) -> Column:
    h, dec = _sun(day, lon, hour)
    return F.degrees(F.asin(_sin(_col(lat)) * F.sin(dec) + _cos(_col(lat)) * F.cos(dec) * F.cos(h)))


def sun_azimuth(day, lat, lon, hour) -> Column:
    """From north, clockwise, 0 to 360."""
    h, dec = _sun(day, lon, hour)
    return (F.degrees(F.atan2(F.sin(h), F.cos(h) * _sin(_col(lat)) - F.tan(dec) * _cos(_col(lat)))) + 180) % 360


def solunar(day, lon, offset_hours) -> Column:
    """struct<major1,major2,minor1,minor2 (local decimal hours), illumination (percent), phase (degrees), name>. Remainders keep the dividend's sign, as the series were fitted."""
    d = julian_day(day) - 2451545
    mean, anomaly, node = (218.316 + 13.176396 * d) % 360, (134.963 + 13.064993 * d) % 360, (93.272 + 13.229350 * d) % 360
    moon = mean + 6.289 * _sin(anomaly) - 1.274 * _sin(2 * node - anomaly) + 0.658 * _sin(2 * node)
    ra = F.degrees(F.atan2(_cos(F.lit(23.439)) * _sin(moon), _cos(moon)))
    angle = ((280.46061837 + 360.98564736629 * d) % 360 + _col(lon) - ra + 360) % 360
    major = ((12 - angle / 15 + 24) % 24 + _col(offset_hours) + 48) % 24
    sun_anomaly = (357.528 + 0.9856003 * d) % 360
    sun = (280.460 + 0.9856474 * d) % 360 + 1.915 * _sin(sun_anomaly) + 0.020 * _sin(2 * sun_anomaly)
    phase = (moon - sun + 1080) % 360
    return F.struct(
        major.alias("major1"), ((major + 12) % 24).alias("major2"), ((major + 6) % 24).alias("minor1"), ((major + 18) % 24).alias("minor2"),
        F.floor((1 - _cos(phase)) / 2 * 100 + 0.5).cast("int").alias("illumination"), phase.alias("phase"), phase_name(phase).alias("name"),
    )


# The motor's reference draw.
AMPS_AT, REFERENCE_MPH, DRAW_POWER, METRES_PER_MILE = 5.0, 2.0, 1.756, 1609.34


def _speed(mph) -> Column:
    return F.greatest(F.lit(0.1), F.coalesce(_col(mph).cast("double"), F.lit(0.0)))


def amps(mph) -> Column:
    return AMPS_AT * F.pow(_speed(mph) / REFERENCE_MPH, F.lit(DRAW_POWER))


def amp_hours(metres, mph) -> Column:
    return amps(mph) * (_col(metres) / METRES_PER_MILE) / _speed(mph)


def minutes_for(metres, mph) -> Column:
    return _col(metres) / METRES_PER_MILE / _speed(mph) * 60

"""Frames and look angles for orbits, as Column expressions. Times are microseconds since 1970, UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84, metres.
A = 6_378_137.0
E2 = 6.69437999014e-3
B = A * math.sqrt(1 - E2)
EP2 = E2 / (1 - E2)
UNIX_EPOCH_JD = 2_440_587.5
#: Earth's gravitation (km3/s2), radius (km) and oblateness, WGS-72, for the secular propagator.
MU, RADIUS_KM, J2 = 398_600.8, 6_378.135, 1.082616e-3


def julian_date(micros: Column) -> Column:
    return micros / 86_400e6 + UNIX_EPOCH_JD


def gmst(micros: Column) -> Column:
    """Greenwich mean sidereal time, radians in [0, 2 pi), by the 1982 polynomial."""
    t = (julian_date(micros) - 2_451_545.0) / 36_525
    seconds = 67_310.54841 + t * (876_600 * 3600.0 + 8_640_184.812866) + t * t * 0.093104 - t * t * t * 6.2e-6
    return F.pmod(F.radians(seconds / 240), F.lit(2 * math.pi))


def teme_to_ecef(x: Column, y: Column, z: Column, micros: Column) -> Column:
    """(x, y, z) turned about the axis by sidereal time."""
    angle = gmst(micros)
    return F.struct((F.cos(angle) * x + F.sin(angle) * y).alias("x"), (F.cos(angle) * y - F.sin(angle) * x).alias("y"), z.alias("z"))


def geodetic_to_ecef(lat: Column, lon: Column, alt_m: Column) -> Column:
    """Metres."""
    lat, lon = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.struct(((n + alt_m) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + alt_m) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - E2) + alt_m) * F.sin(lat)).alias("z"))


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> Column:
    """(lat, lon, alt_m) by Bowring's closed form; on the axis, the pole."""
    p = F.hypot(x, y)
    theta = F.atan2(z * A, p * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(theta), F.lit(3)), p - E2 * A * F.pow(F.cos(theta), F.lit(3)))
    alt = p / F.cos(lat) - F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    axis = p < 1e-9
    pole = F.when(z < 0, F.lit(-90.0)).otherwise(F.lit(90.0))
    return F.struct(F.when(axis, pole).otherwise(F.degrees(lat)).alias("lat"), F.when(axis, F.lit(0.0)).otherwise(F.degrees(F.atan2(y, x))).alias("lon"), F.when(axis, F.abs(z) - B).otherwise(alt).alias("alt_m"))


def look_angles(x: Column, y: Column, z: Column, lat: Column, lon: Column, alt_m: Column) -> Column:
    """(azimuth, elevation, range_m) from an observer to an Earth-fixed point in metres."""
    here = geodetic_to_ecef(lat, lon, alt_m)
    rx, ry, rz = x - here["x"], y - here["y"], z - here["z"]
    lat, lon = F.radians(lat), F.radians(lon)
    south = F.sin(lat) * F.cos(lon) * rx + F.sin(lat) * F.sin(lon) * ry - F.cos(lat) * rz
    east = F.cos(lon) * ry - F.sin(lon) * rx
    zenith = F.cos(lat) * F.cos(lon) * rx + F.cos(lat) * F.sin(lon) * ry + F.sin(lat) * rz
    far = F.sqrt(rx * rx + ry * ry + rz * rz)
    up = F.when(far > 0, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), zenith / far))))).otherwise(F.lit(0.0))
    return F.struct(F.pmod(F.degrees(F.atan2(east, -south)), F.lit(360.0)).alias("azimuth"), up.alias("elevation"), far.alias("range_m"))


def propagate(mean_motion: Column, eccentricity: Column, inclination: Column, node: Column, perigee: Column, anomaly: Column, minutes: Column, newton: int = 6) -> Column:
    """(x, y, z) in km, true equator and mean equinox, `minutes` after the elements' epoch (degrees; revolutions a day).

    Keplerian motion with the secular drift that the Earth's oblateness gives to node, perigee and anomaly; no drag and no
    periodic terms, so it leaves the full analytical model by some kilometres a day. Null where the elements give no closed orbit."""
    n = mean_motion * (2 * math.pi / 1440)
    a = F.pow(F.lit(MU * 3600) / (n * n), F.lit(1 / 3))
    i, p = F.radians(inclination), a * (1 - eccentricity * eccentricity)
    drift = n * (1.5 * J2 * RADIUS_KM**2) / (p * p)
    cos_i = F.cos(i)
    omega = F.radians(perigee) + drift * (2 - 2.5 * F.sin(i) * F.sin(i)) * minutes
    raan = F.radians(node) - drift * cos_i * minutes
    mean = F.pmod(F.radians(anomaly) + (n + drift * F.sqrt(1 - eccentricity * eccentricity) * (1 - 1.5 * F.sin(i) * F.sin(i))) * minutes, F.lit(2 * math.pi))
    e = F.aggregate(F.array_repeat(F.lit(0), newton), mean, lambda e, _: e - (e - eccentricity * F.sin(e) - mean) / (1 - eccentricity * F.cos(e)))
    far = a * (1 - eccentricity * F.cos(e))
    u = omega + F.atan2(F.sqrt(1 - eccentricity * eccentricity) * F.sin(e), F.cos(e) - eccentricity)
    xyz = F.struct(
        (far * (F.cos(u) * F.cos(raan) - F.sin(u) * cos_i * F.sin(raan))).alias("x"),
        (far * (F.cos(u) * F.sin(raan) + F.sin(u) * cos_i * F.cos(raan))).alias("y"),
        (far * F.sin(u) * F.sin(i)).alias("z"))
    return F.when((mean_motion > 0) & (eccentricity >= 0) & (eccentricity < 1) & (p > 0), xyz)

"""UTM to longitude and latitude on the WGS 84 ellipsoid, by the series of the inverse transverse Mercator."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid and the projection's constants.
RADIUS, ECCENTRICITY2, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 0.00669437999014, 0.9996, 500000.0, 10000000.0


def lon_lat(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    e2 = ECCENTRICITY2
    ep2 = e2 / (1 - e2)
    e1 = (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2))
    mu = (y - (0.0 if north else FALSE_NORTHING)) / SCALE / (RADIUS * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s, c, t = F.sin(foot), F.cos(foot), F.tan(foot)
    bend = 1 - e2 * s * s
    n, r = RADIUS / F.sqrt(bend), RADIUS * (1 - e2) / (bend * F.sqrt(bend))
    t1, c1 = t * t, ep2 * c * c
    d = (x - FALSE_EASTING) / (n * SCALE)
    d2 = d * d
    lat = foot - (n * t / r) * (d2 / 2 - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - 252 * ep2 - 3 * c1 * c1) * d2 * d2 * d2 / 720)
    lon = (d - (1 + 2 * t1 + c1) * d * d2 / 6 + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + 8 * ep2 + 24 * t1 * t1) * d * d2 * d2 / 120) / c
    return F.degrees(lon) + (6 * zone - 183), F.degrees(lat)

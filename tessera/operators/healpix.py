"""HEALPix nested cells of points on the sphere, as Column expressions (no Python on the executors).

The published scheme: twelve base faces, each divided into nside x nside cells numbered by interleaving the bits of the
position in the face.  Coordinates are spherical degrees; ellipsoidal latitudes can be mapped to authalic ones first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.binning import clean

MAX_DEPTH = 29
#: Fixed value: squared eccentricity of WGS84.
WGS84_E2 = 0.0066943799901413165


def authalic_latitude(lat: Column, e2: float = WGS84_E2) -> Column:
    """Latitude (degrees) on the sphere of equal area, from the geodetic latitude on an ellipsoid."""
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    pole = (1 - e2) * (1 / (1 - e2) - math.log((1 - e) / (1 + e)) / (2 * e))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q_of(F.sin(F.radians(lat))) / pole))))


def _spread(x: Column) -> Column:
    """The bits of a number at the even places: its binary digits read in base 4."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def nested_cell(lon: Column, lat: Column, depth: int) -> Column:
    """Nested cell id of a point in degrees; null where a coordinate is missing."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth {depth} is not in 0..{MAX_DEPTH}")
    nside = 1 << depth
    z = F.sin(F.radians(lat))
    turn = F.pmod(lon / 90.0, F.lit(4.0))
    quarter = F.least(F.floor(turn), F.lit(3)).cast("long")
    # Equatorial belt: two families of diagonals.
    a, b = nside * (0.5 + turn), nside * (z * 0.75)
    up, down = F.floor(a - b).cast("long"), F.floor(a + b).cast("long")
    face_up, face_down = F.floor(up / nside).cast("long"), F.floor(down / nside).cast("long")
    belt_face = F.when(face_up == face_down, face_up.bitwiseAND(F.lit(3)) + 4).when(face_up < face_down, face_up.bitwiseAND(F.lit(3))).otherwise(face_down.bitwiseAND(F.lit(3)) + 8)
    belt_x, belt_y = F.pmod(down, F.lit(nside)), nside - F.pmod(up, F.lit(nside)) - 1
    # Polar caps: distance from the pole, scaled to the face's edge.
    part = turn - quarter
    reach = nside * F.cos(F.radians(lat)) * F.sqrt(3.0 / (1.0 + F.abs(z)))
    p, q = (F.least(F.floor(part * reach), F.lit(nside - 1)).cast("long"), F.least(F.floor((1.0 - part) * reach), F.lit(nside - 1)).cast("long"))
    polar_face = F.when(z >= 0, quarter).otherwise(quarter + 8)
    polar_x, polar_y = F.when(z >= 0, nside - 1 - q).otherwise(p), F.when(z >= 0, nside - 1 - p).otherwise(q)
    belt = F.abs(z) <= 2.0 / 3.0
    face, x, y = (F.when(belt, b).otherwise(c) for b, c in ((belt_face, polar_face), (belt_x, polar_x), (belt_y, polar_y)))
    cell = face * (1 << 2 * depth) + _spread(x) + F.shiftleft(_spread(y), 1)
    return F.when(lon.isNotNull() & lat.isNotNull(), cell)


def with_cells(samples: DataFrame, depth: int, lat: str = "lat", lon: str = "lon", ellipsoid: str = "sphere", cell: str = "cell") -> DataFrame:
    """Adds the cell of each sample; samples without coordinates go."""
    if ellipsoid not in ("sphere", "WGS84"):
        raise ValueError(f"unknown ellipsoid {ellipsoid!r}")
    y, x = clean(F.col(lat)), clean(F.col(lon))
    y = authalic_latitude(y) if ellipsoid == "WGS84" else y
    return samples.withColumn(cell, nested_cell(x, y, depth)).where(F.col(cell).isNotNull())


def cells_in_box(spark, lon_min: float, lat_min: float, lon_max: float, lat_max: float, depth: int, step: float | None = None) -> DataFrame:
    """Distinct cells that a mesh over the box meets, in order; the mesh is half a cell wide by default."""
    step = step or math.degrees(math.sqrt(4 * math.pi / (12 * 4**depth))) / 2
    count = lambda low, high: int(math.floor((high - low) / step)) + 2
    n_lat, n_lon = count(lat_min, lat_max), count(lon_min, lon_max)
    mesh = spark.range(n_lat * n_lon).select(F.least(F.lit(lat_max), F.lit(lat_min) + F.floor(F.col("id") / n_lon) * step).alias("lat"), F.least(F.lit(lon_max), F.lit(lon_min) + F.col("id") % n_lon * step).alias("lon"))
    return with_cells(mesh, depth).select("cell").distinct().orderBy("cell")

"""Points stored along a Z-order curve, so that a search near a place or a line reads few files.

A place's number interleaves the bits of its latitude and longitude. Files hold ranges of numbers, a search turns its
boxes into a few ranges, and the bounds that Parquet keeps of every file and row group rule out the rest. The exact test
comes last, so rows are those of an unclustered search.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.functions import geo
from midmile.operators import spatial

BITS = 16  # of a coordinate
RANGES = 48  # of a search, about
PIECE_M = 20_000.0  # a line is covered by boxes around pieces of this length
_SPAN = 1 << BITS

Box = tuple[float, float, float, float]  # least and greatest latitude, least and greatest longitude


def _spread(c: Column) -> Column:
    """The bits of a number with a zero after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def _step(value: Column, low: float, width: float) -> Column:
    at = F.floor((value - low) / width * _SPAN)
    return F.least(F.greatest(at, F.lit(0)), F.lit(_SPAN - 1)).cast("long")


def curve(lat: Column, lon: Column) -> Column:
    """The number of a place; null without one of its coordinates. Longitudes are from -180 to 180."""
    number = F.shiftleft(_spread(_step(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_step(lon, -180.0, 360.0)))
    return F.when(lat.isNotNull() & lon.isNotNull(), number)


def write(points: DataFrame, path: str, files: int, lat: str = "latitude", lon: str = "longitude") -> None:
    """Store ``points`` in about ``files`` files along the curve; points without a place come first, in files that no search reads."""
    placed = points.withColumn("_curve", curve(F.col(lat), F.col(lon)))
    placed.repartitionByRange(files, "_curve").sortWithinPartitions("_curve").write.parquet(path)


def ranges(boxes: Sequence[Box], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of numbers that cover some boxes: squares are quartered, the largest first, while there are fewer than ``most``."""
    grid = []
    for lat0, lat1, lon0, lon1 in boxes:
        for west, east in ((lon0, lon1), (lon0 + 360, lon1 + 360), (lon0 - 360, lon1 - 360)):  # across the date line
            if east >= -180 and west <= 180:
                at = lambda v, low, width: min(max(math.floor((v - low) / width * _SPAN), 0), _SPAN - 1)
                grid.append((at(lat0, -90, 180), at(lat1, -90, 180), at(west, -180, 360), at(east, -180, 360)))
    meets = lambda y, x, n: [(a <= y and b >= y + n - 1 and c <= x and d >= x + n - 1) for a, b, c, d in grid if a < y + n and b >= y and c < x + n and d >= x]
    whole, cut = [], [(_SPAN, 0, 0, 0)] if grid else []
    while cut:
        cut.sort()
        size, z, y, x = cut.pop()
        half = size // 2
        for k, (dy, dx) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
            met = meets(y + dy, x + dx, half)
            if met:
                (whole if half == 1 or any(met) else cut).append((half, z + k * half * half, y + dy, x + dx))
        if len(whole) + len(cut) >= most:
            break
    found: list[tuple[int, int]] = []
    for lo, hi in sorted((z, z + size * size - 1) for size, z, _, _ in whole + cut):
        if found and found[-1][1] + 1 == lo:
            found[-1] = (found[-1][0], hi)
        else:
            found.append((lo, hi))
    return found


def around(lat: float, lon: float, metres: float) -> Box:
    """The box around a circle; near a pole all longitudes."""
    angle = metres / geo.EARTH_M
    south, north = lat - math.degrees(angle), lat + math.degrees(angle)
    if south <= -90 or north >= 90:
        return max(south, -90.0), min(north, 90.0), -180.0, 180.0
    wide = math.degrees(math.asin(min(1.0, math.sin(min(angle, math.pi / 2)) / math.cos(math.radians(lat)))))
    return south, north, lon - wide, lon + wide


def along(route: Sequence[tuple[float, float]], metres: float) -> list[Box]:
    """Boxes around the pieces of a line of (lat, lon)."""
    vector = lambda p: (math.cos(a := math.radians(p[0])) * math.cos(b := math.radians(p[1])), math.cos(a) * math.sin(b), math.sin(a))
    boxes = []
    for p, q in list(zip(route, route[1:], strict=False)) or [(route[0], route[0])]:
        a, b = vector(p), vector(q)
        theta = math.atan2(math.hypot(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]), sum(x * y for x, y in zip(a, b, strict=True)))
        n = max(1, math.ceil(theta * geo.EARTH_M / PIECE_M))
        for k in range(n):
            t = (k + 0.5) / n
            u, w = (1 - t, t) if theta < 1e-9 else (math.sin((1 - t) * theta) / math.sin(theta), math.sin(t * theta) / math.sin(theta))
            x, y, z = (u * i + w * j for i, j in zip(a, b, strict=True))
            boxes.append(around(math.degrees(math.atan2(z, math.hypot(x, y))), math.degrees(math.atan2(y, x)), metres + theta * geo.EARTH_M / n / 2 + 1))
    return boxes


def read(spark: SparkSession, path: str, boxes: Sequence[Box]) -> DataFrame:
    """Stored points in or near the boxes: a filter on the curve that Parquet's bounds answer."""
    found = ranges(boxes)
    if not found:
        return spark.read.parquet(path).where(F.lit(False)).drop("_curve")
    inside = reduce(Column.__or__, [F.col("_curve").between(lo, hi) for lo, hi in found])
    return spark.read.parquet(path).where(inside)


def within_radius(spark: SparkSession, path: str, lat: float, lon: float, metres: float, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """The rows of ``spatial.within_radius`` over the stored points."""
    near = read(spark, path, [around(lat, lon, metres + 1)])
    return spatial.within_radius(near, lat, lon, metres, lat_col, lon_col).drop("_curve")


def meets_route(spark: SparkSession, path: str, route: Sequence[tuple[float, float]], corridor_m: float, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Stored points within ``corridor_m`` of a line."""
    near = read(spark, path, along(route, corridor_m))
    return near.where(spatial.meets_route(near, list(route), corridor_m, lat_col, lon_col)).drop("_curve")

"""Spherical geometry on plain latitude/longitude columns.

All lengths are metres on a sphere of the earth's mean radius; segments are great
circles. The grid has bands of equal latitude height whose number of cells shrinks
with the cosine of the latitude, so a cell is nowhere narrower than its height.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
MILE_M = 1609.344


def unit_vector(lat: Column, lon: Column) -> Column:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.struct(
        (F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"), F.sin(phi).alias("z")
    )


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def arc(a: Column, b: Column) -> Column:
    """Angle between unit vectors, from their chord: exact for close points too."""
    dx, dy, dz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(dx * dx + dy * dy + dz * dz) / 2))


def distance_m(a: Column, b: Column) -> Column:
    """Great-circle distance of two unit vectors."""
    return arc(a, b) * EARTH_M


def point_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return distance_m(unit_vector(lat1, lon1), unit_vector(lat2, lon2))


def segment_distance_m(p: Column, a: Column, b: Column) -> Column:
    """Distance of unit vector ``p`` to the great-circle segment ``a``-``b``."""
    cos_ab, cos_pa, cos_pb = _dot(a, b), _dot(p, a), _dot(p, b)
    nx = a["y"] * b["z"] - a["z"] * b["y"]
    ny = a["z"] * b["x"] - a["x"] * b["z"]
    nz = a["x"] * b["y"] - a["y"] * b["x"]
    n = F.sqrt(nx * nx + ny * ny + nz * nz)
    across = F.abs(p["x"] * nx + p["y"] * ny + p["z"] * nz)
    beside = (n > 0) & (cos_pb >= cos_pa * cos_ab) & (cos_pa >= cos_pb * cos_ab)
    ends = F.least(distance_m(p, a), distance_m(p, b))
    return F.when(beside, F.asin(F.least(F.lit(1.0), F.try_divide(across, n))) * EARTH_M).otherwise(ends)


# A join tests very many pairs of a leg and a point. What depends on one side only is kept
# as plain columns, so that a test is a few products and the compiled loop stays small.


def leg_columns(a: Column, b: Column) -> list[Column]:
    """Ends of a leg, its unit normal, and the directions that bound the points beside it."""
    cos_ab = _dot(a, b)
    normal = {
        "x": a["y"] * b["z"] - a["z"] * b["y"],
        "y": a["z"] * b["x"] - a["x"] * b["z"],
        "z": a["x"] * b["y"] - a["y"] * b["x"],
    }
    size = F.sqrt(sum((n * n for n in normal.values()), F.lit(0.0)))
    out = []
    for k in "xyz":
        out += [
            a[k].alias(f"_a{k}"),
            b[k].alias(f"_b{k}"),
            F.when(size > 0, F.try_divide(normal[k], size)).alias(f"_m{k}"),  # NULL for a leg of no length
            (b[k] - cos_ab * a[k]).alias(f"_u{k}"),
            (a[k] - cos_ab * b[k]).alias(f"_w{k}"),
        ]
    return out


def point_columns(lat: Column, lon: Column) -> dict[str, Column]:
    v = unit_vector(lat, lon)
    return {f"_p{k}": v[k] for k in "xyz"}


def _times(name: str) -> Column:
    """Product of the point with one of the leg's vectors."""
    return sum((F.col(f"_p{k}") * F.col(f"_{name}{k}") for k in "yz"), F.col("_px") * F.col(f"_{name}x"))


def _chord2(end: str) -> Column:
    """Squared straight distance of the point to an end of the leg."""
    step = lambda k: F.col(f"_p{k}") - F.col(f"_{end}{k}")
    return step("x") * step("x") + step("y") * step("y") + step("z") * step("z")


def _beside() -> Column:
    return F.col("_mx").isNotNull() & (_times("u") >= 0) & (_times("w") >= 0)


def leg_within(metres: float) -> Column:
    """Whether point and leg are within ``metres``, without any trigonometry."""
    angle = min(metres / EARTH_M, math.pi)
    across = F.abs(_times("m")) <= (math.sin(angle) if angle < math.pi / 2 else 1.0)
    ends = F.least(_chord2("a"), _chord2("b")) <= (2 * math.sin(angle / 2)) ** 2
    return F.when(_beside(), across).otherwise(ends)


def leg_distance_m() -> Column:
    ends = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(F.least(_chord2("a"), _chord2("b"))) / 2))
    return F.when(_beside(), F.asin(F.least(F.lit(1.0), F.abs(_times("m"))))).otherwise(ends) * EARTH_M


def degrees_of(metres: float) -> float:
    return math.degrees(metres / EARTH_M)


def _band(lat: Column, cell_m: float) -> Column:
    return F.floor((lat + 90) / degrees_of(cell_m)).cast("int")


def _band_cells(band: Column, cell_m: float) -> Column:
    """Cells in a band, at least 1, each at least ``cell_m`` wide all over the band."""
    size = degrees_of(cell_m)
    edge = F.greatest(F.abs(band * size - 90), F.abs((band + 1) * size - 90))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / size)).cast("int")


def _step(lon: Column, n: Column) -> Column:
    return F.floor((lon + 180) / 360 * n).cast("int")


def _cell_id(band: Column, step: Column) -> Column:
    return band.cast("bigint") * F.lit(1 << 32) + step.cast("bigint")


def cell_of(lat: Column, lon: Column, cell_m: float) -> Column:
    """Grid cell of a point."""
    band = _band(lat, cell_m)
    n = _band_cells(band, cell_m)
    return _cell_id(band, F.pmod(_step(lon, n), n))


def cells_within(centres: Column, radius_m: float, cell_m: float) -> Column:
    """Cells that circles round the ``centres`` (array of lat, lon) touch, without repeats.

    The steps are separate transforms: each names its values for the next, which keeps
    the expression small.
    """
    arc = (radius_m + 0.01) / EARTH_M  # a centimetre over, for rounding
    d = math.degrees(arc)
    half = lambda lat: F.when((lat + d >= 90) | (lat - d <= -90), F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(arc) / F.cos(F.radians(lat)))))
    )
    circles = F.transform(
        centres,
        lambda c: F.struct(
            F.sequence(
                _band(F.greatest(c["lat"] - d, F.lit(-90.0)), cell_m), _band(F.least(c["lat"] + d, F.lit(90.0)), cell_m)
            ).alias("bands"),
            c["lon"].alias("lon"),
            half(c["lat"]).alias("half"),
        ),
    )
    strips = F.flatten(
        F.transform(
            circles,
            lambda c: F.transform(
                c["bands"],
                lambda band: F.struct(
                    band.alias("band"), _band_cells(band, cell_m).alias("n"), c["lon"].alias("lon"), c["half"].alias("half")
                ),
            ),
        )
    )
    runs = F.transform(
        strips,
        lambda s: F.struct(
            s["band"].alias("band"),
            s["n"].alias("n"),
            _step(s["lon"] - s["half"], s["n"]).alias("first"),
            _step(s["lon"] + s["half"], s["n"]).alias("last"),
        ),
    )
    ids = F.transform(
        runs,
        lambda r: F.transform(
            F.sequence(r["first"], F.least(r["last"], r["first"] + r["n"] - 1)),
            lambda i: _cell_id(r["band"], F.pmod(i, r["n"])),
        ),
    )
    return F.array_distinct(F.flatten(ids))


def piece_centres(a: Column, b: Column, theta: Column, n: Column) -> Column:
    """Middles of ``n`` equal pieces of the great circle ``a``-``b`` of angle ``theta``, as (lat, lon)."""
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i + 0.5) / n)
    # weights of the two ends; 1-t and t when the ends coincide
    weighted = F.transform(
        parts,
        lambda t: F.when(
            theta > 1e-12,
            F.struct(
                F.try_divide(F.sin((1 - t) * theta), F.sin(theta)).alias("u"),
                F.try_divide(F.sin(t * theta), F.sin(theta)).alias("v"),
            ),
        ).otherwise(F.struct((1 - t).alias("u"), t.alias("v"))),
    )
    vectors = F.transform(
        weighted, lambda w: F.struct(*[(w["u"] * a[k] + w["v"] * b[k]).alias(k) for k in "xyz"])
    )
    return F.transform(
        vectors,
        lambda p: F.struct(
            F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))).alias("lat"),
            F.degrees(F.atan2(p["y"], p["x"])).alias("lon"),
        ),
    )


def parse_linestring(wkt: Column) -> Column:
    """``LINESTRING(lon lat, ...)`` as ``array<struct<lat,lon>>``; NULL when malformed."""
    body = F.regexp_extract(wkt, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    points = F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(
            F.get(F.split(F.trim(p), r"\s+"), 1).try_cast("double").alias("lat"),
            F.get(F.split(F.trim(p), r"\s+"), 0).try_cast("double").alias("lon"),
        ),
    )
    good = F.forall(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.when(good, points)

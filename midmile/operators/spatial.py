"""Joins between route lines and points on the map."""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from midmile.functions import geo
from midmile.operators.ranking import balanced_join
from midmile.runtime import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package


def with_route_points(routes: DataFrame) -> DataFrame:
    """Routes given by two ends (lat1, lon1, lat2, lon2) as routes with a ``points`` array."""
    end = lambda i: F.struct(F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon"))
    return routes.withColumn("points", F.array(end(1), end(2)))


def segments(routes: DataFrame, route_id: str = "route_id") -> DataFrame:
    """One row per leg of every route; a single point is a leg of length zero."""
    n = F.size("points")
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).when(n == 1, F.array(F.lit(0)))
    at = lambda i: F.get(F.col("points"), i)
    legs = routes.where(F.col("points").isNotNull()).select(
        route_id, "points", F.explode(steps).alias("leg")
    )
    a, b = at(F.col("leg")), F.coalesce(at(F.col("leg") + 1), at(F.col("leg")))
    return legs.select(
        route_id, "leg",
        a["lat"].alias("a_lat"), a["lon"].alias("a_lon"), b["lat"].alias("b_lat"), b["lon"].alias("b_lon"),
    )


def _with_cells(legs: DataFrame, reach_m: float, piece_m: float, cell_m: float) -> DataFrame:
    """Each leg once under every grid cell within ``reach_m`` of it.

    A leg is cut into pieces of at most ``piece_m``. Every point of a piece is within
    half a piece of its middle, so the circle of radius reach + piece/2 round the middle
    covers all that lies within reach of the piece.
    """
    ends = legs.select(
        *[c for c in legs.columns if c not in ("a_lat", "a_lon", "b_lat", "b_lon")],
        geo.unit_vector(F.col("a_lat"), F.col("a_lon")).alias("_a"),
        geo.unit_vector(F.col("b_lat"), F.col("b_lon")).alias("_b"),
    )
    sized = ends.withColumn("_theta", geo.arc(F.col("_a"), F.col("_b"))).withColumn(
        "_n", F.greatest(F.lit(1), F.ceil(F.col("_theta") * geo.EARTH_M / piece_m)).cast("int")
    )
    centres = geo.piece_centres(F.col("_a"), F.col("_b"), F.col("_theta"), F.col("_n"))
    cells = geo.cells_within(centres, reach_m + piece_m / 2, cell_m)
    located = sized.select("*", *geo.leg_columns(F.col("_a"), F.col("_b")), F.explode(cells).alias("_cell"))
    return located.drop("_theta", "_n", "_a", "_b")


def corridor_join(
    routes: DataFrame,
    points: DataFrame,
    corridor_m: float,
    point_id: str = "bridge_id",
    route_id: str = "route_id",
    lat: str = "latitude",
    lon: str = "longitude",
    piece_m: float = 2000.0,
) -> DataFrame:
    """Every (route, point) within ``corridor_m`` of each other, with the distance.

    Points keep all their columns; ``point_id`` must be unique. Both sides meet on
    grid cells, so only neighbours are tested; the exact distance to the great circle
    decides. A route is listed under each cell once per leg, and a pair found on
    several legs keeps its shortest distance.
    """
    hits = _leg_hits(routes, points, corridor_m, route_id, lat, lon, piece_m).withColumn("distance_m", geo.leg_distance_m())
    kept = [c for c in points.columns if c != point_id]
    return hits.groupBy(route_id, point_id).agg(
        F.min("distance_m").alias("distance_m"), *[F.any_value(c).alias(c) for c in kept]
    )


def _leg_hits(routes: DataFrame, points: DataFrame, corridor_m: float, route_id: str, lat: str, lon: str, piece_m: float = 2000.0) -> DataFrame:
    """Every (leg, point) within ``corridor_m``, once, with the columns of both."""
    if corridor_m <= 0:
        raise ValueError("corridor_m must be positive: a surveyed point never lies exactly on a line")
    piece_m = max(piece_m, corridor_m)
    cell_m = piece_m + 2 * corridor_m
    legs = _with_cells(segments(routes, route_id), corridor_m, piece_m, cell_m)
    placed = (
        points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .withColumn("_cell", geo.cell_of(F.col(lat), F.col(lon), cell_m))
        .withColumns(geo.point_columns(F.col(lat), F.col(lon)))
    )
    return balanced_join(legs, placed, "_cell").where(geo.leg_within(corridor_m))


def within_radius(df: DataFrame, lat: float, lon: float, metres: float, lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Rows within ``metres`` of a place; a latitude band goes first, as it can be pushed down."""
    band = geo.degrees_of(metres)
    away = geo.point_distance_m(F.col(lat_col), F.col(lon_col), F.lit(lat), F.lit(lon))
    return (
        df.where(F.col(lat_col).between(lat - band, lat + band))
        .withColumn("distance_m", away)
        .where(F.col("distance_m") <= metres)
    )


def meets_route(points: DataFrame, route: list[tuple[float, float]], corridor_m: float, lat: str = "latitude", lon: str = "longitude") -> Column:
    """Predicate: a row's point lies within ``corridor_m`` of one given line of (lat, lon)."""
    p = geo.unit_vector(F.col(lat), F.col(lon))
    ends = list(zip(route, route[1:])) or [(route[0], route[0])]
    out = F.lit(False)
    for (a_lat, a_lon), (b_lat, b_lon) in ends:
        a = geo.unit_vector(F.lit(a_lat), F.lit(a_lon))
        b = geo.unit_vector(F.lit(b_lat), F.lit(b_lon))
        out = out | (geo.segment_distance_m(p, a, b) <= corridor_m)
    return out


def _once(df: DataFrame, ids: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ids that come once, and the others, if any."""
    more = stage(ids.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_id")), name)
    if more.isEmpty():
        return df, None
    once = df.where(F.col(key).isNotNull()).join(more, F.col(key) == F.col("_id"), "left_anti")
    return once, df.join(more, F.col(key).eqNullSafe(F.col("_id")), "left_semi")


def corridor_pairs(routes: DataFrame, points: DataFrame, corridor_m: float, point_id: str = "bridge_id", route_id: str = "route_id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The pairs ``route_id, point_id`` of `corridor_join` alone, each once; ids may repeat.

    A route of one leg meets a point of one row once, so these pairs are never moved.
    """
    points = points.select(point_id, lat, lon)
    plain, legged = _once(routes, segments(routes, route_id), route_id, "legged-routes")
    single, repeated = _once(points, points, point_id, "repeated-points")
    found = [_leg_hits(plain, single, corridor_m, route_id, lat, lon).select(route_id, point_id)]
    for some, of in ((plain, repeated), (legged, points)):
        if some is not None and of is not None:
            found.append(_leg_hits(some, of, corridor_m, route_id, lat, lon).select(route_id, point_id).distinct())
    return reduce(DataFrame.unionByName, found)


def route_blackspots(routes: DataFrame, heat: DataFrame, corridor_m: float, spot_id: str = "accident_id") -> DataFrame:
    """Accidents along each route: number and mean severity.

    A route of one leg meets a spot of one row once, so these pairs are added up where they are found and only sums are
    shuffled. Pairs of routes with several legs, of repeated spots and of null ids are told apart first.
    """
    spots = heat.select(spot_id, "start_lat", "start_lng", "severity")

    plain, legged = _once(routes, segments(routes), "route_id", "legged-routes")
    single, repeated = _once(spots, spots, spot_id, "repeated-spots")
    sums = F.count("*").alias("n"), F.count("severity").alias("known"), F.sum(F.col("severity").cast("double")).alias("total")
    found = [_leg_hits(plain, single, corridor_m, "route_id", "start_lat", "start_lng").groupBy("route_id").agg(*sums)]
    for some, of in ((plain, repeated), (legged, spots)):
        if some is not None and of is not None:
            pairs = corridor_join(some, of, corridor_m, point_id=spot_id, lat="start_lat", lon="start_lng")
            found.append(pairs.groupBy("route_id").agg(*sums))
    every = reduce(DataFrame.unionByName, found).groupBy("route_id").agg(F.sum("n").alias("incident_count"), F.sum("known").alias("_known"), F.sum("total").alias("_total"))
    mean = F.when(F.col("_known") > 0, F.col("_total") / F.col("_known"))
    return every.select("route_id", "incident_count", mean.alias("avg_severity"))


def route_weather(routes: DataFrame, stations: DataFrame, alerts: DataFrame, max_km: float = 100.0) -> DataFrame:
    """For every route and day the nearest station's alert within ``max_km``.

    Stations are met ring by ring, as in `nearest_alerts`: where they are dense, most of those within reach of a
    route are never needed. ``alerts`` has one row per station and date.
    """
    return nearest_alerts(routes, stations, alerts, max_km)


def _first_ring_m(stations: DataFrame, max_m: float, wanted: int = 4) -> float:
    """A radius in which about ``wanted`` stations are expected where they are dense: from the fullest of some coarse cells."""
    counts = stations.groupBy(geo.cell_of(F.col("latitude"), F.col("longitude"), max_m)).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 1
    return max(max_m / 64, min(max_m, max_m * (wanted / most) ** 0.5))


GROUP_PAIRS = 500_000  # (route, station) pairs of a task's group, about
GROUP_ROWS = 1_000_000  # (route, date) rows that it makes, about


def _first_alerts(days: int):
    """For the routes of a group, each with its stations from the nearest on, the first alert of every day that is open."""

    def fill(near: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        stations = pd.Index(known["station"].unique())
        size = known["days"].map(len).to_numpy()
        owner = np.repeat(stations.get_indexer(known["station"]), size)
        text = np.repeat(np.arange(len(known)), size)
        day = np.concatenate(known["days"].to_list()) if len(known) else np.empty(0, int)
        order = np.argsort(owner, kind="stable")
        day, text, start = day[order], text[order], np.searchsorted(owner[order], np.arange(len(stations) + 1))
        texts = known["weather_alert"].to_numpy()
        out = []
        for route, ids, away, done in zip(near["route"], near["stations"], near["distances"], near["done"]):
            place = np.full(days, -1)
            place[done] = -2
            said, left, at = np.empty(days, int), days - len(done), stations.get_indexer(ids)
            for first in range(0, len(at), 64):  # the nearest stations have most days
                if not left:
                    break
                mine = at[first : first + 64]
                many = np.where(mine < 0, 0, start[mine + 1] - start[mine])
                rank = np.repeat(np.arange(first, first + len(mine)), many)
                row = np.repeat(start[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                new = place[day[row]] == -1
                row, rank = row[new][::-1], rank[new][::-1]
                place[day[row]], said[day[row]] = rank, row  # of several stations the nearest is written last
                left = np.count_nonzero(place == -1)
            got = np.flatnonzero(place >= 0)
            if len(got):
                out.append((route, got, np.asarray(ids)[place[got]], texts[text[said[got]]], np.asarray(away)[place[got]]))
        return pd.DataFrame(out, columns=["route", "days", "stations", "texts", "distances"])

    return fill


def _ring_alerts(near: DataFrame, homes: DataFrame, told: DataFrame, done: DataFrame | None, days: int) -> DataFrame:
    """``route_id, day, station, weather_alert, distance_m`` of the nearest station of every day that ``done(route_id, day)`` lacks.

    ``near(route_id, station, distance_m)``; ``homes(route_id, cell)`` puts routes that are near each other in one group, so
    that the alerts ``told(station, weather_alert, days)`` travel once to a group of routes and no (route, station, date) row
    is ever shuffled. A cell of many pairs is cut into several groups.
    """
    listed = near.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("distance_m", "station"))).alias("_near"))
    if done is None:
        listed = listed.withColumn("done", F.array().cast("array<int>"))
    else:
        had = done.groupBy("route_id").agg(F.collect_list("day").alias("done"))  # at most one entry a date
        listed = listed.join(had.withColumnRenamed("route_id", "_id"), F.col("route_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        listed = listed.withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
    homed = listed.join(homes.withColumnRenamed("route_id", "_id"), F.col("route_id").eqNullSafe(F.col("_id"))).drop("_id")
    homed = stage(homed, "near-stations")
    pieces = F.ceil(F.greatest(F.sum(F.size("_near")) / GROUP_PAIRS, F.count("*") * days / GROUP_ROWS)).cast("int")
    cuts = homed.groupBy("cell").agg(F.greatest(F.lit(1), pieces).alias("_cuts"))
    grouped = homed.join(cuts.withColumnRenamed("cell", "_cell"), F.col("cell").eqNullSafe(F.col("_cell"))).drop("_cell")
    grouped = stage(grouped.withColumn("piece", F.pmod(F.xxhash64("route_id"), "_cuts")).drop("_cuts"), "grouped-routes")
    needed = stage(grouped.select("cell", "piece", F.explode("_near.station").alias("station")).distinct(), "needed-stations")
    id_type, station_type = near.schema["route_id"].dataType, near.schema["station"].dataType.simpleString()
    # ids travel as text with a mark, as one may be null
    key = F.coalesce(F.concat(F.lit("="), F.col("route_id").cast("string")), F.lit("")).alias("route")
    left = grouped.select("cell", "piece", key, F.col("_near.station").alias("stations"), F.col("_near.distance_m").alias("distances"), "done")
    right = balanced_join(needed, told, "station")
    schema = f"route string, days array<int>, stations array<{station_type}>, texts array<string>, distances array<double>"
    pair = ["cell", "piece"]
    found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(_first_alerts(days), schema)
    rows = found.select("route", F.inline(F.arrays_zip("days", "stations", "texts", "distances")))
    route = F.when(F.col("route") != "", F.substring("route", 2, 1 << 30).cast(id_type)).alias("route_id")
    return rows.select(route, F.col("days").alias("day"), F.col("stations").alias("station"), F.col("texts").alias("weather_alert"), F.col("distances").alias("distance_m"))


def nearest_alerts(
    routes: DataFrame, stations: DataFrame, alerts: DataFrame, max_km: float = 100.0, first_km: float | None = None, listed: list[int] | None = None
) -> DataFrame:
    """For every route and day the nearest station's alert, found ring by ring: ``route_id, date, station, weather_alert, distance_m``.

    Stations are looked for within a radius that doubles up to ``max_km``. What a ring gives is final, as every
    nearer station has been seen; routes that have an alert for every date of ``alerts`` stop, so where stations are dense only the first
    ring is listed, and later rings list only stations with an alert on a date that some route still lacks. ``first_km`` defaults to the
    radius in which about as many stations are expected as have an alert for every date together. ``listed`` is given the number of
    (route, station, date) rows of each ring. ``alerts`` has one row per station and date.
    """
    max_m = max_km * 1000
    known = alerts.select("station", "date", "weather_alert")
    dates = known.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    dates = stage(dates, "dates")
    numbered = known.join(F.broadcast(dates.withColumnRenamed("date", "_date")), F.col("date").eqNullSafe(F.col("_date")))
    numbered = numbered.where(F.col("station").isNotNull())
    told = stage(numbered.groupBy("station", "weather_alert").agg(F.collect_list("day").alias("days")), "alerts")  # at most one entry a date
    days, rows, speaking = dates.count(), *told.agg(F.sum(F.size("days")), F.count_distinct("station")).first()
    alerting = stage(stations.join(told.select("station").distinct(), "station", "left_semi"), "alerting-stations")
    share = min(0.999, (rows or 0) / max(1, days * speaking))  # of dates that a station has an alert for
    wanted = max(4, math.ceil(math.log(20 * max(1, days)) / -math.log(1 - share))) if share else 4
    reach, inner = (first_km * 1000 if first_km else _first_ring_m(alerting, max_m, wanted)), -1.0
    found, open_, done = [], routes, None
    while True:
        reach = min(reach, max_m)
        near = corridor_join(open_, alerting, reach, point_id="station").where(F.col("distance_m") > inner)
        near = stage(near.select("route_id", "station", "distance_m"), "ring")
        if listed is not None:
            listed.append(near.join(told, "station").agg(F.coalesce(F.sum(F.size("days")), F.lit(0))).first()[0])
        start = F.get("points", F.lit(0))
        homes = open_.groupBy("route_id").agg(F.min(geo.cell_of(start["lat"], start["lon"], 2 * reach)).alias("cell"))
        found.append(stage(_ring_alerts(near, homes, told, done, days), "nearest"))
        if reach >= max_m:
            break
        every = reduce(DataFrame.unionByName, found)
        complete = every.groupBy("route_id").agg(F.count("*").alias("n")).where(F.col("n") >= days).select("route_id")
        open_ = stage(routes.join(complete, "route_id", "left_anti"), "open-routes")
        n_open = open_.select("route_id").distinct().count()
        if not n_open:
            break
        ids = open_.select(F.col("route_id").alias("_id")).distinct()
        done = stage(every.join(ids, F.col("route_id").eqNullSafe(F.col("_id")), "left_semi").select("route_id", "day"), "days-done")
        closed = done.groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") >= n_open).select("day")
        lacking = told.select("station", F.explode("days").alias("day")).join(F.broadcast(closed), "day", "left_anti").select("station").distinct()
        alerting = stage(alerting.join(lacking, "station", "left_semi"), "alerting-stations")
        inner, reach = reach, reach * 2
    every = reduce(DataFrame.unionByName, found).join(F.broadcast(dates), "day")
    return every.select("route_id", "date", "station", "weather_alert", "distance_m")

"""Nearest alerting stations, ring by ring."""

import random

import pytest
from pyspark.sql import functions as F

from midmile.operators import spatial


def tables(spark, n_stations, spread, days, share):
    dice = random.Random(n_stations)
    routes = [(k, 40 + dice.uniform(-1, 1), -100 + dice.uniform(-1, 1), 40 + dice.uniform(-1, 1), -100 + dice.uniform(-1, 1)) for k in range(25)]
    stations = [(k, 40 + dice.uniform(-spread, spread), -100 + dice.uniform(-spread, spread)) for k in range(n_stations)]
    stations += [(9001, 40.2, -99.9), (9002, 40.2, -99.9)]  # two at one place: the smaller counts
    alerts = [(s[0], f"2024-01-{d:02d}", f"alert {s[0] % 3}") for s in stations for d in range(1, days + 1) if dice.random() < share]
    return (
        spatial.with_route_points(spark.createDataFrame(routes, "route_id long, lat1 double, lon1 double, lat2 double, lon2 double")),
        spark.createDataFrame(stations, "station long, latitude double, longitude double"),
        spark.createDataFrame(alerts, "station long, date string, weather_alert string"),
    )


def rows(df):
    return sorted((r.route_id, r.date, r.station, r.weather_alert, round(r.distance_m, 3)) for r in df.collect())


@pytest.mark.parametrize(("n", "spread", "share", "first"), [(300, 2.0, 0.05, None), (40, 3.0, 0.3, 5.0), (6, 5.0, 0.5, None)])
def test_rings_find_what_all_pairs_find(spark, n, spread, share, first):
    routes, stations, alerts = tables(spark, n, spread, 12, share)
    assert rows(spatial.nearest_alerts(routes, stations, alerts, first_km=first)) == rows(spatial.route_weather(routes, stations, alerts))


def test_dense_stations_are_not_all_listed(spark):
    routes, stations, alerts = tables(spark, 1500, 2.0, 10, 0.9)
    listed = []
    found = spatial.nearest_alerts(routes, stations, alerts, listed=listed)
    near = spatial.corridor_join(routes, stations, 100_000.0, point_id="station").select("route_id", "station")
    every = near.join(alerts, "station").count()
    assert rows(found) == rows(spatial.route_weather(routes, stations, alerts))
    assert sum(listed) * 5 <= every


def test_no_alerts_or_routes(spark):
    routes, stations, alerts = tables(spark, 10, 1.0, 3, 0.5)
    assert spatial.nearest_alerts(routes, stations, alerts.where("false")).count() == 0
    assert spatial.nearest_alerts(routes.where("false"), stations, alerts).count() == 0
    assert spatial.nearest_alerts(routes, stations.where("false"), alerts.where(F.col("station") < 0)).count() == 0


def by_hand(routes, stations, alerts):
    """The nearest alert of every route and date, from all pairs."""
    near = spatial.corridor_join(routes, stations, 100_000.0, point_id="station").select("route_id", "station", "distance_m")
    best = {}
    for r in near.join(alerts, "station").collect():
        best[r.route_id, r.date] = min(best.get((r.route_id, r.date), (1e9,)), (r.distance_m, r.station, r.weather_alert))
    return sorted((k[0], k[1], s, a, round(d, 3)) for k, (d, s, a) in best.items())


@pytest.mark.parametrize("find", [spatial.route_weather, spatial.nearest_alerts])
def test_nearest_alerts_are_those_of_all_pairs(spark, find, monkeypatch):
    monkeypatch.setattr(spatial, "GROUP_PAIRS", 100)  # cells are cut into groups
    routes, stations, alerts = tables(spark, 400, 2.0, 30, 0.1)
    rare = spark.createDataFrame([(9002, "2024-02-01", "rare"), (7, "2024-02-02", None)], alerts.schema)
    alerts = alerts.unionByName(rare)
    assert rows_or_null(find(routes, stations, alerts)) == rows_or_null_of(by_hand(routes, stations, alerts))


def rows_or_null_of(found):
    return sorted(found, key=str)


def rows_or_null(df):
    return sorted(rows(df), key=str)


def test_a_rare_date_does_not_list_all_stations_again(spark):
    """One date that only one station knows leaves every route open; later rings list that station only."""
    routes, stations, alerts = tables(spark, 1500, 2.0, 10, 0.9)
    alerts = alerts.unionByName(spark.createDataFrame([(9001, "2024-02-01", "rare")], alerts.schema))
    listed = []
    found = spatial.nearest_alerts(routes, stations, alerts, listed=listed)
    near = spatial.corridor_join(routes, stations, 100_000.0, point_id="station").select("route_id", "station")
    every = near.join(alerts, "station").count()
    assert rows(found) == by_hand(routes, stations, alerts)
    assert sum(listed) * 5 <= every

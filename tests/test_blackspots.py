"""Accidents along routes: which pairs are shuffled, and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from midmile.operators import spatial

ROUTES = "route_id long, points array<struct<lat:double,lon:double>>"
SPOTS = "accident_id long, start_lat double, start_lng double, severity int, state string"


def rows():
    dice = random.Random(5)
    routes = [(k, [(40 + k / 50, -100.0), (40 + k / 50, -99.9)]) for k in range(6)]
    spots = [(k, 40 + dice.random() / 6, -100 + dice.random() / 9, dice.choice([None, 1, 2, 3]), "x") for k in range(300)]
    return routes, spots


def answer(spark, routes, spots):
    found = spatial.route_blackspots(spark.createDataFrame(routes, ROUTES), spark.createDataFrame(spots, SPOTS), 3000.0)
    return found


def by_pairs(spark, routes, spots):
    pairs = spatial.corridor_join(spark.createDataFrame(routes, ROUTES), spark.createDataFrame(spots, SPOTS), 3000.0, point_id="accident_id", lat="start_lat", lon="start_lng")
    return sorted(map(tuple, pairs.groupBy("route_id").agg(F.count("*"), F.avg("severity")).collect()), key=str)


def test_pairs_are_added_up_where_they_are_found(spark, capsys):
    found = answer(spark, *rows())
    found.explain("simple")
    plan = capsys.readouterr().out
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(route_id" in line and "accident_id" in line]
    assert sorted(map(tuple, found.collect()), key=str) == by_pairs(spark, *rows())


@pytest.mark.parametrize("case", ["legs", "twice", "nulls"])
def test_repeats_count_once(spark, case):
    routes, spots = rows()
    if case == "legs":
        routes[2] = (2, [(40.04, -100.0), (40.04, -99.95), (40.04, -99.9)])
        routes.append((3, routes[3][1]))
    if case == "twice":
        spots += spots[:50]
    if case == "nulls":
        routes += [(None, routes[1][1]), (None, routes[4][1])]
        spots += [(None, 40.02, -99.95, 2, "x"), (None, 40.08, -99.95, 2, "x")]
    assert sorted(map(tuple, answer(spark, routes, spots).collect()), key=str) == by_pairs(spark, routes, spots)

"""Points along a curve: the same rows from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from midmile.operators import spatial
from midmile.sources import clustered


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    dice = random.Random(3)
    rows = [(k, dice.uniform(-90, 90), dice.uniform(-180, 180)) for k in range(3000)] + [(5000 + k, 40 + dice.gauss(0, 1), -100 + dice.gauss(0, 1)) for k in range(3000)]
    rows += [(8000 + k, dice.gauss(-17, 1), 180 - abs(dice.gauss(0, 1))) for k in range(300)] + [(8500 + k, dice.gauss(-17, 1), -180 + abs(dice.gauss(0, 1))) for k in range(300)]
    rows += [(9000, None, 1.0), (9001, 1.0, None), (9002, 90.0, 0.0), (9003, -90.0, 180.0), (9004, 40.0, -100.0), (9005, 40.0, -100.0)]
    table = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    path = str(tmp_path_factory.mktemp("points") / "z")
    clustered.write(table, path, 40)
    return table, path


ids = lambda df: sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(("lat", "lon", "metres"), [(40, -100, 50_000), (40, -100, 1), (-17, 179.9, 150_000), (-17, -179.9, 150_000), (89.5, 10, 300_000), (-89.9, 0, 500_000), (10, 20, 2_000_000)])
def test_rows_of_a_circle(spark, points, lat, lon, metres):
    table, path = points
    got = clustered.within_radius(spark, path, lat, lon, metres)
    assert ids(got) == ids(spatial.within_radius(table, lat, lon, metres)) and "_curve" not in got.columns


@pytest.mark.parametrize("route", [[(39.0, -101.0), (41.0, -99.0), (41.5, -102.0)], [(40.0, -100.0)], [(-17.0, 179.0), (-17.5, -179.0)], [(30.0, -100.0), (50.0, 20.0)]])
def test_rows_along_a_line(spark, points, route):
    table, path = points
    want = table.where(spatial.meets_route(table, route, 20_000.0))
    assert ids(clustered.meets_route(spark, path, route, 20_000.0)) == ids(want)


def test_few_files_are_read(spark, points):
    _, path = points
    near = clustered.read(spark, path, [clustered.around(40, -100, 30_000)])
    files = near.select("_metadata.file_path").distinct().count()
    every = spark.read.parquet(path).select("_metadata.file_path").distinct().count()
    assert 0 < files <= every / 3
    plan = near._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "_curve" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_ranges_cover_their_boxes():
    dice = random.Random(4)
    for _ in range(50):
        lat, lon, metres = dice.uniform(-85, 85), dice.uniform(-180, 180), dice.uniform(10, 3_000_000)
        box = clustered.around(lat, lon, metres)
        found = clustered.ranges([box])
        assert 0 < len(found) <= clustered.RANGES + 3 and all(a <= b for a, b in found)
    assert clustered.ranges([]) == []


def test_the_curve_interleaves(spark):
    row = spark.range(1).select(clustered.curve(F.lit(90.0), F.lit(-180.0)).alias("a"), clustered.curve(F.lit(-90.0), F.lit(180.0)).alias("b"), clustered.curve(F.lit(None).cast("double"), F.lit(1.0)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0xAAAAAAAA, 0x55555555, None)

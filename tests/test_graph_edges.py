"""Edges of records and corridors without repeats, and walks that move the edges of the frontier's types only."""

import pytest
from pyspark.sql import functions as F

from midmile.operators import graph, spatial
from midmile.runtime import stage

IDS = ["load_id", "customer_id", "truck_id", "driver_id", "facility_id", "route_id"]


def test_edges_of_records_are_told_apart(spark):
    records = [(f"l{i % 7}" if i % 5 else None, f"c{i % 3}" if i % 2 else None, f"t{i % 4}" if i % 6 else None, f"d{i % 4}" if i % 7 else None, None, None) for i in range(200)]
    found = graph._record_pairs(spark.createDataFrame(records, ", ".join(f"{c} string" for c in IDS)).repartition(4))
    want = set()
    for r in records:
        at = {kind: r[IDS.index(c)] for c, kind in graph.ENTITIES.items()}
        for place, (_, a, b) in enumerate(graph.KINDS):
            if at.get(a) and at.get(b):
                want.add((place, at[a], at[b]))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_pairs_of_a_corridor_come_once(spark):
    line = lambda y, n: [(30.0 + y, -100.0 + x / 10) for x in range(n)]
    ends = [(1, line(0, 2)), (2, line(0, 3)), (3, line(0.01, 2)), (3, line(0.01, 2)), (None, line(0, 2)), (4, line(5, 2)), (5, None)]
    routes = spark.createDataFrame(ends, "route_id int, points array<struct<lat: double, lon: double>>")
    spots = [(k, 30.0 + k / 1000, -99.95) for k in range(12)] + [(3, 30.0, -99.96), (None, 30.0, -99.97), (7, None, -99.9), (9, 30.0, -99.9)]
    points = spark.createDataFrame(spots, "bridge_id int, latitude double, longitude double")
    for some in (routes, routes.where("route_id in (1, 4, 5)")):
        rows = lambda df: sorted(map(str, df.select("route_id", "bridge_id").collect()))
        want = rows(spatial.corridor_join(some, points, 800.0))
        assert rows(spatial.corridor_pairs(some, points, 800.0)) == want and want


def test_pairs_of_single_rows_are_not_moved(spark):
    routes = stage(spark.createDataFrame([(1, [(30.0, -100.0), (30.0, -99.9)])], "route_id int, points array<struct<lat: double, lon: double>>"), "routes")
    points = stage(spark.createDataFrame([(1, 30.0, -99.95)], "bridge_id int, latitude double, longitude double"), "points")
    plan = spatial.corridor_pairs(routes, points, 500.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


@pytest.mark.parametrize("few", [64, 0])
def test_a_large_frontier_moves_links_of_its_types_only(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "SMALL_FRONTIER", 0)
    monkeypatch.setattr(graph, "FEW_TYPES", few)
    cut, plain = [], graph.stage

    def seen(df, name):
        if name == "near-links":
            cut.append("substring_index" in df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(graph, "stage", seen)
    rows = [("a:1", "b:1"), ("a:1", "b:2"), ("b:1", "c:1"), ("b:2", "c:1"), ("d:1", "a:1"), ("bare", "a:1"), (None, "a:1")]
    edges = stage(spark.createDataFrame(rows, "src string, dst string"), "edges")
    found = graph.expand(spark.createDataFrame([("a:1",), ("bare",)], "node_id string"), edges, hops=2)
    assert {(r.seed, r.node, r.hop, r.path) for r in found.where(F.col("hop") > 0).collect()} == {
        ("a:1", "b:1", 1, "a:1>b:1"), ("a:1", "b:2", 1, "a:1>b:2"), ("a:1", "c:1", 2, "a:1>b:1>c:1"),
        ("bare", "a:1", 1, "bare>a:1"), ("bare", "b:1", 2, "bare>a:1>b:1"), ("bare", "b:2", 2, "bare>a:1>b:2"),
    }
    assert cut == [bool(few)] * 2

"""Walks over a graph of which the frontier touches little."""

import os
import time

import pytest
from pyspark.sql import functions as F

from midmile.operators import graph
from midmile.plans import evidence
from midmile.plans.catalog import QUERIES
from midmile.runtime import is_staged, stage


def slow_walk(edges, seed, hops):
    met, frontier = {seed: (0, seed)}, {seed: seed}
    for hop in range(1, hops + 1):
        new = {}
        for a, b in edges:
            if a in frontier and b not in met:
                path = f"{frontier[a]}>{b}"
                new[b] = min(new.get(b, path), path)
        met |= {n: (hop, path) for n, path in new.items()}
        frontier = new
    return {(seed, n, hop, path) for n, (hop, path) in met.items()}


@pytest.mark.parametrize(("small", "staged"), [(1000, False), (1000, True), (2, False), (0, True)])
def test_a_walk_joins_the_edges_of_its_frontier_only(spark, monkeypatch, small, staged):
    monkeypatch.setattr(graph, "SMALL_FRONTIER", small)
    joined, plain = [], graph.balanced_join
    monkeypatch.setattr(graph, "balanced_join", lambda left, right, key: joined.append(right.count()) or plain(left, right, key))
    near = [("s", f"m{k}") for k in range(5)] + [(f"m{k}", f"e{k % 3}") for k in range(5)] + [("m1", "s"), ("e1", "z")]
    far = [(f"far{k}", f"far{k + 1}") for k in range(500)]
    rows = [(a, b, kind) for a, b in near + far for kind in ("x", "y", "x")]  # repeats do not multiply
    edges = spark.createDataFrame([*rows, (None, "m1", "x")], "src string, dst string, kind string").repartition(4)
    seeds = spark.createDataFrame([("s",), ("s",), ("none",), (None,)], "node_id string")
    found = graph.expand(seeds, stage(edges, "edges") if staged else edges, hops=3).where("seed is not null")
    want = slow_walk(near, "s", 3) | {("none", "none", 0, "none")}
    assert {tuple(r) for r in found.select("seed", "node", "hop", "path").collect()} == want and found.count() == len(want)
    assert joined == [5, 6, 1]


def test_null_seeds_reach_themselves_only(spark):
    edges = spark.createDataFrame([("a", "b"), (None, "c")], "src string, dst string")
    found = graph.expand(spark.createDataFrame([(None,), ("a",)], "node_id string"), edges, hops=1)
    assert sorted((r.seed or "", r.node or "", r.hop) for r in found.collect()) == [("", "", 0), ("a", "a", 0), ("a", "b", 1)]
    assert found.where(F.col("path").isNull()).count() == 1


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (os.path.basename(f) for f in found.mkString("|").split("|")) if name.startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 100


def test_only_edges_that_a_walk_can_take_are_kept(spark):
    rows = [(f"{a}:1", f"{b}:2", kind) for kind, a, b in graph.KINDS]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    kept = lambda types, hops: {r.kind for r in graph.onward(edges, types, hops).collect()}
    assert kept(["customer", "state"], 1) == {"customer_has_load", "state_has_city"}
    assert kept(["customer", "state"], 2) == {"customer_has_load", "state_has_city", "load_on_truck", "load_by_driver"}
    assert kept(["customer"], 3) == {"customer_has_load", "load_on_truck", "load_by_driver", "driver_assigned_to", "truck_on_trip"}
    assert kept(["station"], 9) == {"weather_affects", "route_passes_through"} and kept(["city"], 2) == set()


def test_the_registered_walk_stores_no_edges_that_it_cannot_take(spark, monkeypatch):
    """and deletes its edges, links and starts; its last hop is not stored."""
    rows = [("customer:1", "load:1", "customer_has_load"), ("load:1", "truck:1", "load_on_truck"), ("truck:1", "load:2", "truck_on_trip")]
    rows += [(f"bridge:{k}", f"route:{k % 3}", "bridge_on_route") for k in range(50)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    nodes = spark.createDataFrame([("customer:1", "customer"), ("bridge:1", "bridge")], "node_id string, node_type string")
    kept = []
    noted = lambda df, name: kept.append((name, table := stage(df, name), table.count())) or table
    monkeypatch.setattr(evidence, "_graph", lambda v: (nodes, edges))
    monkeypatch.setattr(evidence, "stage", noted)
    monkeypatch.setattr(graph, "stage", noted)
    found = QUERIES["r13_expand"](spark, "")
    assert sorted((r.hop, r.reached, r.first_path) for r in found.collect()) == [(0, 1, "customer:1"), (1, 1, "customer:1>load:1"), (2, 1, "customer:1>load:1>truck:1")]
    assert [n for name, _, n in kept if name == "edges"] == [2]
    assert [name for name, table, _ in kept if is_staged(table)] == ["walk", "walk", "near-links"]


def test_paths_of_odd_names(spark):
    edges = [("a>b", "c"), ("c", "d>"), ("c", "é"), ("a>b", "é"), ("é", ">"), ("d>", ">"), (">", "z"), ("a", "b"), ("b", "c")]
    seeds = spark.createDataFrame([("a>b",), ("a",)], "node_id string")
    found = graph.expand(seeds, spark.createDataFrame(edges, "src string, dst string"), hops=4)
    assert {tuple(r) for r in found.select("seed", "node", "hop", "path").collect()} == slow_walk(edges, "a>b", 4) | slow_walk(edges, "a", 4)

"""Tables rewritten in parts, incremental heatmaps and stored sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from midmile.operators import analytics as A
from midmile.operators import sketches
from midmile.sources import versioned as V

ROW = "k long, g string, n long"


def table(tmp_path, parts=8):
    return V.Table(str(tmp_path / "t"), ROW, ("k", "g"), parts)


def rows(spark, *given):
    return spark.createDataFrame(list(given), ROW)


def content(spark, t, **at):
    return sorted((tuple(r) for r in V.read(spark, t, **at).collect()), key=str)


def files(spark, t):
    return set(V.read(spark, t).select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def test_loads_that_overlap(spark, tmp_path):
    t = table(tmp_path)
    order = [F.desc("n")]
    assert V.read(spark, t).count() == 0 and V.batches(spark, t).count() == 0
    assert V.upsert(t, rows(spark, (1, "a", 1), (2, "a", 1), (None, "a", 1), (1, None, 1), (1, "a", 5)), order, "first") == 1
    assert V.upsert(t, rows(spark, (2, "a", 2), (3, "b", 2), (None, "a", 7), (3, "b", 1)), order, "second") == 2
    want = sorted([(1, "a", 5), (2, "a", 2), (3, "b", 2), (None, "a", 7), (1, None, 1)], key=str)
    assert content(spark, t) == want
    assert V.upsert(t, rows(spark, (9, "z", 9)), order, "second") is None
    assert content(spark, t) == want
    V.delete(t, rows(spark, (2, "a", 0), (1, None, 0), (77, "q", 0)), "third")
    assert content(spark, t) == sorted([(1, "a", 5), (3, "b", 2), (None, "a", 7)], key=str)
    assert content(spark, t, version=2) == want  # an earlier version is still there
    assert V.upsert(t, rows(spark), order, "nothing") == 4
    assert len(content(spark, t)) == 3


def test_only_touched_parts_are_written(spark, tmp_path):
    t = table(tmp_path, 32)
    V.upsert(t, spark.range(500).selectExpr("id as k", "'a' as g", "id as n"), [F.desc("n")], "1")
    before = files(spark, t)
    V.upsert(t, rows(spark, (7, "a", -1), (8, "a", -2)), [F.desc("n")], "2")
    after = files(spark, t)
    assert len(after - before) <= 2 and len(before & after) >= 29
    assert V.read(spark, t).agg(F.count("*"), F.sum("n")).first() == (500, sum(range(500)) - 15 - 3)


def test_a_load_that_broke_off(spark, tmp_path, monkeypatch):
    """Files without their manifest are never read, and the load can be given again."""
    t = table(tmp_path)
    order = [F.desc("n")]
    V.upsert(t, rows(spark, (1, "a", 1), (2, "b", 1)), order, "1")
    new = rows(spark, (1, "a", 2), (5, "e", 2))
    plain = spark.createDataFrame

    def lost(data, *schema):
        if schema and "batch string" in str(schema[0]) and data:
            raise RuntimeError("lost before the manifest")
        return plain(data, *schema)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *s, **k: lost(data, *s))
    with pytest.raises(RuntimeError):
        V.upsert(t, new, order, "2")
    monkeypatch.undo()
    assert content(spark, t) == [(1, "a", 1), (2, "b", 1)]
    V.upsert(t, rows(spark, (1, "a", 3)), order, "2")
    assert content(spark, t) == [(1, "a", 3), (2, "b", 1)]


def test_heat_after_inserts_updates_and_deletes(spark, tmp_path):
    dice = random.Random(3)
    t0 = datetime(2024, 1, 1)
    schema = "accident_id long, state string, city string, start_time timestamp_ntz, severity int"
    live = {k: (k, dice.choice(["A", "B"]), dice.choice(["x", None]), t0 + timedelta(minutes=dice.randrange(3000)), dice.choice([1, 2, 3, 4, None])) for k in range(400)}
    frame = lambda rows: spark.createDataFrame(rows, schema)
    t = V.heat_table(str(tmp_path / "heat"), 8)
    same = lambda: [sorted((tuple(r) for r in df.collect()), key=str) for df in (V.heat(spark, t), A.risk_heatmap(frame(list(live.values()))))]
    V.fold_heat(t, V.heat_changes(frame(list(live.values()))), "0")
    for batch in range(1, 4):
        old = [live[k] for k in dice.sample(sorted(live), 60)]
        gone, changed = old[:20], old[20:]
        new = [(k, dice.choice(["A", "C"]), city, at, dice.choice([1, None])) for k, _, city, at, _ in changed]
        new += [(1000 * batch + k, "D", "y", t0 - timedelta(days=k), 2) for k in range(5)]  # late rows
        changes = V.heat_changes(frame(new), frame(old))
        V.fold_heat(t, changes, str(batch))
        V.fold_heat(t, changes, str(batch))
        live = {k: r for k, r in live.items() if r not in gone} | {r[0]: r for r in new}
        got, want = same()
        assert got == want


def test_sketches_merge_like_the_rows(spark):
    dice = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = [(dice.choice("abc"), t0 + timedelta(minutes=dice.randrange(5000)), dice.choice([None, int(dice.expovariate(0.001)), 5, 5])) for _ in range(30_000)]
    log = spark.createDataFrame(rows, "kind string, created_at timestamp_ntz, execution_time_ms long").repartition(7)
    stored = sketches.hourly_sketches(log, ["kind"])
    found = sketches.quantiles(sketches.merged(stored, ["kind"])).cache()
    assert {(r.kind, r.level) for r in found.collect()} == {("a", 0), ("b", 0), ("c", 0), (None, 1)}
    assert found.where("kind is null").agg(F.max("rows")).first()[0] == sum(r[2] is not None for r in rows)
    errors = sketches.rank_errors(log, found.where("level = 0").select("kind", "q", "value"), ["kind"])
    assert errors.count() == 9 and errors.agg(F.max("error")).first()[0] < 0.01
    assert sketches.merged(stored.where("false"), ["kind"]).where("level = 0").count() == 0

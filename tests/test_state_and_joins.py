"""Keyed state with late rows, and the join of two streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from midmile.streaming import joined, keyed

T0 = datetime(2024, 3, 1)
INCIDENT = "state string, city string, start_time timestamp, severity int"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def feed(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def incidents(n, seed):
    dice = random.Random(seed)
    places = [("A", "x"), ("A", "y"), ("B", None)]
    return [(*dice.choice(places), T0 + timedelta(minutes=dice.randrange(0, 24 * 60)), dice.randrange(1, 5)) for _ in range(n)]


def hourly(rows):
    out = {}
    for state, city, at, severity in rows:
        if at is not None:
            key = (state, city, at.replace(minute=0))
            n, s = out.get(key, (0, 0))
            out[key] = (n + 1, s + (severity or 0))
    return {k: (n, round(s / n, 9)) for k, (n, s) in out.items()}


def heat(spark, dst):
    return {(r.state, r.city, r.hour): (r.incident_count, round(r.avg_severity, 9)) for r in keyed.keyed_heatmap(spark, dst).collect()}


def test_late_rows_are_corrections(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ckpt"))
    rows = sorted(incidents(900, 1), key=lambda r: r[2])
    lateness = [0, 0, 0, 1, 2, 3, 5]
    arriving = sorted((r[2] + timedelta(hours=lateness[k % 7]), k) for k, r in enumerate(rows))
    for part in range(9):  # each batch is a hundred rows as they arrive; the stream starts anew for every third
        arrive(spark, src, [rows[k] for _, k in arriving[part * 100 : part * 100 + 100]], INCIDENT)
        if part % 3 == 2:
            keyed.stream_keyed_heatmap(feed(spark, src, INCIDENT), dst, ckpt).awaitTermination()
    assert heat(spark, dst) == hourly(rows)
    found = spark.read.parquet(dst)
    late = found.where("kind = 'late'").agg(F.sum("incident_count")).first()[0]
    assert 0 < late < 300  # more than two hours late
    assert found.where("kind = 'closed'").groupBy("state", "city", "hour").count().where("count > 1").isEmpty()
    # a restart without news writes nothing
    before = found.count()
    keyed.stream_keyed_heatmap(feed(spark, src, INCIDENT), dst, ckpt).awaitTermination()
    assert spark.read.parquet(dst).count() == before


def test_closed_hours_leave_the_state(spark, tmp_path):
    src, dst, ckpt = (str(tmp_path / n) for n in ("src", "dst", "ckpt"))
    arrive(spark, src, [("A", "x", T0 + timedelta(hours=k), 2) for k in range(6)] + [("B", "y", T0, 3)], INCIDENT)
    keyed.stream_keyed_heatmap(feed(spark, src, INCIDENT), dst, ckpt).awaitTermination()
    closed = {(r.state, r.hour.hour) for r in spark.read.parquet(dst).where("kind = 'closed'").collect()}
    assert closed == {("A", 0), ("A", 1), ("A", 2), ("B", 0)}
    arrive(spark, src, [("A", "x", T0, 4), ("A", "x", T0 + timedelta(hours=4), 4), ("A", "x", None, 1), ("A", "x", T0 + timedelta(hours=5), None)], INCIDENT)
    keyed.stream_keyed_heatmap(feed(spark, src, INCIDENT), dst, ckpt).awaitTermination()
    got = {(r.state, r.hour.hour): (r.incident_count, r.avg_severity, r.corrections) for r in keyed.keyed_heatmap(spark, dst).collect()}
    assert got == {("A", 0): (2, 3.0, 1), ("A", 1): (1, 2.0, 0), ("A", 2): (1, 2.0, 0), ("A", 3): (1, 2.0, 0), ("A", 4): (2, 3.0, 0), ("A", 5): (2, 1.0, 0), ("B", 0): (1, 3.0, 0)}


# --- two streams

LEFT = "place string, start_time timestamp, severity int"
RIGHT = "place string, observed_at timestamp, visib double"


@pytest.fixture(scope="module")
def both():
    dice = random.Random(2)
    at = lambda: T0 + timedelta(minutes=dice.randrange(0, 36 * 60))
    left = [(dice.choice("abc"), at(), dice.randrange(1, 5)) for _ in range(400)] + [(None, T0, 1), ("a", None, 2)]
    right = [(dice.choice("abd"), at(), dice.choice([None, 0.5, 3.0])) for _ in range(500)] + [(None, T0, 1.0), ("a", None, 1.0)]
    return left, right


def patches(left, right):
    out = {}
    for place, start, severity in left:
        for other, seen, visib in right:
            if place is not None and place == other and start and seen and start - timedelta(hours=2) <= seen <= start:
                hour = start.replace(minute=0)
                first = hour - timedelta(hours=hour.hour % 4)
                for w in (first - timedelta(hours=4), first):
                    n, bad, s = out.get((place, w), (0, 0, 0))
                    out[place, w] = (n + 1, bad + (visib is not None and visib < 1), s + severity)
    return out


def found(df):
    return {(r.place, r.patch_start): (r.readings, r.bad_readings, r.severity_sum) for r in df.collect()}


def test_patches_of_tables(spark, both):
    left, right = both
    table = joined.joined_patches(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), F.col("visib") < 1)
    assert found(table) == patches(left, right)


def test_patches_of_streams_are_those_of_tables(spark, tmp_path, both):
    left, right = both
    a, b, dst, ckpt = (str(tmp_path / n) for n in ("a", "b", "dst", "ckpt"))
    order = lambda rows: sorted((r for r in rows if r[1]), key=lambda r: r[1])
    ends = T0 + timedelta(days=9)  # rows that move both watermarks past the last patch
    left_rows, right_rows = order(left), order(right)
    run = lambda: joined.stream_joined_patches(feed(spark, a, LEFT), feed(spark, b, RIGHT), F.col("visib") < 1, dst, ckpt).awaitTermination()
    for part in range(3):
        arrive(spark, a, left_rows[part * 140 : part * 140 + 140], LEFT)
        arrive(spark, b, right_rows[part * 170 : part * 170 + 170], RIGHT)
        run()
    for k in range(3):
        arrive(spark, a, [("end", ends + timedelta(hours=k), 1)], LEFT)
        arrive(spark, b, [("other", ends + timedelta(hours=k), 1.0)], RIGHT)
        run()
    assert found(spark.read.parquet(dst)) == patches(left, right)


def test_patches_do_not_make_pairs(spark, both):
    """Readings after an incident count too when asked for, an unknown severity adds nothing, and no join makes the pairs."""
    left, right = both
    left = [(p, t, None if k % 3 == 0 or p == "b" else s) for k, (p, t, s) in enumerate(left)]
    right = [(p, t and t + timedelta(seconds=1), v) for p, t, v in right]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    table = joined.joined_patches(a, b, F.col("visib") < 1, "6 hours", "4 hours", "30 minutes", "3 hours")
    assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    met = joined.within(a, b, "30 minutes", "3 hours").groupBy("place", F.window("start_time", "6 hours", "4 hours").alias("w"))
    pairs = met.agg(F.count("*").alias("n"), F.count_if(F.col("visib") < 1).alias("bad"), F.sum("severity").alias("s")).collect()
    assert pairs and found(table) == {(r.place, r.w.start): (r.n, r.bad, r.s) for r in pairs}

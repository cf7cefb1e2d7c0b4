import json
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions import columns as C
from midmile.operators import analytics as A
from midmile.plans import medallion
from midmile.runtime import fresh_path
from midmile.sources import readers, tables, writers
from midmile.sources.schema import columns
from midmile.streaming import feeds

ROW = columns("id int, name string")


@pytest.fixture
def database(spark):
    name = f"db_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, name)}'")
    return name


def drop(spark, folder, name, text):
    """A file that arrives in a folder."""
    import os

    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)


def test_quotes_and_line_breaks_in_cells(spark):
    folder = fresh_path(spark, "csv")
    drop(spark, folder, "a.csv", 'id,name\n1,"a, ""b"""\n2,\n')
    got = {r.id: r.name for r in readers.scan_csv(spark, folder, ROW).collect()}
    assert got == {1: 'a, "b"', 2: None}


def test_columns_follow_each_header(spark):
    folder = fresh_path(spark, "headers")
    drop(spark, folder, "a b.csv", "name,extra,ID\nx,0,1\n")
    drop(spark, folder, "b.csv", "id,name\n2,y\n")
    drop(spark, folder, "c.csv", "")
    assert {(r.id, r.name) for r in readers.scan_csv(spark, folder, ROW).collect()} == {(1, "x"), (2, "y")}
    drop(spark, folder, "e.csv", "id\n3\n")
    with pytest.raises(ValueError, match="no column name"):
        readers.scan_csv(spark, folder, ROW)
    other = fresh_path(spark, "headers")
    drop(spark, other, "a.csv", "b,a\nB1,A1\n")
    drop(spark, other, "b.csv", "a,c\nA2,C2\n")
    assert {(r.a, r.b, r.c) for r in readers.scan_by_header(spark, other).collect()} == {("A1", "B1", None), ("A2", None, "C2")}
    empty = fresh_path(spark, "headers")
    drop(spark, empty, "a.csv", "")
    assert readers.scan_csv(spark, empty, ROW).collect() == []


def test_a_feed_with_another_header_fails(spark):
    src, dst, ckpt = (fresh_path(spark, n) for n in ("src", "dst", "ckpt"))
    drop(spark, src, "a.csv", "name,id\nx,1\n")
    with pytest.raises(StreamingQueryException):
        feeds.stream_files(spark, src, ROW, dst, ckpt).awaitTermination()


def test_positional_ignores_the_header_names(spark):
    folder = fresh_path(spark, "pos")
    drop(spark, folder, "a.csv", "X,Y\n1,2024-01-05\nbad,never\n")
    rows = readers.scan_positional(spark, folder, ["n", "d"], {"n": F.col("n").try_cast("int"), "d": F.col("d").try_cast("date")})
    got = rows.orderBy("n").collect()
    assert [(r.n, str(r.d)) for r in got] == [(None, "None"), (1, "2024-01-05")]


def test_missing_files_are_skipped(spark):
    folder = fresh_path(spark, "tagged")
    drop(spark, folder, "loads.csv", "id,name\n1,x\n")
    parts = readers.scan_tagged(spark, folder, {"loads.csv": "load", "trips.csv": "trip"}, {"loads.csv": ROW, "trips.csv": ROW})
    assert list(parts) == ["loads.csv"] and parts["loads.csv"].first().record_type == "load"


def test_years_prune_folders(spark):
    df = spark.range(1000).select(F.col("id").alias("v"), F.expr("date_add(date'2022-01-01', cast(id as int))").alias("date"))
    path = fresh_path(spark, "years")
    readers.write_by_year(df, path)
    got = readers.scan_years(spark, path, [2023])
    plan = got._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert got.count() == 365 and "data_year" in pruned and "2023" in pruned


def test_filters_and_columns_reach_the_scan(spark):
    path = fresh_path(spark, "push")
    spark.range(100).select("id", F.lit("x").alias("unused"), F.expr("date_add(date'2022-01-01', cast(id as int))").alias("date")).write.parquet(path)
    plan = spark.read.parquet(path).where(C.in_years(F.col("date"), [2022])).select("id", "date")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "unused" not in plan


def test_scenarios_as_array_and_lines(spark):
    folder = fresh_path(spark, "scenarios")
    rows = [{"id": "Q1", "route_wkt": "LINESTRING(1 2, 3 4)", "vehicle_weight_tons": 40.0, "extra": 1}, {"id": "Q2"}]
    drop(spark, folder, "a.json", json.dumps(rows))
    got = readers.read_scenarios(spark, folder).orderBy("id").collect()
    assert [(r.id, r.vehicle_weight_tons) for r in got] == [("Q1", 40.0), ("Q2", None)]
    out = fresh_path(spark, "results")
    writers.write_results(readers.read_scenarios(spark, folder), out)
    assert readers.read_scenarios(spark, out, multi_line=False).count() == 2


def test_layers(spark, database):
    for layer in tables.LAYERS.values():
        tables.create_layer(spark, database, layer)
    again = tables.create_layer(spark, database, tables.GOLD)
    assert len(again) == len(tables.GOLD)
    rows = tables.describe_columns(spark, database).collect()
    assert {r.table_name for r in rows} == {t for layer in tables.LAYERS.values() for t in layer}
    assert sum(r.table_name == "logistics" for r in rows) == 28


def test_sinks(spark, database):
    df = spark.createDataFrame([(1, "a")], ROW)
    writers.write_append(df, f"{database}.t")
    writers.write_append(df, f"{database}.t")
    assert spark.table(f"{database}.t").count() == 2
    writers.write_full(df, f"{database}.t")
    assert spark.table(f"{database}.t").count() == 1
    writers.write_replace(df.select("id", F.lit(2.0).alias("other")), f"{database}.t")
    assert spark.table(f"{database}.t").columns == ["id", "other"]


def test_audit_log(spark, database):
    tables.create_layer(spark, database, tables.GOLD)
    line = spark.createDataFrame([("u", "it's \"q\"", "r", '["a","b"]', 12, True)], "user_id string, query_text string, response_text string, sources string, execution_time_ms int, is_grounded boolean")
    writers.append_log(line, f"{database}.query_logs")
    writers.append_log(line, f"{database}.query_logs")
    rows = spark.table(f"{database}.query_logs").collect()
    assert len({r.query_id for r in rows}) == 2 and rows[0].grounding_sources == ["a", "b"] and rows[0].query_text == "it's \"q\""


def test_each_file_is_loaded_once(spark):
    src, dst, ckpt = (fresh_path(spark, n) for n in ("src", "dst", "ckpt"))
    drop(spark, src, "a.csv", "id,name\n1,x\n2,y\n")
    assert feeds.load_new(spark, src, dst, ROW, ckpt) == 2
    assert feeds.load_new(spark, src, dst, ROW, ckpt) == 0
    drop(spark, src, "b.csv", "id,name\n3,z\n")
    assert feeds.load_new(spark, src, dst, ROW, ckpt) == 1
    assert sorted(r.id for r in spark.read.schema(ROW).parquet(dst).collect()) == [1, 2, 3]


def test_bad_rows_are_kept_apart(spark):
    src, dst, bad, ckpt = (fresh_path(spark, n) for n in ("src", "good", "bad", "ckpt"))
    drop(spark, src, "a.csv", "id,name\n1,x\nnope,y\n3,z,too many\n4,\n")
    feeds.stream_with_quarantine(spark, src, ROW, dst, bad, ckpt).awaitTermination()
    good = sorted(r.id for r in spark.read.schema(ROW).parquet(dst).collect())
    lost = sorted(r[feeds.BAD_ROW] for r in spark.read.parquet(bad).collect())
    assert good == [1, 4] and lost == ["3,z,too many", "nope,y"]


ACCIDENT = columns("start_time timestamp, state string, city string, severity int")


def arrive(spark, folder, rows):
    spark.createDataFrame([(t, "s", "c", sev) for t, sev in rows], "start_time string, state string, city string, severity int").selectExpr(
        "cast(start_time as timestamp) start_time", "state", "city", "severity"
    ).coalesce(1).write.mode("append").parquet(folder)


def heat_of(spark, folder, dst, ckpt):
    stream = spark.readStream.schema(ACCIDENT).parquet(folder)
    feeds.stream_heatmap(stream, dst, ckpt, "2 hours").awaitTermination()
    return {str(r.hour): (r.incident_count, r.avg_severity) for r in feeds.fresh_heatmap(spark, dst).collect()}


def test_fresh_heatmap_drops_only_rows_past_the_watermark(spark):
    src, dst, ckpt = (fresh_path(spark, n) for n in ("acc", "heat", "ckpt"))
    arrive(spark, src, [("2024-01-01 10:05:00", 1), ("2024-01-01 10:50:00", 3), ("2024-01-01 12:00:00", 4)])
    first = heat_of(spark, src, dst, ckpt)
    batch = A.risk_heatmap(spark.read.schema(ACCIDENT).parquet(src))
    assert first == {str(r.hour): (r.incident_count, r.avg_severity) for r in batch.collect()}
    arrive(spark, src, [("2024-01-01 11:10:00", 2), ("2024-01-01 16:00:00", 2)])  # late, but within two hours
    assert heat_of(spark, src, dst, ckpt)["2024-01-01 11:00:00"] == (1, 2.0)
    arrive(spark, src, [("2024-01-01 10:20:00", 4), ("2024-01-01 16:30:00", 4)])  # too late by now
    last = heat_of(spark, src, dst, ckpt)
    assert last["2024-01-01 10:00:00"] == (2, 2.0) and last["2024-01-01 16:00:00"] == (2, 3.0)


def test_compacted_heatmap_reads_the_same(spark):
    src, dst, ckpt = (fresh_path(spark, f"compact-{n}") for n in ("src", "dst", "ckpt"))
    marks = []
    for n in range(1, 4):
        arrive(spark, src, [(f"2024-01-01 10:0{n}:00", n)])
        seen = heat_of(spark, src, dst, ckpt)
        assert seen == {"2024-01-01 10:00:00": (n, (n + 1) / 2)}
        for _ in range(2):  # the second time there is nothing new to fold
            feeds.compact_heatmap(spark, dst)
        marks.append(feeds._compacted(spark, dst))
        assert heat_of(spark, src, dst, ckpt) == seen
    assert marks == sorted(marks) and marks[-1] > 0


def test_a_dataset_feed_maps_columns_and_keeps_broken_lines(spark):
    src, dst, bad, ckpt = (fresh_path(spark, f"dataset-{n}") for n in ("src", "dst", "bad", "ckpt"))
    header = ["Severity", "ID", "Start_Time", "City"]
    drop(spark, src, "a.csv", "Severity,ID,Start_Time,City\n2,A-1,2023-02-08 05:46:00,Dayton\nbad,A-2,,\nalone\n")
    medallion.feed(spark, "accidents", src, header, dst, bad, ckpt)
    medallion.feed(spark, "accidents", src, header, dst, bad, ckpt)
    rows = spark.read.parquet(dst).orderBy("accident_id").collect()
    assert [(r.accident_id, r.severity, r.city, r.state) for r in rows] == [("A-1", 2, "Dayton", None), ("A-2", None, None, None)]
    assert rows[0].start_time.hour == 5
    assert [r[0] for r in spark.read.schema("_corrupt_record string").parquet(bad).collect()] == ["alone"]


def test_patches_overlap(spark):
    df = spark.sql("select cast('2024-01-01 05:00:00' as timestamp) t, 2 v")
    got = sorted(str(r.patch_start) for r in feeds.patches(df, "t", F.col("v")).collect())
    assert got == ["2024-01-01 00:00:00", "2024-01-01 04:00:00"]


def test_mixed_columns_stay_text(spark):
    assert readers.all_text(["a", "b"]) == T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

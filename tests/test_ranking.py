import random

import pytest
from pyspark.sql import functions as F

from midmile.operators import silver as S
from midmile.operators.ranking import balanced_join, row_index, top_n, top_per_group
from midmile.runtime import fresh_path, stage, workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def inputs(spark, build):
    """Names of the tables that a build stages."""
    import midmile.operators.ranking as ranking

    names, real = [], ranking.stage
    ranking.stage = lambda df, name: (names.append(name), real(df, name))[1]
    try:
        build()
    finally:
        ranking.stage = real
    return names


def test_rows_from_files_are_numbered_without_a_copy(spark):
    df = stage(spark.range(10), "t")
    assert inputs(spark, lambda: row_index(df, [F.col("id").asc()])) == ["row-index"]


def test_workspace_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert workspace(spark) == (configured or workspace(spark))
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def test_stage_keeps_rows_and_cuts_lineage(spark):
    df = stage(spark.range(100).withColumn("x", F.rand(1)), "t")
    assert df.collect() == df.collect() and "Range" not in plan(df)


def test_row_index_matches_a_sort_with_one_hot_value(spark):
    random.seed(1)
    values = [random.choice([5, 5, 5, random.randrange(1000)]) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    got = [(r.v, r.i) for r in row_index(df, [F.col("v").asc(), F.col("i").asc()]).orderBy("row_index").collect()]
    assert got == sorted((v, i) for i, v in enumerate(values))
    assert "row-index-input" in inputs(spark, lambda: row_index(df, [F.col("v").asc()]))  # df comes from a shuffle
    places = [r.row_index for r in row_index(df, [F.col("v").asc()]).collect()]
    assert sorted(places) == list(range(3000))


def test_row_index_per_group(spark):
    rows = [("a" if i % 3 else None, i) for i in range(500)] + [("b", i) for i in range(20)]
    got = row_index(spark.createDataFrame(rows, "g string, i int").repartition(5), [F.col("i").asc()], "n", group="g")
    by_group = {}
    for r in got.collect():
        by_group.setdefault(r.g, []).append((r.i, r.n))
    for pairs in by_group.values():
        assert [n for _, n in sorted(pairs)] == list(range(len(pairs)))


def test_record_ids_ignore_partitioning(spark):
    schema = S.UNIFIED
    make = lambda kind, load: tuple({"record_type": kind, "load_id": load}.get(f.name) for f in schema.fields)
    rows = [make("load", str(i)) for i in range(50)] + [make("trip", str(i)) for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    ids = lambda d: sorted((r.record_id, r.load_id) for r in S.with_record_id(d).collect())
    assert ids(df.repartition(1)) == ids(df.repartition(6))


@pytest.mark.parametrize("target, pairs", [(10, 10**9), (1000, 10**9), (1000, 50), (7, 20)])
def test_balanced_join_equals_join(spark, target, pairs):
    random.seed(2)
    left = spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i) for i in range(300)], "k int, a int")
    right = spark.createDataFrame([(0 if i % 2 == 0 else i % 60, i) for i in range(200)], "k int, b int")
    got = balanced_join(left, right, "k", target_rows=target, target_pairs=pairs)
    want = left.join(right, "k")
    rows = lambda d: sorted((r.k, r.a, r.b) for r in d.collect())
    assert rows(got) == rows(want)


def test_balanced_join_spreads_a_hot_key(spark):
    left = stage(spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("a")), "left")
    right = stage(spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("b")), "right")
    joined = balanced_join(left, right, "k", target_rows=50, target_pairs=1000)
    parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 8 and sum(r["count"] for r in parts) == 40_000


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_per_group(df, ["g"], [F.desc("v")], 2)
    assert "WindowGroupLimit" in plan(top)
    assert sorted((r.g, r.v, r["rank"]) for r in top.collect())[:2] == [(0, 996, 2), (0, 999, 1)]


def test_top_n_is_a_bounded_take(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("n"), "id")
    best = top_n(df, [F.desc("n")], ["id"], 3)
    assert [r.id for r in best.collect()] == [9, 19, 29] and "TakeOrderedAndProject" in plan(best)


def test_many_ranks_of_a_hot_group(spark):
    df = spark.range(9000).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    top = top_per_group(df, ["g"], [F.desc("v")], 2500)
    assert sorted(r.v for r in top.collect()) == list(range(6500, 9000))
    assert "_slice" in plan(top)


def test_no_hot_key_means_a_plain_join(spark):
    left, right = spark.range(50).withColumnRenamed("id", "k"), spark.range(30).withColumnRenamed("id", "k")
    joined = balanced_join(left, right, "k")
    assert joined.count() == 30 and "explode" not in plan(joined).lower()

"""The stored vector index against the exact scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from midmile.operators import retrieval as R
from midmile.operators import vector_index as V

SCHEMA = "chunk_id long, embedding array<float>"


def table(spark, vectors, first=0):
    rows = [(first + k, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def asked(spark, vectors):
    return table(spark, vectors).withColumnRenamed("chunk_id", "query_id")


@pytest.fixture(scope="module")
def vectors():
    dice = np.random.default_rng(3)
    centers = dice.normal(size=(12, 8)) * 3
    rows = (centers[dice.integers(0, 12, 600)] + dice.normal(size=(600, 8)) * 0.4).astype("float32").tolist()
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 8, [0.0] * 8, None, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    return rows


@pytest.fixture(scope="module")
def queries(vectors):
    dice = np.random.default_rng(4)
    return vectors[:30] + dice.normal(size=(15, 8)).tolist() + [[0.0] * 8, None, vectors[603]]


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())


def exact(metric, queries, chunks, k):
    if metric == "cosine":
        return R.cosine_topk(queries, chunks, k)
    return R.l2_topk(queries, chunks, k).withColumn("score", -F.col("distance"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("k", [1, 5, 700])
def test_open_search_is_the_exact_scan(spark, tmp_path, vectors, queries, metric, k):
    clean = [v for v in vectors if v is None or np.isfinite(v).all()]
    chunks = table(spark, clean)
    index = V.build(chunks, str(tmp_path / "index"), lists=10, metric=metric)
    got = V.search(asked(spark, queries), V.load(spark, index.path), k)
    assert hits(got) == hits(exact(metric, asked(spark, queries), chunks, k))


def test_few_probes_find_most(spark, tmp_path, vectors, queries):
    chunks = table(spark, vectors[:600])
    index = V.build(chunks, str(tmp_path / "index"))
    some = asked(spark, queries[:40])
    found = V.recall(V.search(some, index, probes=3), R.cosine_topk(some, chunks))
    assert found.agg(F.avg("recall")).first()[0] >= 0.9
    assert found.count() == 40


def test_probes_are_tuned_by_exact_hits(spark, tmp_path, vectors, queries):
    chunks = table(spark, vectors[:600])
    index = V.build(chunks, str(tmp_path / "index"), lists=40)
    probes = V.tune(asked(spark, vectors[100:200]), index)
    some = asked(spark, queries[:45])
    assert probes < 40
    assert V.recall(V.search(some, index, probes=probes), R.cosine_topk(some, chunks)).agg(F.avg("recall")).first()[0] >= 0.9
    assert V.tune(asked(spark, vectors[:3]).where("false"), index) == 1


def test_vectors_without_numbers_are_left_out(spark, tmp_path, vectors):
    index = V.build(table(spark, vectors), str(tmp_path / "index"), lists=4)
    assert V.cells(spark, index).agg(F.sum("rows")).first()[0] == len(vectors) - 3


def test_a_search_reads_only_its_cells(spark, tmp_path, vectors, capsys):
    index = V.build(table(spark, vectors[:600]), str(tmp_path / "index"), lists=10)
    some = V.stored(spark, index, [2, 5])
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert {r.cell for r in some.select("cell").distinct().collect()} == {2, 5}


def test_batches_are_added_once(spark, tmp_path, vectors, queries):
    whole = table(spark, vectors[:600])
    index = V.build(table(spark, vectors[:400]), str(tmp_path / "index"), lists=9)
    V.add(index, table(spark, vectors[400:500], 400), 1)
    for _ in range(2):  # a repeated batch replaces itself
        V.add(index, table(spark, vectors[500:600], 500), 2)
    some = asked(spark, queries[:45])
    assert hits(V.search(some, index)) == hits(R.cosine_topk(some, whole))
    with pytest.raises(ValueError):
        V.add(index, whole, 0)


def test_a_batch_without_its_summary_is_not_there(spark, tmp_path, vectors):
    """A load that broke off before its end."""
    index = V.build(table(spark, vectors[:300]), str(tmp_path / "index"), lists=5)
    rows = spark.read.parquet(f"{index.path}/vectors/batch=0")
    rows.withColumn("chunk_id", F.col("chunk_id") + 10_000).write.partitionBy("cell").parquet(f"{index.path}/vectors/batch=7")
    got = V.search(asked(spark, vectors[:5]), index)
    assert got.where("chunk_id >= 10000").isEmpty() and got.count() == 25


def test_nothing_stored_or_asked(spark, tmp_path, vectors):
    empty = spark.createDataFrame([], SCHEMA)
    index = V.build(empty, str(tmp_path / "none"))
    assert V.search(asked(spark, vectors[:3]), index).count() == 0
    index = V.build(table(spark, vectors[:50]), str(tmp_path / "some"))
    assert V.search(empty.withColumnRenamed("chunk_id", "query_id"), index).count() == 0


def test_many_slices_and_blocks(spark, tmp_path, vectors, queries, monkeypatch):
    monkeypatch.setattr(V, "SLICE_ROWS", 40)
    monkeypatch.setattr(V, "QUERY_ROWS", 7)
    chunks = table(spark, vectors[:600])
    index = V.build(chunks, str(tmp_path / "index"), lists=3)
    some = asked(spark, queries[:45])
    assert hits(V.search(some, index)) == hits(R.cosine_topk(some, chunks))

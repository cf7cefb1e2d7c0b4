"""The stored keyword index against the plain ranking."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from midmile.operators import postings
from midmile.operators import retrieval as R
from midmile.runtime import stage


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    words = [f"w{int(300 * dice.random() ** 3)}" for _ in range(9000)]
    rows = [(k, " ".join(dice.choice(words) for _ in range(dice.randrange(1, 90))) + (" Passage of rare words " + str(k) if k % 40 == 0 else "")) for k in range(700)]
    return rows + [(700, None), (701, ""), (702, "--- ..."), (703, rows[5][1]), (704, rows[5][1]), (705, "w1 " * 20_000)]


@pytest.fixture(scope="module")
def asked():
    dice = random.Random(6)
    rows = [(k, " ".join(f"w{int(300 * dice.random() ** 2)}" for _ in range(dice.randrange(1, 40)))) for k in range(40)]
    return rows + [(50, "passage of RARE words"), (51, "no such thing"), (52, ""), (53, None), (54, "w1 w1 w2")]


def hits(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 7)) for r in df.collect())


def tables(spark, texts, asked):
    docs = spark.createDataFrame(texts, "chunk_id long, text_content string").withColumn("score", F.lit(1)).repartition(5)
    return docs, spark.createDataFrame(asked, "query_id long, query_text string").withColumn("word", F.lit("x"))


@pytest.mark.parametrize("k", [1, 5, 50])
def test_hits_of_the_plain_ranking(spark, tmp_path, texts, asked, k):
    docs, queries = tables(spark, texts, asked)
    index = postings.build(docs.select("chunk_id", "text_content"), str(tmp_path / "index"))
    assert hits(postings.search(queries, index, k)) == hits(R.bm25(queries, docs, k))


def test_small_blocks_and_other_constants(spark, tmp_path, texts, asked, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    docs, queries = tables(spark, texts, asked)
    index = postings.build(docs, str(tmp_path / "index"), k1=0.9, b=0.4, buckets=3)
    assert hits(postings.search(queries, index)) == hits(R.bm25(queries, docs, k1=0.9, b=0.4))


def test_most_postings_are_skipped(spark, tmp_path, texts):
    docs, queries = tables(spark, texts, [(1, "passage of rare words w0 w1 w2"), (2, "w0 w1 w2 w3 w250")])
    index = postings.build(docs, str(tmp_path / "index"))
    seen = Observation()
    found = postings.search(queries, index, seen=seen)
    words = spark.read.parquet(f"{index.path}/words")
    asked = queries.select("query_id", F.explode(F.split(F.lower("query_text"), " ")).alias("word"))
    every = asked.join(words, "word").agg(F.sum("df")).first()[0]
    assert found.count() == 10 and seen.get["postings"] < every / 4


def test_no_documents_or_queries(spark, tmp_path, texts, asked):
    docs, queries = tables(spark, texts, asked)
    index = postings.build(docs.where("false"), str(tmp_path / "none"))
    assert postings.search(queries, index).count() == 0
    postings.build(docs, str(tmp_path / "some"))
    index = postings.load(spark, str(tmp_path / "some"))
    assert postings.search(queries.where("false"), index).count() == 0


def test_postings_move_once_and_their_sums_never(spark, tmp_path, texts, asked, monkeypatch):
    docs, queries = tables(spark, texts, asked)
    plans = {}
    monkeypatch.setattr(postings, "stage", lambda df, name: plans.setdefault(name, []).append(df) or stage(df, name))
    index = postings.build(docs, str(tmp_path / "index"))
    assert "shares" not in plans and "tallies" not in plans  # no copy of the postings beside the index
    assert hits(postings.search(queries, index)) == hits(R.bm25(queries, docs))
    plan = plans["open-documents"][0]._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "chunk_id" in moved[0] and "query_id" not in moved[0]


def test_ids_that_repeat(spark, tmp_path):
    rows = [(1, "a b b c"), (1, "a b b c"), (1, "a d"), (None, "a e"), (None, "a e f"), (2, "b"), (3, "a f")]
    docs, queries = tables(spark, rows, [(1, "a b"), (2, "f d e")])
    index = postings.build(docs, str(tmp_path / "index"))
    found = hits(postings.search(queries, index))
    assert found and {h[2] for h in found} <= {1, 2, 3}

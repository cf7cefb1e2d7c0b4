import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from midmile.operators import graph as K
from midmile.operators import retrieval as R


def vectors(spark, n, dim, seed, key):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} int, embedding array<float>")


@pytest.mark.parametrize("query_bytes, tile_bytes", [(32 << 20, 32 << 20), (150, 300)])
@pytest.mark.parametrize("kind", ["cosine", "l2"])
def test_vector_topk_equals_brute_force(spark, monkeypatch, query_bytes, tile_bytes, kind):
    monkeypatch.setattr(R, "TILE_BYTES", tile_bytes)
    qs, queries = vectors(spark, 7, 8, 1, "query_id")
    cs, chunks = vectors(spark, 100, 8, 2, "chunk_id")
    copies = [(1000 + i, cs[5][1]) for i in range(30)]  # equal vectors: ties go to the smaller id
    chunks = chunks.unionByName(spark.createDataFrame(copies + [(5000, None)], chunks.schema)).repartition(4)
    found = (R.cosine_topk if kind == "cosine" else R.l2_topk)(queries, chunks, 5, query_bytes)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    f32 = lambda v: np.array(v, dtype="float32").astype("float64")
    for q, v in qs:
        def key(c):
            a, b = f32(v), f32(c[1])
            s = a @ b / np.linalg.norm(a) / np.linalg.norm(b) if kind == "cosine" else -np.linalg.norm(a - b)
            return (-round(float(s), 9), c[0])
        assert got[q] == [c[0] for c in sorted(cs + copies, key=key)[:5]]


def test_chunks_are_not_shuffled(spark, monkeypatch):
    _, queries = vectors(spark, 9, 4, 1, "query_id")
    _, chunks = vectors(spark, 20, 4, 2, "chunk_id")
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, staged = [], R.stage

    def seen(df, name):
        if name == "block-hits":
            plans.append(plan_of(df))
        return staged(df, name)

    monkeypatch.setattr(R, "stage", seen)
    last = plan_of(R.cosine_topk(queries, chunks, query_bytes=64))
    assert len(plans) > 1 and all("MapInPandas" in p and "Exchange" not in p and "Join" not in p for p in plans)
    assert "WindowGroupLimit" in last and "Join" not in last


def test_vectors_that_are_not_finite_are_no_hits(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    chunks = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 1.0])], "chunk_id int, embedding array<double>").coalesce(1)
    assert [r.chunk_id for r in R.cosine_topk(queries, chunks, 1).collect()] == [2]
    assert R.cosine_topk(queries.where("false"), chunks).count() == 0


def texts(n, seed):
    random.seed(seed)
    words = ["bridge", "Load", "limit", "route", "tion", "Bridges", "über", "the", "a", "of", "snow-fall", "x1", "clearance"]
    return [" \n".join(random.choices(words, k=random.randrange(0, 12))) for _ in range(n)]


def test_keyword_fallback_equals_brute_force(spark):
    docs = [(i, random.Random(i).choice("abc"), t) for i, t in enumerate(texts(200, 6))]
    asked = [(0, "is the bridge safe"), (1, "a of an"), (2, "OAD LIMIT ridg zzzz"), (3, "nothing matches qqqq"), (4, "snow-fall clear"), (5, "")]
    queries = spark.createDataFrame(asked, "query_id int, query_text string")
    hits = spark.createDataFrame([(4,)], "query_id int")
    d = spark.createDataFrame(docs, "chunk_id int, record_type string, text_content string")
    got = {}
    for r in R.keyword_fallback(queries, d, hits).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    want = {}
    for q, text in asked:
        kws = [w.lower() for w in text.split() if len(w) >= 4][:6]
        match = [(t, i) for i, t, body in docs if not kws or any(k in body.lower() for k in kws)]
        if q != 4 and match:
            want[q] = [i for _, i in sorted(match)[:5]]
    assert got == want


def test_keyword_match(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts(50, 7))], "id int, t string")
    assert R.keyword_match(d, "t", "a of").count() == 50
    want = sum("rout" in t.lower() for t in texts(50, 7))
    assert R.keyword_match(d, "t", "the ROUT").count() == want


@pytest.mark.parametrize("block, slice_rows", [(256, 1_000_000), (2, 40)])
def test_bm25_equals_brute_force(spark, block, slice_rows):
    import math
    import re

    docs = list(enumerate(texts(80, 8)))
    asked = [(0, "bridge limit"), (1, "über the the snow"), (2, "zzz"), (3, "load load x1"), (4, "route of a clearance")]
    q = spark.createDataFrame(asked, "query_id int, query_text string")
    d = spark.createDataFrame(docs, "chunk_id int, text_content string")
    got = {}
    for r in R.bm25(q, d, 4, block=block, slice_rows=slice_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    bags = {i: words(t) for i, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    want = {}
    for qid, text in asked:
        scored = []
        for i, bag in bags.items():
            s = 0.0
            for w in set(words(text)):
                tf, df = bag.count(w), sum(w in x for x in bags.values())
                if tf:
                    s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))
            if s > 0:
                scored.append((-round(s, 9), i))
        if scored:
            want[qid] = [(i, round(-s, 6)) for s, i in sorted(scored)[:4]]
    assert got == want


def test_fusion(spark):
    lists = {
        "dense": spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int"),
        "sparse": spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int"),
    }
    merged = {r.chunk_id: (r.rank_dense, r.rank_sparse) for r in R.merge_rank_lists(lists).collect()}
    assert merged == {10: (1, None), 11: (2, 1), 12: (None, 2)}
    fused = [(r.chunk_id, r["rank"]) for r in R.rrf(lists, {"dense": 0.4, "sparse": 0.2}).orderBy("rank").collect()]
    assert fused == [(11, 1), (10, 2), (12, 3)]


def test_evidence_block_and_prompt(spark):
    queries = spark.createDataFrame([(1, " why? "), (2, "what?")], "query_id int, query_text string")
    hits = spark.createDataFrame(
        [(1, 1, "load", "c7", " one\r\ntwo \n", 0.51234), (1, 2, "trip", "c8", "  ", 0.0)],
        "query_id int, rank int, record_type string, chunk_id string, text_content string, score double",
    )
    blocks = {r.query_id: r.block for r in R.evidence_block(queries, hits).collect()}
    assert blocks[1] == "[RETRIEVED CONSTRAINTS]\n1. load | c7 (score: 0.5123)\n   one\n   two\n2. trip | c8\n[END RETRIEVED CONSTRAINTS]"
    assert blocks[2].split("\n")[1] == R.BLOCK_EMPTY
    prompts = R.prompt_table(queries, R.evidence_block(queries, hits), " Role. ").where("query_id = 1").first().prompt
    assert prompts.startswith("Role.\n\n[RETRIEVED") and prompts.endswith("User Query: why?\n")


def test_strategy_prompts(spark):
    queries = spark.createDataFrame([(1, "Q", None), (2, "Q2", "E")], "query_id int, query_text string, evidence string")
    examples = spark.createDataFrame([(i, f"i{i}", "c", f"o{i}") for i in range(5)], "example_id int, instruction string, context string, output string")
    got = {(r.query_id, r.strategy): r.prompt for r in R.strategy_prompts(queries, examples).collect()}
    assert len(got) == 8
    assert got[1, "plain"] == "Instruction: Q\nOutput:\n" and "Context: E\n" in got[2, "plain"]
    assert "o1" in got[1, "chains"] and "o2" not in got[1, "chains"]
    assert "--- Example 3 ---\nQuery: i2" in got[1, "few"] and "o3" not in got[1, "few"]
    none = R.strategy_prompts(queries, examples.where("example_id < 0")).where("strategy = 'few'").first().prompt
    assert "Example 1" not in none


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 17, 18, 100])
def test_token_chunks_cover_the_text(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(1, " \n".join(words))], "doc_id int, text string")
    parts = [r.text_content.split() for r in R.token_chunks(df, 10, 3).orderBy("chunk_no").collect()]
    joined = parts[0] if parts else []
    for a, b in zip(parts, parts[1:]):
        assert a[-3:] == b[:3] and len(a) == 10
        joined = joined + b[3:]
    assert joined == words


def test_expand_equals_breadth_first(spark):
    random.seed(9)
    edges = {(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(70)} | {("n0", f"n{i}") for i in range(1, 30)}
    e = spark.createDataFrame([(a, b, "k") for a, b in edges], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("n0",), ("n5",), ("alone",)], "node_id string")
    got = {(r.seed, r.node): (r.hop, r.path) for r in K.expand(seeds, e, 3).collect()}
    want = {}
    for s in ("n0", "n5", "alone"):
        layer, seen = {s: s}, {s: (0, s)}
        for hop in (1, 2, 3):
            new = {}
            for node, path in layer.items():
                for a, b in edges:
                    if a == node and b not in seen:
                        new[b] = min(new.get(b, path + ">" + b), path + ">" + b)
            seen |= {n: (hop, p) for n, p in new.items()}
            layer = new
        want |= {(s, n): v for n, v in seen.items()}
    assert got == want


def test_majority_and_ties(spark):
    v = spark.createDataFrame([(1, "B"), (1, "A"), (1, "B"), (2, "Y"), (2, "X")], "query_id int, answer string")
    got = {r.query_id: (r.answer, r.votes, round(r.confidence, 4)) for r in R.majority_vote(v).collect()}
    assert got == {1: ("B", 2, 0.6667), 2: ("X", 1, 0.5)}


def test_training_text(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (1, 3, "user", "lost"), (2, 0, "user", "u"), (2, 1, "assistant", "a")],
        "conv_id int, turn int, role string, text string",
    )
    got = {r.conv_id: r.text for r in R.training_text(R.training_pairs(turns)).collect()}
    assert got == {1: "Instruct: U\nContext: S\nOutput:\nA", 2: "Instruct: u\nOutput:\na"}


def test_embed_text(spark):
    df = spark.createDataFrame([(1, "Bridge limit"), (2, "limit  BRIDGE"), (3, "snow")], "id int, t string")
    e = {r.id: np.array(r.embedding) for r in R.embed_text(df, "t").collect()}
    assert len(e[1]) == 768 and abs(np.linalg.norm(e[1]) - 1) < 1e-6
    assert np.allclose(e[1], e[2]) and not np.allclose(e[1], e[3])


def test_bundle_lists_only_sources_with_rows(spark):
    heat = spark.createDataFrame([("s", "c", 5, 2.0)], "state string, city string, incident_count int, avg_severity double")
    bridges = spark.createDataFrame([], "bridge_id int")
    chunks = spark.createDataFrame([(i, "t") for i in range(9)], "chunk_id int, text_content string")
    bundle = R.evidence_bundle(heat, bridges, chunks)
    assert bundle.count() == 6
    assert R.bundle_sources(bundle).first().grounding_sources == "accident_risk,logistics_data"


def test_graph_hits_leave_out_seeds_and_rank_by_hops(spark):
    seeds = spark.createDataFrame([(1, "truck:1"), (1, "truck:2"), (2, "truck:9")], "query_id int, node_id string")
    edges = spark.createDataFrame([("truck:1", "load:1"), ("load:1", "truck:2"), ("load:1", "truck:4"), ("truck:4", "truck:3")], "src string, dst string")
    walk = K.expand(seeds.where("node_id <> 'truck:9'").select("node_id"), edges)
    chunks = spark.createDataFrame([(i, f"truck:{i}") for i in range(1, 6)], "chunk_id int, node_id string")
    got = [(r.query_id, r.chunk_id, r.hop, r.path, r["rank"]) for r in K.graph_hits(seeds, walk, chunks).orderBy("rank").collect()]
    assert got == [(1, 4, 2, "truck:1>load:1>truck:4", 1), (1, 3, 3, "truck:1>load:1>truck:4>truck:3", 2)]


def test_graph_has_every_kind_of_edge_and_scores(spark):
    ops = spark.createDataFrame(
        [("l1", "c1", "t1", "d1", None, None), ("l1", "c1", "t1", "d1", "f1", "r9"), (None, None, "t2", None, None, None)],
        "load_id string, customer_id string, truck_id string, driver_id string, facility_id string, route_id string",
    )
    cities = spark.createDataFrame([("S", "A", 0.25), ("S", "B", 0.75), (None, "C", 0.5)], "state string, city string, risk_score double")
    one = lambda row, schema: spark.createDataFrame([row], schema)
    nodes, edges = K.build_graph(
        ops, cities, one((5,), "bridge_id int"), one((7,), "route_id int"), one((3,), "station int"),
        one((7, 5), "route_id int, bridge_id int"), one((7, "S", "A"), "route_id int, state string, city string"), one((7, 3), "route_id int, station int"),
    )
    got = sorted(tuple(r) for r in edges.collect())
    assert got == sorted([
        ("customer:c1", "load:l1", "customer_has_load"), ("load:l1", "truck:t1", "load_on_truck"), ("load:l1", "driver:d1", "load_by_driver"),
        ("driver:d1", "truck:t1", "driver_assigned_to"), ("truck:t1", "load:l1", "truck_on_trip"), ("state:S", "city:S/A", "state_has_city"),
        ("state:S", "city:S/B", "state_has_city"), ("route:7", "city:S/A", "route_passes_through"), ("bridge:5", "route:7", "bridge_on_route"),
        ("station:3", "route:7", "weather_affects"),
    ])
    scores = {r.node_id: r.risk_score for r in nodes.collect()}
    assert nodes.count() == len(scores) == 13
    assert {k: v for k, v in scores.items() if v is not None} == {"state:S": 0.75, "city:S/A": 0.25, "city:S/B": 0.75, "route:7": 0.25}

"""Registered queries for retrieval, prompts, text, the graph and their figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from midmile.operators import analytics as A
from midmile.operators import adjacency, graph, metrics, spatial
from midmile.operators import retrieval as R
from midmile.operators import silver as S
from midmile.plans.oracle import near_route
from midmile.plans.registry import register
from midmile.plans.views import Views
from midmile.runtime import release, stage

BASE = "You are a freight routing expert."


def _queries(v: Views):
    """One query per label: the mean of its vectors."""
    dims = v.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = dims.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"])  # one entry per dimension
    return means.groupBy(F.col("label").alias("query_id")).agg(vector.alias("embedding"))


def _chunks(v: Views):
    return v.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _cosine(v: Views):
    return R.cosine_topk(_queries(v), _chunks(v))


@register("r1_cosine_topk", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM cosine_hits")
def _(v: Views):
    return _cosine(v).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("r2_l2_topk", "SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM l2_hits")
def _(v: Views):
    return R.l2_topk(_queries(v), _chunks(v)).select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@register("w3_rank_hits", """SELECT query_id, chunk_id, rank FROM (SELECT o_custkey AS query_id, o_orderkey AS chunk_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) x WHERE rank <= 5""")
def _(v: Views):
    scored = v.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    return R.rank_hits(scored).drop("score")


@register("r3_embed_text", "SELECT doc_id, 768 AS dim, 1.0e0 AS norm FROM documents WHERE length(trim(text)) > 0")
def _(v: Views):
    texts = v.documents.where(F.length(F.trim("text")) > 0).select("doc_id", "text")
    vectors = R.embed_text(texts, "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select("doc_id", F.size("embedding").alias("dim"), F.round(F.sqrt(square), 4).alias("norm"))


def _fallback(v: Views):
    """User turns as questions; turns whose conversation is a label already have vector hits."""
    asked = v.conversations.where("role = 'user'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query_text")
    )
    hits = _cosine(v).select((F.col("query_id").cast("long") * 100).alias("query_id")).distinct()
    docs = v.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("record_type"), F.col("text").alias("text_content"))
    return R.keyword_fallback(asked, docs, hits)


@register(
    "r4_keyword_fallback",
    r"""SELECT query_id, record_type, chunk_id, rank, 0.0e0 AS score FROM (SELECT query_id, d.lang AS record_type, d.doc_id AS chunk_id,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY d.lang, d.doc_id) AS INTEGER) AS rank FROM (SELECT conv_id * 100 + turn AS query_id,
        [lower(w) FOR w IN [w FOR w IN regexp_split_to_array(text, '\s+') IF length(w) >= 4][1:6]] AS kw
        FROM conversations WHERE role = 'user' AND conv_id * 100 + turn NOT IN (SELECT query_id * 100 FROM cosine_hits)) q,
        (SELECT doc_id, lang, lower(text) AS t FROM documents) d
        WHERE len(kw) = 0 OR len([w FOR w IN kw IF contains(d.t, w)]) > 0) x WHERE rank <= 5""",
)
def _(v: Views):
    return _fallback(v)


def _described_hits(v: Views):
    """Vector hits with the text that belongs to the chunk."""
    texts = v.documents.select(F.col("doc_id").alias("chunk_id"), "lang", F.col("text").alias("text_content"))
    return _cosine(v).join(texts, "chunk_id").withColumnRenamed("lang", "record_type")


_BLOCKS = r"""SELECT query_id, '[RETRIEVED CONSTRAINTS]' || chr(10) || coalesce(lines, '(No relevant logistics records found for this query.)')
    || chr(10) || '[END RETRIEVED CONSTRAINTS]' AS block FROM (SELECT c.query_id, string_agg(rank || '. ' || lang || ' | ' || chunk_id
    || CASE WHEN score > 0 THEN ' (score: ' || printf('%.4f', score) || ')' ELSE '' END
    || CASE WHEN length(body) > 0 THEN chr(10) || '   ' || regexp_replace(body, '\r\n|[\n\r]', chr(10) || '   ', 'g') ELSE '' END,
    chr(10) ORDER BY rank) AS lines FROM centroids c LEFT JOIN (SELECT h.*, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body
    FROM cosine_hits h JOIN documents d ON d.doc_id = h.chunk_id) x ON x.query_id = c.query_id GROUP BY 1) q"""


@register("r5_evidence_block", _BLOCKS)
def _(v: Views):
    return R.evidence_block(_queries(v), _described_hits(v))


@register(
    "r6_prompt_table",
    f"""SELECT query_id, '{BASE}' || chr(10) || chr(10) || block || chr(10) || chr(10) || '{R.GROUNDING}' || chr(10) || chr(10) || 'User Query: Which records are like group '
        || query_id || '?' || chr(10) AS prompt FROM ({_BLOCKS}) b""",
)
def _(v: Views):
    queries = _queries(v).withColumn("query_text", F.concat(F.lit("Which records are like group "), F.col("query_id").cast("string"), F.lit("?")))
    return R.prompt_table(queries, R.evidence_block(queries, _described_hits(v)), BASE)


_EXAMPLE = "'Query: ' || instruction || chr(10) || 'Evidence: ' || context || chr(10) || '{0}: ' || output"


@register(
    "r7_strategy_prompts",
    f"""SELECT query_id, strategy, length(prompt) AS n_chars, md5(prompt) AS digest FROM (
        SELECT query_id, 'plain' AS strategy, 'Instruction: ' || q || chr(10) || CASE WHEN e <> '' THEN 'Context: ' || e || chr(10) ELSE '' END || 'Output:' || chr(10) AS prompt FROM asked
        UNION ALL SELECT query_id, 'chains', concat_ws(chr(10) || chr(10), '{R.CHAINS_ROLE}', '{R.CRITERIA}', (SELECT string_agg({_EXAMPLE.format('Correct Output')}, chr(10) || chr(10) ORDER BY example_id) FROM shown WHERE rn <= 2),
          'Query: ' || q || chr(10) || 'Evidence: ' || e, 'Chain 1:') FROM asked
        UNION ALL SELECT query_id, 'act', concat_ws(chr(10) || chr(10), '{R.ACT_ROLE}', '{R.CRITERIA}', 'Query: ' || q || chr(10) || 'Evidence: ' || e,
          'Thought: which route is affected?' || chr(10) || 'Action: ASSESS_DISRUPTION') FROM asked
        UNION ALL SELECT query_id, 'few', concat_ws(chr(10) || chr(10), '{R.FEW_ROLE}', '{R.CRITERIA}', (SELECT string_agg('--- Example ' || rn || ' ---' || chr(10) || {_EXAMPLE.format('Decision')}, chr(10) || chr(10) ORDER BY example_id) FROM shown WHERE rn <= 3),
          '--- Current Task ---', 'Query: ' || q || chr(10) || 'Evidence: ' || e, 'Decision:') FROM asked) p""",
)
def _(v: Views):
    queries = v.benchmark.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"),
        F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("evidence"),
    )
    pairs = R.training_pairs(v.conversations)
    examples = pairs.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("example_id"), "instruction", F.coalesce("context", F.lit("")).alias("context"), "output"
    )
    prompts = R.strategy_prompts(queries, examples)
    return prompts.select("query_id", "strategy", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("digest"))


@register(
    "r8_evidence_bundle",
    """SELECT 'accident_risk' AS source, rank, state || '/' || city AS item, 'accident_risk,bridge_data,logistics_data' AS sources FROM (
         SELECT *, CAST(row_number() OVER (ORDER BY incident_count DESC, state, city) AS INTEGER) AS rank FROM heat_city) h WHERE rank <= 5
       UNION ALL SELECT 'bridge_data', rank, CAST(bridge_id AS VARCHAR), 'accident_risk,bridge_data,logistics_data' FROM (
         SELECT bridge_id, CAST(row_number() OVER (ORDER BY bridge_id) AS INTEGER) AS rank FROM bridges) b WHERE rank <= 5
       UNION ALL SELECT 'logistics_data', rank, CAST(doc_id AS VARCHAR), 'accident_risk,bridge_data,logistics_data' FROM (
         SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank FROM documents) d WHERE rank <= 5""",
)
def _(v: Views):
    chunks = v.documents.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("record_type"), F.col("text").alias("text_content"))
    bundle = R.evidence_bundle(A.heatmap_by_city(A.risk_heatmap(v.accidents)), v.bridges, chunks)
    field = lambda k: F.get_json_object("item", f"$.{k}")
    item = F.coalesce(F.concat_ws("/", field("state"), field("city")), F.lit(""))
    named = F.when(F.col("source") == "accident_risk", item).when(F.col("source") == "bridge_data", field("bridge_id")).otherwise(field("chunk_id"))
    return bundle.select("source", "rank", named.alias("item"), R.bundle_sources(bundle).scalar().alias("sources"))


def _bm25(v: Views):
    asked = v.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    docs = v.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("text_content"))
    return R.bm25(asked, docs)


@register("r9_bm25", "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm_hits")
def _(v: Views):
    return _bm25(v).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register(
    "r11_token_chunks",
    r"""SELECT doc_id, chunk_no, len(part) AS n_tokens, md5(array_to_string(part, ' ')) AS digest FROM (
        SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, w[chunk_no * 448 + 1 : chunk_no * 448 + 512] AS part FROM (
          SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 512) / 448.0e0)) AS BIGINT) + 1)) AS chunk_no FROM (
            SELECT doc_id, [t FOR t IN regexp_split_to_array(text, '\s+') IF t <> ''] AS w FROM documents) a WHERE len(w) > 0) b) c""",
)
def _(v: Views):
    chunks = R.token_chunks(v.documents)
    return chunks.select("doc_id", "chunk_no", F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("text_content").alias("digest"))


def _graph(v: Views):
    ops = S.union_records(v.ops_parts)
    routes = spatial.with_route_points(v.routes)
    cities = stage(A.risk_score(A.heatmap_by_city(A.risk_heatmap(v.accidents))), "city-scores")
    places = v.accidents.select("state", "city", "start_lat", "start_lng").distinct()
    places = stage(places.withColumn("place", F.struct("state", "city", "start_lat", "start_lng")), "places")
    passed = spatial.corridor_join(routes, places, 5000.0, point_id="place", lat="start_lat", lon="start_lng")
    passed = stage(passed.select("route_id", "state", "city").distinct(), "route-cities")
    alerted = S.active_alerts(S.weather_alerts(v.weather)).select("station").distinct()
    alerting = stage(v.stations.join(alerted, "station", "left_semi"), "alerting-stations")
    near = spatial.corridor_pairs(routes, alerting, 100_000.0, point_id="station")
    bridges = spatial.corridor_pairs(routes, v.bridges, 500.0)
    return graph.build_graph(ops, cities, v.bridges, v.routes, v.stations, bridges, passed, near, single=True)


_SCORED = """SELECT state, city, 0.5e0 * (incident_count - min(incident_count) OVER ()) / (max(incident_count) OVER () - min(incident_count) OVER ())
    + 0.5e0 * (avg_severity - min(avg_severity) OVER ()) / (max(avg_severity) OVER () - min(avg_severity) OVER ()) AS score FROM heat_city"""
_PASSED = f"SELECT DISTINCT route_id, state, city FROM ({near_route('accidents', 'start_lat', 'start_lng', 5000.0)}) pa"
_NODES = " UNION ".join(
    [f"SELECT '{k}:' || {k}_id AS node_id, '{k}' AS node_type FROM ops_union WHERE {k}_id IS NOT NULL" for k in "load customer truck driver facility route".split()]
    + ["SELECT 'city:' || state || '/' || city, 'city' FROM accidents", "SELECT 'state:' || state, 'state' FROM accidents", "SELECT 'bridge:' || bridge_id, 'bridge' FROM bridges",
       "SELECT 'route:' || route_id, 'route' FROM routes", "SELECT 'station:' || station, 'station' FROM stations"]
)
_NODE_SCORES = f"""SELECT id, max(score) AS score FROM (SELECT 'city:' || state || '/' || city AS id, score FROM ({_SCORED}) a UNION ALL SELECT 'state:' || state, score FROM ({_SCORED}) b
    UNION ALL SELECT 'route:' || route_id, score FROM ({_PASSED}) p JOIN ({_SCORED}) c ON c.state = p.state AND c.city = p.city) s GROUP BY 1"""
_OPS_EDGES = " UNION ".join(
    f"SELECT '{a}:' || {a}_id AS src, '{b}:' || {b}_id AS dst, '{k}' AS kind FROM ops_union WHERE {a}_id IS NOT NULL AND {b}_id IS NOT NULL"
    for a, b, k in [("customer", "load", "customer_has_load"), ("load", "truck", "load_on_truck"), ("load", "driver", "load_by_driver"),
                    ("driver", "truck", "driver_assigned_to"), ("truck", "load", "truck_on_trip")]
)
_EDGES = " UNION ".join(
    [
        _OPS_EDGES,
        "SELECT 'state:' || state, 'city:' || state || '/' || city, 'state_has_city' FROM accidents",
        f"SELECT 'route:' || route_id, 'city:' || state || '/' || city, 'route_passes_through' FROM ({_PASSED}) p",
        "SELECT 'bridge:' || bridge_id, 'route:' || route_id, 'bridge_on_route' FROM hits",
        f"""SELECT 'station:' || station, 'route:' || route_id, 'weather_affects' FROM ({near_route('stations', 'latitude', 'longitude', 100000.0)}) ns
            WHERE station IN (SELECT station FROM alerts WHERE weather_alert <> 'Normal conditions')""",
    ]
)


@register("r12_graph_nodes", f"SELECT n.*, round(score, 8) AS risk_score FROM ({_NODES}) n LEFT JOIN ({_NODE_SCORES}) s ON s.id = node_id")
def _(v: Views):
    return _graph(v)[0].withColumn("risk_score", F.round("risk_score", 8))


@register("r12_graph_edges", _EDGES)
def _(v: Views):
    return _graph(v)[1]


@register(
    "r13_expand",
    f"""SELECT seed, hop, count(*) AS reached, min(path) AS first_path, max(path) AS last_path, sum(length(path)) :: BIGINT AS path_chars
        FROM (WITH e AS (SELECT DISTINCT src, dst FROM ({_EDGES}) x),
        h0 AS (SELECT node_id AS seed, node_id AS node, node_id AS path FROM ({_NODES}) n WHERE node_type IN ('customer', 'state')),
        h1 AS (SELECT seed, dst AS node, min(path || '>' || dst) AS path FROM h0 JOIN e ON e.src = node WHERE dst <> seed GROUP BY 1, 2),
        h2 AS (SELECT h1.seed, dst AS node, min(h1.path || '>' || dst) AS path FROM h1 JOIN e ON e.src = node WHERE dst <> h1.seed
          AND NOT EXISTS (SELECT 1 FROM h1 k WHERE k.seed = h1.seed AND k.node = e.dst) GROUP BY 1, 2)
        SELECT 0 AS hop, seed, node, path FROM h0 UNION ALL SELECT 1, seed, node, path FROM h1
        UNION ALL SELECT 2, seed, node, path FROM h2) w GROUP BY 1, 2""",
)
def _(v: Views):
    nodes, edges = _graph(v)
    links = stage(graph.onward(edges, ["customer", "state"], 2).select("src", "dst"), "edges")
    walked = graph.expand(nodes.where(F.col("node_type").isin("customer", "state")), links, hops=2)
    release(links)
    return walked.groupBy("seed", "hop").agg(
        F.count("*").alias("reached"), F.min("path").alias("first_path"), F.max("path").alias("last_path"),
        F.sum(F.length("path")).alias("path_chars"),
    )


def _truck(key: str):
    """The record that a chunk describes: the truck of its number."""
    return F.concat(F.lit("truck:"), F.col(key).cast("string"))


def _seeds(v: Views, dense=None):
    """Trucks of the chunks most like each query."""
    dense = _cosine(v) if dense is None else dense
    return stage(dense.select("query_id", _truck("chunk_id").alias("node_id")), "seeds")


def _walk_from(v: Views, seeds):
    """Three hops from all seeds that are nodes. Trucks reach loads, trucks and drivers only, so the records' edges are enough."""
    ops = S.union_records(v.ops_parts)
    trucks = ops.where("truck_id IS NOT NULL").select(_truck("truck_id").alias("node_id"))
    known = seeds.select("node_id").distinct().join(trucks, "node_id", "left_semi")
    return graph.expand(known, adjacency.record_edges(ops))


# An edge leads from any type of node; trucks reach loads, trucks and drivers only.
_WALK = f"""WITH e AS (SELECT DISTINCT src, dst FROM ({_OPS_EDGES}) x),
    h0 AS (SELECT DISTINCT 'truck:' || chunk_id AS seed, 'truck:' || chunk_id AS node, 'truck:' || chunk_id AS path FROM cosine_hits
      WHERE 'truck:' || chunk_id IN (SELECT 'truck:' || truck_id FROM ops_union)),
    h1 AS (SELECT seed, dst AS node, min(path || '>' || dst) AS path FROM h0 JOIN e ON e.src = node WHERE dst <> seed GROUP BY 1, 2),
    h2 AS (SELECT h1.seed, dst AS node, min(h1.path || '>' || dst) AS path FROM h1 JOIN e ON e.src = node WHERE dst <> h1.seed
      AND NOT EXISTS (SELECT 1 FROM h1 k WHERE k.seed = h1.seed AND k.node = e.dst) GROUP BY 1, 2),
    h3 AS (SELECT h2.seed, dst AS node, min(h2.path || '>' || dst) AS path FROM h2 JOIN e ON e.src = node WHERE dst <> h2.seed
      AND NOT EXISTS (SELECT 1 FROM h1 k WHERE k.seed = h2.seed AND k.node = e.dst)
      AND NOT EXISTS (SELECT 1 FROM h2 k WHERE k.seed = h2.seed AND k.node = e.dst) GROUP BY 1, 2)
    SELECT 0 AS hop, seed, node, path FROM h0 UNION ALL SELECT 1, seed, node, path FROM h1
    UNION ALL SELECT 2, seed, node, path FROM h2 UNION ALL SELECT 3, seed, node, path FROM h3"""


@register("r13_expand_similar", f"SELECT * FROM ({_WALK}) w")
def _(v: Views):
    return _walk_from(v, _seeds(v))


_GRAPH_HITS = f"""SELECT * FROM (SELECT query_id, chunk_id, way.hop AS hop, way.path AS path,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY way.hop, chunk_id) AS INTEGER) AS rank FROM (
      SELECT h.query_id, vec_id AS chunk_id, min(struct_pack(hop := w.hop, path := w.path)) AS way FROM cosine_hits h
      JOIN ({_WALK}) w ON w.seed = 'truck:' || h.chunk_id JOIN embeddings c ON 'truck:' || vec_id = w.node WHERE w.hop > 0
      AND NOT EXISTS (SELECT 1 FROM cosine_hits o WHERE o.query_id = h.query_id AND o.chunk_id = c.vec_id) GROUP BY 1, 2) b) r WHERE rank <= 5"""


def _graph_hits(v: Views, dense=None):
    seeds = _seeds(v, dense)
    chunks = _chunks(v).select("chunk_id", _truck("chunk_id").alias("node_id"))
    return graph.graph_hits(seeds, _walk_from(v, seeds), chunks)


@register("r10_graph_hits", _GRAPH_HITS)
def _(v: Views):
    return _graph_hits(v)


def _three_lists(v: Views):
    """Dense, sparse and graph hits of every query; its words are those of the benchmark item of its number."""
    asked = v.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    asked = asked.join(v.embeddings.select(F.col("label").alias("query_id")).distinct(), "query_id", "left_semi")
    docs = v.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("text_content"))
    dense = stage(_cosine(v), "dense-hits")
    return {"dense": dense, "sparse": R.bm25(asked, docs), "graph": _graph_hits(v, dense)}


WEIGHTS = {"dense": 0.4, "sparse": 0.2, "graph": 0.4}  # fixed values

_MERGED = f"""SELECT query_id, chunk_id, min(rank) FILTER (WHERE l = 'dense') AS rank_dense, min(rank) FILTER (WHERE l = 'sparse') AS rank_sparse,
    min(rank) FILTER (WHERE l = 'graph') AS rank_graph FROM (SELECT query_id, chunk_id, rank, 'dense' AS l FROM cosine_hits
    UNION ALL SELECT query_id, chunk_id, rank, 'sparse' FROM bm_hits WHERE query_id IN (SELECT label FROM embeddings)
    UNION ALL SELECT query_id, chunk_id, rank, 'graph' FROM ({_GRAPH_HITS}) g) u GROUP BY 1, 2"""


@register("j8_merge_rank_lists", _MERGED)
def _(v: Views):
    return R.merge_rank_lists(_three_lists(v))


@register(
    "r10_rrf",
    f"""SELECT query_id, chunk_id, round(score, 10) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
        SELECT query_id, chunk_id, round(coalesce(0.4e0 / (60 + rank_dense), 0) + coalesce(0.2e0 / (60 + rank_sparse), 0) + coalesce(0.4e0 / (60 + rank_graph), 0), 12) AS score
        FROM ({_MERGED}) m) s) r WHERE rank <= 5""",
)
def _(v: Views):
    return R.rrf(_three_lists(v), WEIGHTS).withColumn("score", F.round("score", 10))


@register(
    "r14_majority_vote",
    """SELECT query_id, answer, n AS votes, n / CAST(total AS DOUBLE) AS confidence FROM (SELECT query_id, answer, count(*) AS n,
       sum(count(*)) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, answer) AS rn
       FROM votes GROUP BY 1, 2) x WHERE rn = 1""",
)
def _(v: Views):
    return R.majority_vote(v.votes)


@register(
    "r15_training_text",
    """SELECT conv_id, turn, md5('Instruct: ' || instruction || chr(10) || CASE WHEN coalesce(context, '') <> '' THEN 'Context: ' || context || chr(10) ELSE '' END
       || 'Output:' || chr(10) || output) AS digest FROM pairs_text""",
)
def _(v: Views):
    return R.training_text(R.training_pairs(v.conversations)).select("conv_id", "turn", F.md5("text").alias("digest"))


@register(
    "e2_retrieval_metrics",
    """SELECT t.query_id, coalesce(good, 0) / CAST(n_truth AS DOUBLE) AS recall_at_k, coalesce(1.0e0 / first_good, 0) AS reciprocal_rank,
       round(coalesce(dcg, 0) / ideal, 9) AS ndcg_at_k, coalesce(good / CAST(n AS DOUBLE), 0) AS attribution FROM (
         SELECT label AS query_id, count(*) AS n_truth, list_sum([1 / log2(i + 1) FOR i IN range(1, least(count(*), 5) + 1)]) AS ideal
         FROM embeddings GROUP BY 1) t LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE label = query_id) AS good,
         min(rank) FILTER (WHERE label = query_id) AS first_good, sum(CASE WHEN label = query_id THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
         FROM cosine_hits GROUP BY 1) h ON h.query_id = t.query_id""",
)
def _(v: Views):
    truth = v.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("chunk_id"))
    return metrics.retrieval_metrics(_cosine(v), truth).withColumn("ndcg_at_k", F.round("ndcg_at_k", 9))


_LCS = r"""WITH RECURSIVE ab AS (SELECT row_number() OVER () AS id, conv_id, turn, [t FOR t IN regexp_split_to_array(lower(instruction), '\s+') IF t <> ''] AS a,
      [t FOR t IN regexp_split_to_array(lower(output), '\s+') IF t <> ''] AS b FROM pairs_text),
    fold AS (SELECT id, a, b, 0 AS k, [0 FOR i IN a] AS best FROM ab WHERE len(a) > 0
      UNION ALL SELECT id, a, b, k + 1, [list_max(met[1:i]) FOR i IN range(1, len(a) + 1)] FROM (
        SELECT id, a, b, k, [greatest(best[j], CASE WHEN a[j] = b[k + 1] THEN coalesce(best[j - 1], 0) + 1 ELSE 0 END) FOR j IN range(1, len(a) + 1)] AS met
        FROM fold WHERE k < len(b)) m)
    SELECT conv_id, turn, CASE WHEN len(ab.a) = 0 OR len(ab.b) = 0 THEN 0 ELSE 2.0e0 * best[-1] / (len(ab.a) + len(ab.b)) END AS f1
    FROM ab LEFT JOIN fold ON fold.id = ab.id AND k = len(ab.b)"""


@register("e3_rouge_l", f"SELECT conv_id, turn, round(f1, 9) AS rouge_l FROM ({_LCS}) l")
def _(v: Views):
    pairs = R.training_pairs(v.conversations)
    scored = metrics.rouge_l(pairs, "output", "instruction")
    return scored.select("conv_id", "turn", F.round("rouge_l", 9).alias("rouge_l"))

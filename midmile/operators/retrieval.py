"""Evidence for many queries at once: vector and keyword ranking, fusion, prompts, chunks.

Vector scoring multiplies Arrow batches of chunks with a block of queries and keeps the
best ``k`` per query of every task, so only those rows are ever shuffled. Queries travel
in blocks of bounded bytes; chunks stay where they are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions.columns import contains_ci
from midmile.operators.ranking import balanced_join, top_per_group
from midmile.runtime import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package

QUERY_BYTES = 32 << 20  # query vectors that travel with a task at a time
TILE_BYTES = 32 << 20  # scores that a task holds at a time
DECIMALS = 9  # scores are ranked after rounding, so equal vectors tie exactly

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _cosine(chunks: np.ndarray, queries: np.ndarray) -> np.ndarray:
    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    return unit(chunks) @ unit(queries).T


def _negative_l2(chunks: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """From the differences themselves, as the product form loses the last digits."""
    out = np.empty((len(chunks), len(queries)))
    step = max(1, TILE_BYTES // (8 * max(1, chunks.size)))
    for k in range(0, len(queries), step):
        apart = chunks[:, None, :] - queries[None, k : k + step, :]
        out[:, k : k + step] = -np.sqrt(np.einsum("cqd,cqd->cq", apart, apart))
    return out


class _Best:
    """The ``k`` best chunks of every query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.query, self.ids, self.score = k, np.empty(0, np.int64), None, np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, above: float = -np.inf) -> None:
        """Scores of a tile, a row for each id; those not greater than ``above`` are no hits."""
        if not scores.size:
            return
        ids, scores = ids.astype(str) if ids.dtype == object else ids, np.round(scores, DECIMALS)
        scores[np.isnan(scores)] = -np.inf  # vectors that are not finite are no hits
        keep = scores > above
        if len(scores) > self.k:
            keep &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        row, query = np.nonzero(keep)
        ids = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, scores[keep]])
        order = np.lexsort((ids, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < self.k]
        self.query, self.ids, self.score = query[order], ids[order], score[order]

    def rows(self, query_ids: np.ndarray) -> pd.DataFrame:
        ids = [] if self.ids is None else self.ids
        return pd.DataFrame({"query_id": np.asarray(query_ids)[self.query], "chunk_id": ids, "score": self.score})


def _hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _home(key: str, n: int) -> Column:
    """One of ``n`` places for a row, by its key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _each(n: int) -> Column:
    """A copy of the row for each of ``n`` places."""
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _score_block(asked: pd.DataFrame, chunks: DataFrame, schema: T.StructType, k: int, score: Scorer) -> DataFrame:
    """One block of queries against all chunks, which stay where they are."""
    ids, matrix = asked["query_id"].to_numpy(), _matrix(asked["vector"])
    tile = max(1, TILE_BYTES // (8 * len(ids)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for pdf in batches:
            for at in range(0, len(pdf), tile):
                part = pdf.iloc[at : at + tile]
                best.add(part["chunk_id"].to_numpy(), score(_matrix(part["vector"]), matrix))
        yield best.rows(ids)

    return chunks.mapInPandas(run, schema)


def _score_topk(queries: DataFrame, chunks: DataFrame, k: int, score: Scorer, query_bytes: int) -> DataFrame:
    """``queries(query_id, vector)`` against ``chunks(chunk_id, vector)``: k best per query and task.

    Queries go out in blocks of ``query_bytes``, one after the other; the hits of a block are a
    staged table, so the driver holds one block at a time. Chunks are never shuffled.
    """
    schema = _hit_schema(queries, chunks)
    asked = stage(queries.withColumn("_at", F.monotonically_increasing_id()), "queries")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    n_blocks = max(1, -(-n * 8 * width // query_bytes))
    asked = asked.withColumn("_block", _home("_at", n_blocks))
    found = []
    for block in range(n_blocks):
        part = asked.where(F.col("_block") == block).select("query_id", "vector").toArrow().to_pandas()
        if len(part):
            found.append(stage(_score_block(part, chunks, schema, k, score), "block-hits"))
    return reduce(DataFrame.unionByName, found) if found else chunks.sparkSession.createDataFrame([], schema)


def _vector_topk(queries: DataFrame, chunks: DataFrame, k: int, score: Scorer, query_bytes: int) -> DataFrame:
    has = F.col("embedding").isNotNull()
    q = queries.where(has).select("query_id", F.col("embedding").alias("vector"))
    c = chunks.where(has).select("chunk_id", F.col("embedding").alias("vector"))
    return rank_hits(_score_topk(q, c, k, score, query_bytes), k)


def has_embedding(df: DataFrame) -> DataFrame:
    return df.where(F.col("embedding").isNotNull())


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` chunks of greatest cosine per query."""
    return _vector_topk(queries, chunks, k, _cosine, query_bytes)


def l2_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: the ``k`` nearest chunks per query."""
    near = _vector_topk(queries, chunks, k, _negative_l2, query_bytes)
    return near.select("query_id", "chunk_id", (-F.col("score")).alias("distance"), "rank")


def rank_hits(scored: DataFrame, k: int = 5) -> DataFrame:
    """Rank scored rows per query, ties to the smaller chunk id."""
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def embed_text(df: DataFrame, column: str, dim: int = 768, out: str = "embedding") -> DataFrame:
    """Fixed-width unit vectors of hashed term counts; lexical and deterministic."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_words", F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != ""))
    counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(words)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


# ---- keywords ----------------------------------------------------------------------

MIN_KEYWORD, MAX_KEYWORDS = 4, 6  # fixed values


def keywords(text: Column, min_len: int = MIN_KEYWORD, max_kw: int = MAX_KEYWORDS) -> Column:
    """First ``max_kw`` blank-separated words of at least ``min_len`` characters, lower case."""
    words = F.filter(F.split(text, r"\s+"), lambda w: F.length(w) >= min_len)
    return F.array_distinct(F.transform(F.slice(words, 1, max_kw), lambda w: F.lower(w)))


def keyword_match(docs: DataFrame, column: str, query: str, min_len: int = MIN_KEYWORD, max_kw: int = MAX_KEYWORDS) -> DataFrame:
    """Documents that contain any keyword of one query; all of them when it has none."""
    words = [w for w in query.split() if len(w) >= min_len][:max_kw]
    if not words:
        return docs
    return docs.where(reduce(Column.__or__, [contains_ci(F.col(column), w) for w in words]))


def keyword_fallback(
    queries: DataFrame, docs: DataFrame, hits: DataFrame, k: int = 5, min_len: int = MIN_KEYWORD, max_kw: int = MAX_KEYWORDS
) -> DataFrame:
    """For queries without a hit: the first ``k`` documents that contain any keyword.

    ``docs(chunk_id, record_type, text_content)`` in order of type and id, score 0. A
    keyword has no blank, so it lies within one word of a text. One pass over the texts
    keeps the first ``k`` documents of every word; the words found there are matched with
    the keywords through shared four-letter pieces. The first ``k`` of a union are among
    the first ``k`` of its parts, so nothing is lost and no (query, document) table arises.
    """
    order = [F.asc("record_type"), F.asc("chunk_id")]
    open_queries = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    words = F.expr("explode_outer(_kw)").alias("keyword")
    asked = open_queries.withColumn("_kw", keywords(F.col("query_text"), min_len, max_kw)).select("query_id", words)
    asked = stage(asked.withColumn("keyword", F.coalesce("keyword", F.lit(""))), "query-keywords")

    piece = min_len
    long_enough = F.filter(F.split(F.lower("text_content"), r"\s+"), lambda w: F.length(w) >= piece)
    spread = docs.select("chunk_id", "record_type", F.explode(F.array_distinct(long_enough)).alias("word"))
    postings = stage(top_per_group(spread, ["word"], order, k, "_r").drop("_r"), "word-postings")
    pieces = F.expr(f"transform(sequence(1, length(word) - {piece - 1}), i -> substr(word, i, {piece}))")
    vocabulary = postings.select("word").distinct().select("word", F.explode(F.array_distinct(pieces)).alias("_piece"))
    sought = asked.select("keyword").distinct().where("keyword <> ''").withColumn("_piece", F.substring("keyword", 1, piece))
    sought = stage(sought, "keywords")
    shared = stage(vocabulary.join(sought.select("_piece").distinct(), "_piece", "left_semi"), "shared-pieces")
    matched = balanced_join(sought, shared, "_piece").where(F.contains("word", "keyword")).select("keyword", "word")
    per_word = matched.join(postings, "word").select("keyword", "record_type", "chunk_id").distinct()
    anything = docs.select("record_type", "chunk_id").orderBy(*order).limit(k)
    per_keyword = top_per_group(per_word, ["keyword"], order, k, "_r").drop("_r")
    per_keyword = stage(per_keyword.unionByName(anything.withColumn("keyword", F.lit(""))), "keyword-postings")
    found = balanced_join(asked, per_keyword, "keyword").select("query_id", "record_type", "chunk_id").distinct()
    return top_per_group(found, ["query_id"], order, k).withColumn("score", F.lit(0.0))


BM25_BLOCK = 256  # queries scored together: bounds the word-by-query matrix of a task
TERM_SLICE = 1_000_000  # (document, word) counts that a task holds


def _bm25_scores(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores of one slice of documents for one block of queries, the ``k`` best per query."""

    def score(terms: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = _Best(k)
        q_code, q_ids = pd.factorize(asked["query_id"])
        w_code, words = pd.factorize(asked["word"])
        weights = np.zeros((len(words), len(q_ids)))
        weights[w_code, q_code] = 1.0
        at = pd.Index(words).get_indexer(terms["word"])
        terms, at = terms[at >= 0], at[at >= 0]
        d_code, d_ids = pd.factorize(terms["chunk_id"], sort=True)
        order = np.argsort(d_code, kind="stable")
        d_code, at, value = d_code[order], at[order], terms["w"].to_numpy()[order]
        tile = max(1, TILE_BYTES // (8 * max(1, len(words))))
        for first in range(0, len(d_ids), tile):  # bounds the dense rows held at a time
            lo, hi = np.searchsorted(d_code, [first, first + tile])
            ids = np.asarray(d_ids[first : first + tile])
            dense = np.zeros((len(ids), len(words)))
            dense[d_code[lo:hi] - first, at[lo:hi]] = value[lo:hi]
            best.add(ids, dense @ weights, above=0)
        return best.rows(q_ids)

    return score


def bm25(
    queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75,
    block: int = BM25_BLOCK, slice_rows: int = TERM_SLICE,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by BM25 over lower-case words; score 0 is no hit.

    Only words that some query uses are counted. Slices of documents meet blocks of
    queries and each meeting returns its best ``k`` per query, so a word that stands in
    most documents costs one row per document and never a row per (query, document).
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = queries.select("query_id", F.explode(F.array_distinct(word(F.col("query_text")))).alias("word"))
    asked = stage(asked, "query-words")
    texts = docs.select("chunk_id", word(F.col("text_content")).alias("words"))
    # every document also counts the word "", so that its length is kept in the same pass
    marked = texts.select("chunk_id", F.size("words").alias("len"), F.explode(F.concat("words", F.array(F.lit("")))).alias("word"))
    kept = asked.select("word").unionByName(asked.sparkSession.range(1).select(F.lit("").alias("word"))).distinct()
    tallies = stage(
        marked.join(kept, "word", "left_semi").groupBy("chunk_id", "len", "word").agg(F.count("*").alias("tf")), "term-counts"
    )
    counted = tallies.where("word <> ''")
    corpus = tallies.where("word = ''").agg(F.struct(F.count("*").alias("n"), F.avg("len").alias("mean_len"))).scalar()
    df = counted.groupBy("word").agg(F.count("*").alias("df"))
    idf = stage(df.select("word", F.log(1 + (corpus["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "word-weights")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / corpus["mean_len"]))
    terms = counted.join(idf, "word").select("chunk_id", "word", (tf * F.col("idf")).alias("w"))

    n_blocks = max(1, -(-queries.count() // block))
    n_slices = max(1, -(-counted.count() // slice_rows), counted.sparkSession.sparkContext.defaultParallelism)
    terms = terms.withColumn("_slice", _home("chunk_id", n_slices)).withColumn("_block", _each(n_blocks))
    wanted = asked.withColumn("_block", _home("query_id", n_blocks)).withColumn("_slice", _each(n_slices))
    pair = ["_block", "_slice"]
    found = terms.groupBy(*pair).cogroup(wanted.groupBy(*pair)).applyInPandas(
        _bm25_scores(k), _hit_schema(queries, docs)
    )
    return rank_hits(found, k)


# ---- fusion and prompts ------------------------------------------------------------


def merge_rank_lists(lists: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (query, chunk) with its rank in every list, NULL where it is absent."""
    tagged = [df.select("query_id", "chunk_id", F.lit(name).alias("_list"), "rank") for name, df in lists.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    return rows.groupBy("query_id", "chunk_id").agg(
        *[F.min(F.when(F.col("_list") == name, F.col("rank"))).alias(f"rank_{name}") for name in lists]
    )


def rrf(lists: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = 60, top: int = 5) -> DataFrame:
    """Reciprocal rank fusion: the weighted sum of 1 / (k + rank) over the lists."""
    weights = weights or {name: 1.0 for name in lists}
    merged = merge_rank_lists(lists)
    parts = [F.coalesce(F.lit(float(weights[n])) / (k + F.col(f"rank_{n}")), F.lit(0.0)) for n in lists]
    total = F.round(reduce(Column.__add__, parts), 12)
    return rank_hits(merged.select("query_id", "chunk_id", total.alias("score")), top)


# The evidence block's marks and the instruction below it.
BLOCK_OPEN, BLOCK_CLOSE = "[RETRIEVED CONSTRAINTS]", "[END RETRIEVED CONSTRAINTS]"
BLOCK_EMPTY = "(No relevant logistics records found for this query.)"
_LINE_END = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"


def evidence_block(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query a numbered text of its hits (``rank, record_type, chunk_id, text_content, score``)."""
    body = F.regexp_replace("text_content", r"^\s+|\s+$", "")
    body = F.when(F.length(body) > 0, F.concat(F.lit("\n   "), F.regexp_replace(body, _LINE_END, "\n   "))).otherwise("")
    tag = F.when(F.col("score") > 0, F.format_string(" (score: %.4f)", "score")).otherwise("")
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("record_type"), F.lit(" | "), F.col("chunk_id").cast("string"), tag, body
    )
    # one entry per ranked hit: bounded by the k of the ranking
    listed = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    per_query = hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("_lines"))
    block = F.concat_ws("\n", F.lit(BLOCK_OPEN), F.coalesce("_lines", F.lit(BLOCK_EMPTY)), F.lit(BLOCK_CLOSE))
    return queries.select("query_id").join(per_query, "query_id", "left").select("query_id", block.alias("block"))


GROUNDING = "Use the records between the marks as the only source of facts. Where none of them fits the question, say so."


def prompt_table(queries: DataFrame, blocks: DataFrame, base: str, instruction: str = GROUNDING) -> DataFrame:
    """Prompt per query: role text, evidence, instruction, question."""
    text = F.concat_ws(
        "\n\n", F.lit(base.strip()), F.col("block"), F.lit(instruction), F.concat(F.lit("User Query: "), F.trim("query_text"), F.lit("\n"))
    )
    return queries.join(blocks, "query_id").select("query_id", text.alias("prompt"))


# The roles and steps of the four prompt strategies.
CRITERIA = (
    "Answer VETO when a limit on the alternate route is below the load, otherwise APPROVED. "
    "Name the disruption, the limit checked and the final routing."
)
CHAINS_ROLE = (
    "You plan freight routes. Write THREE independent chains of reasoning (disruption, route and limits, "
    "decision), then the decision that most chains reach."
)
ACT_ROLE = (
    "You check freight routes. Repeat Thought, Action and Observation until every limit is checked. Actions: "
    "ASSESS_DISRUPTION, CHECK_BRIDGE_WEIGHT, CHECK_CLEARANCE, CHECK_HAZMAT, DECIDE."
)
FEW_ROLE = "You judge freight routes. Answer the current task in the format of the examples."
CHAIN_EXAMPLES, FEW_EXAMPLES = 2, 3  # fixed values


def _examples(examples: DataFrame, n: int, answer: str, numbered: bool) -> Column:
    """The first ``n`` examples as one text; a one-row subquery, not a join."""
    first = examples.orderBy("example_id").limit(n)
    line = lambda x: F.concat(
        F.lit("Query: "), x["instruction"], F.lit("\nEvidence: "), x["context"], F.lit(f"\n{answer}: "), x["output"]
    )
    rows = F.sort_array(F.collect_list(F.struct("example_id", "instruction", "context", "output")))
    listed = F.transform(
        rows,
        lambda x, i: F.concat(F.concat(F.lit("--- Example "), (i + 1).cast("string"), F.lit(" ---\n")) if numbered else F.lit(""), line(x)),
    )
    return F.coalesce(first.agg(F.array_join(listed, "\n\n")).scalar(), F.lit(""))


def strategy_prompts(queries: DataFrame, examples: DataFrame) -> DataFrame:
    """Four prompts per query: plain, three chains, act and observe, few examples.

    ``queries(query_id, query_text, evidence)``; evidence is left out of the plain
    prompt when empty. ``examples(example_id, instruction, context, output)``.
    """
    q, e = F.col("query_text"), F.coalesce("evidence", F.lit(""))
    task = F.concat(F.lit("Query: "), q, F.lit("\nEvidence: "), e)
    plain = F.concat(
        F.lit("Instruction: "), q, F.lit("\n"), F.when(e != "", F.concat(F.lit("Context: "), e, F.lit("\n"))).otherwise(""), F.lit("Output:\n")
    )
    join = lambda *parts: F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    prompts = {
        "plain": plain,
        "chains": join(CHAINS_ROLE, CRITERIA, _examples(examples, CHAIN_EXAMPLES, "Correct Output", False), task, "Chain 1:"),
        "act": join(ACT_ROLE, CRITERIA, task, "Thought: which route is affected?\nAction: ASSESS_DISRUPTION"),
        "few": join(FEW_ROLE, CRITERIA, _examples(examples, FEW_EXAMPLES, "Decision", True), "--- Current Task ---", task, "Decision:"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), p.alias("prompt")) for n, p in prompts.items()])
    return queries.select("query_id", F.inline(pairs))


def evidence_bundle(heat: DataFrame, bridges: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows of three sources with a ``source`` tag and the row as JSON."""
    def part(source: str, df: DataFrame, order: Sequence[Column]) -> DataFrame:
        first = df.orderBy(*order).limit(n)
        numbered = top_per_group(first.withColumn("source", F.lit(source)), ["source"], order, n)
        return numbered.select("source", "rank", F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("item"))

    return reduce(
        DataFrame.unionByName,
        [
            part("accident_risk", heat, [F.desc("incident_count"), F.asc("state"), F.asc("city")]),
            part("bridge_data", bridges, [F.asc("bridge_id")]),
            part("logistics_data", chunks, [F.asc("chunk_id")]),
        ],
    )


def bundle_sources(bundle: DataFrame) -> DataFrame:
    """Sources that had rows (at most the three of the bundle)."""
    return bundle.agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("grounding_sources"))


def token_chunks(docs: DataFrame, size: int = 512, overlap: int = 64, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Overlapping windows of blank-separated tokens that cover the whole text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    words = F.filter(F.split(F.col(column), r"\s+"), lambda w: w != "")
    n = F.size("_w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    window = lambda i: F.struct(i.alias("chunk_no"), F.slice("_w", i * step + 1, F.lit(size)).alias("part"))
    return (
        docs.select(key, words.alias("_w"))
        .where(n > 0)
        .select(key, F.inline(F.transform(F.sequence(F.lit(0), last), window)))
        .select(key, "chunk_no", F.size("part").alias("n_tokens"), F.array_join("part", " ").alias("text_content"))
    )


def majority_vote(votes: DataFrame) -> DataFrame:
    """Most frequent answer per query and its share of the votes, ties to the smaller answer."""
    counts = votes.groupBy("query_id", "answer").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("answer"))).alias("best")
    return counts.groupBy("query_id").agg(best, F.sum("n").alias("total")).select(
        "query_id", F.col("best.answer").alias("answer"), (-F.col("best.neg")).alias("votes"),
        (-F.col("best.neg") / F.col("total")).alias("confidence"),
    )


def training_text(df: DataFrame) -> DataFrame:
    """Adds ``text``: instruction, context unless empty, and output."""
    context = F.coalesce("context", F.lit(""))
    parts = [
        F.concat(F.lit("Instruct: "), "instruction"),
        F.when(context != "", F.concat(F.lit("Context: "), context)),
        F.concat(F.lit("Output:\n"), "output"),
    ]
    return df.withColumn("text", F.concat_ws("\n", *parts))


def training_pairs(turns: DataFrame) -> DataFrame:
    """(user turn, next assistant turn) of every conversation, with its system text as context.

    Turns meet on conversation and number, so one endless conversation spreads over tasks.
    """
    said = lambda role: turns.where(F.col("role") == role)
    ask = said("user").select("conv_id", "turn", F.col("text").alias("instruction"))
    answer = said("assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    system = said("system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    return ask.join(answer, ["conv_id", "turn"]).join(system, "conv_id", "left")

"""Stored inverted index for keyword ranking, with bounds that let a search skip most of it.

Every posting is stored with its whole share of a score, in blocks of one word and one tier of shares; a block has its
greatest share. A search scores a few documents in full first. Words whose greatest shares add up to less than
the k-th of these scores cannot make a hit alone, so only documents of the other words are looked at, blocks
that cannot reach the score are left out, and only what may still be a hit is scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from midmile.operators.retrieval import DECIMALS, rank_hits
from midmile.runtime import stage

BLOCK = 256  # postings of a block, about
TIERS = 4  # tiers for each halving of a share
DEEPEST = 40
BUCKETS = 64
FIRST = 4  # times k documents are scored before anything is skipped
SLACK = 1e-7  # of a bound, for rounding


@dataclass(frozen=True)
class Postings:
    """Where an index is stored, and how."""

    path: str
    buckets: int
    id_type: str  # of chunk ids, as in a schema

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("word string, df long, idf double, most double").parquet(f"{self.path}/words")

    def blocks(self, spark: SparkSession) -> DataFrame:
        postings = f"array<struct<chunk_id:{self.id_type},share:double>>"
        return spark.read.schema(f"word string, tier int, most double, postings {postings}, bucket int").parquet(f"{self.path}/blocks")

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"chunk_id {self.id_type}, parts array<struct<word:string,part:double>>").parquet(f"{self.path}/documents")


def load(spark: SparkSession, path: str) -> Postings:
    found = spark.read.parquet(f"{path}/about").first()
    return Postings(path, found.buckets, found.id_type)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(n: int) -> Column:
    """The task that Spark deals a word to, of ``n``."""
    return F.pmod(F.hash("word"), F.lit(n)).cast("int")


def build(docs: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS) -> Postings:
    """Store an index of ``docs(chunk_id, text_content)``. A null text is no document; one without words counts, but is in no list.

    ``words``: each word's documents, weight and greatest share. ``blocks``: postings of a word and tier, at most about ``BLOCK`` each, by bucket of
    the word. ``documents``: the words of a document with their shares before weights. Statistics are of all documents. Texts move once,
    to have the words of a document together, and postings once, to have those of a word together.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("text_content").isNotNull()).select("chunk_id", "text_content")
    lengths = known.select(F.size(words_of(F.col("text_content"))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    n, mean = lengths.n, lengths.mean or 1.0
    texts = known.repartition("chunk_id").select("chunk_id", words_of(F.col("text_content")).alias("words"))
    spread = texts.select("chunk_id", F.size("words").alias("len"), F.explode("words").alias("word"))
    tallies = spread.groupBy("chunk_id", "len", "word").agg(F.count("*").alias("tf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    # sorted, so that equal texts add up their shares in the same order
    whole = tallies.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("word", part.alias("part")))).alias("parts"))
    whole.write.parquet(f"{path}/documents")
    index = Postings(path, buckets, docs.schema["chunk_id"].dataType.simpleString())
    entries = index.documents(spark).select("chunk_id", F.inline("parts"))
    df = entries.groupBy("word").agg(F.count("*").alias("df"), F.max("part").alias("top"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df.select("word", "df", idf.alias("idf"), (F.col("top") * idf).alias("most")).write.parquet(f"{path}/words")
    shares = entries.repartition(buckets, "word").join(index.words(spark), "word")
    shares = shares.select("word", "chunk_id", (F.col("part") * F.col("idf")).alias("share"), "df", "most")
    tier = F.least(F.floor(-F.log2(F.col("share") / F.col("most")) * TIERS), F.lit(DEEPEST)).cast("int")
    piece = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("df") / BLOCK))
    blocks = shares.groupBy("word", tier.alias("tier"), piece.alias("piece")).agg(
        F.max("share").alias("most"), F.collect_list(F.struct("chunk_id", "share")).alias("postings")  # at most about BLOCK
    )
    blocks = blocks.withColumn("bucket", _bucket(buckets)).sortWithinPartitions("bucket", "word", "tier")
    blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
    about = spark.createDataFrame([(buckets, index.id_type)], "buckets int, id_type string")
    about.coalesce(1).write.parquet(f"{path}/about")  # last: an index without it is not whole
    return index


def _scored(spark: SparkSession, index: Postings, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` in full for ``pairs(query_id, chunk_id)``; a document's words are met with those of its queries where it lies."""
    own = pairs.join(index.documents(spark), "chunk_id").select("query_id", "chunk_id", F.inline("parts"))
    met = own.join(asked.select("query_id", "word", "idf"), ["query_id", "word"])
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("part") * F.col("idf")), DECIMALS).alias("score"))


def search(queries: DataFrame, index: Postings, k: int = 5, seen: Observation | None = None) -> DataFrame:
    """``query_id, chunk_id, score, rank`` for ``queries(query_id, query_text)``: the hits of ``retrieval.bm25``.

    ``seen`` counts as ``postings`` those that are read from blocks to find candidates.
    """
    spark = queries.sparkSession
    words, blocks = index.words(spark), index.blocks(spark)
    asked = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("query_text")))).alias("word"))
    asked = stage(asked.join(words, "word").select("query_id", "word", "df", "idf", "most"), "query-words")
    used = [r[0] for r in asked.select(_bucket(index.buckets)).distinct().collect()]  # at most one row a bucket
    blocks = blocks.where(F.col("bucket").isin(used)).select("word", F.col("most").alias("block_most"), "postings")

    # the rarest words that together have enough documents: all of those are scored in full
    up_to = Window.partitionBy("query_id").orderBy("df", "word").rowsBetween(Window.unboundedPreceding, -1)
    rare = asked.withColumn("_before", F.coalesce(F.sum("df").over(up_to), F.lit(0))).where(F.col("_before") < FIRST * k).select("query_id", "word")
    met = rare.join(blocks, "word").select("query_id", F.inline("postings")).select("query_id", "chunk_id").distinct()
    started = stage(_scored(spark, index, stage(met, "first-documents"), asked), "first-scores")
    kth = rank_hits(started, k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("goal"))

    # words that matter: without them the rest cannot reach the goal
    below = Window.partitionBy("query_id").orderBy("most", "word")
    all_ = Window.partitionBy("query_id")
    goal = F.coalesce("goal", F.lit(0.0))
    told = asked.join(kth, "query_id", "left").withColumn("goal", goal).withColumn("_sum", F.sum("most").over(below))
    told = told.withColumn("_whole", F.sum("most").over(all_)).withColumn("_slight", F.col("_sum") < F.col("goal"))
    told = told.withColumn("rest", F.coalesce(F.max(F.when(F.col("_slight"), F.col("_sum"))).over(all_), F.lit(0.0)))
    needed = stage(told.where(~F.col("_slight")).select("query_id", "word", "goal", "rest", (F.col("_whole") - F.col("most")).alias("others")), "needed-words")
    # a posting that some query needs goes once to its document, and the sums of a document are made there
    least = needed.groupBy("word").agg(F.min(F.col("goal") - F.col("others")).alias("least")).withColumn("_word", F.monotonically_increasing_id())
    least = stage(least, "word-goals")
    reach = blocks.join(least, "word").where(F.col("block_most") >= F.col("least")).select("_word", F.inline("postings"))
    if seen is not None:
        reach = reach.observe(seen, F.count("*").alias("postings"))
    needed = stage(needed.join(least.select("word", "_word"), "word").select("query_id", "_word", "goal", "rest"), "needed-numbers")
    partial = reach.repartition("chunk_id").join(needed, "_word").groupBy("query_id", "goal", "rest", "chunk_id").agg(F.sum("share").alias("so_far"))
    open_ = partial.where(F.col("so_far") + F.col("rest") >= F.col("goal")).select("query_id", "chunk_id", "so_far", "rest")
    open_ = stage(open_, "open-documents")
    # what is known of a score so far is less than the score, so the k-th of these is a goal too
    best = rank_hits(open_.select("query_id", "chunk_id", F.col("so_far").alias("score")), k).where(F.col("rank") == k)
    open_ = open_.join(best.select("query_id", (F.col("score") - SLACK).alias("sure")), "query_id", "left")
    open_ = open_.where(F.col("so_far") + F.col("rest") >= F.coalesce("sure", F.lit(0.0))).select("query_id", "chunk_id")
    open_ = stage(open_.join(started, ["query_id", "chunk_id"], "left_anti"), "near-documents")
    found = started.unionByName(_scored(spark, index, open_, asked)).where("score > 0")
    return rank_hits(found, k)


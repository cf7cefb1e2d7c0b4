"""The corpus pipeline: language, near duplicates, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from midmile.llm import byte_bpe, decontaminate, language_id, near_dup
from midmile.runtime import fresh_path, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without text or letters go.

    Profiles are learned from all documents that name a language; with none, all documents go.
    """
    found = language_id.predict(docs.select(*COLUMNS), language_id.learn(docs))
    return found.where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id.

    Rows that share an id are one document; the row with the least text stays. Null ids stay.
    """
    found = near_dup.near_duplicates(docs, near_dup.Rule(shingle=5, percent=80))
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    known = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return known.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by passages of the benchmark."""
    key = F.xxhash64("doc_id", "text")
    index = stage(decontaminate.build_index(docs.select(key.alias("key"), "text"), id="key"), "places")
    found = decontaminate.judge(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stage(found.where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.select(*COLUMNS, key.alias("_key")).join(bad, "_key", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether their bytes are the document's text again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text"), ranks, pattern), ranks, pattern)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Byte-level BPE merges are no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = fresh_path(spark, name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.llm import byte_bpe, chat, context_mix, decontaminate, html_text, language_id, near_dup, repeats, spelling, structure, url_lists, vector_join, warc
from midmile.llm.common import fold, table
from midmile.llm.oracles import ORACLES  # noqa: F401  read by the driver's entry
from midmile.runtime import fresh_path, stage

YEAR = 365 * 86_400
LISTS = ("adult", "malware", "spam")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@register
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, folder, "pages", "page_id", "url", "html")).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register
def op2_context_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document, learned from four of five folds."""
    return context_mix.score(table(spark, folder, "documents", "doc_id", "text"), fold("doc_id", 5) == 1)


@register
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = fresh_path(spark, "archive")
    warc.write(table(spark, folder, "pages", "page_id", "url", "html"), path)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).cast("long")
    full = warc.read(spark, path).where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select("record_id", F.col("headers")[warc.PAYLOAD_BYTES].cast("long").alias("payload_bytes"), warc.hex_digest("payload_digest").alias("payload_digest"), "record_type", "refers_to")
    return full.union(again).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


@register
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside passages of the benchmark."""
    index = stage(decontaminate.build_index(table(spark, folder, "documents", "doc_id", "text")), "places")
    found = decontaminate.judge(index, table(spark, folder, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@register
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets overlap by 85 percent."""
    rule = near_dup.Rule(shingle=3, percent=85, bands=30)
    return near_dup.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), rule)


@register
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation rebuilt from an event log, rendered and read back."""
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(probe, rows.schema))
    shown = chat.parse(chat.render(chat.fold(chat.log_of(rows))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform("loss", lambda s: F.get("turns", s["turn"])["text"]), "")
    return shown.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@register
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3) == 1)
    profiles = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs.drop("lang"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@register
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the bytes they stand for, as digests."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents", "doc_id", "text"), ranks, pattern), ranks, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op9_vector_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links between all vectors with equal labels."""
    return vector_join.link(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@register
def op10_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a capture within a year, against list records that every page contributes one of."""
    pages = table(spark, folder, "pages", "page_id", "url")
    captures = pages.withColumn("fetched", F.col("page_id") * 7919 % YEAR)
    listed = F.array_sort(url_lists.keys(F.col("url")))
    records = pages.select(
        F.element_at(F.array(*map(F.lit, LISTS)), (F.col("page_id") % 3 + 1).cast("int")).alias("list"),
        F.element_at(listed, (F.col("page_id") % F.size(listed) + 1).cast("int")).alias("key"),
        (F.col("page_id") * 104729 % YEAR).alias("at"),
        (F.col("page_id") % 7 < 4).alias("active"),
    )
    found = url_lists.judge(captures, records)
    return found.select("page_id", "fetched", (F.size("lists") > 0).alias("blocked"), F.array_join("lists", ",").alias("lists"), "kind", "n_entries")


@register
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    return spelling.variants(spelling.vocabulary(table(spark, folder, "documents", "doc_id", "text")))


@register
def op12_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation damaged by a rule and repaired at least cost."""
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    report, repaired = structure.repair(structure.damage(rows))
    report = report.drop("id").join(structure.digests(repaired), "ckey", "left")
    every = rows.select("conv_id", structure.conversation_key("conv_id").alias("ckey")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    found = every.join(report, "ckey", "left")
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


@register
def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 100 bytes that stand earlier."""
    found = repeats.remove_repeats(table(spark, folder, "documents", "doc_id", "text"), keep=lambda kept: F.sha2(kept, 256))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))

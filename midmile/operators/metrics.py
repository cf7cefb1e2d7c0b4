"""Figures over result tables: verdicts, retrieval, text overlap, rubric, pairs, strategies."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package

VETO = "HARD_VETO"
RUBRIC_PASS = 7  # fixed value: of 10 points


def match_predictions(golden: DataFrame, preds: DataFrame) -> DataFrame:
    """Golden scenarios with their prediction, and whether it is right."""
    both = golden.join(preds, "id")
    return both.withColumn("passed", F.col("expected_verdict") == F.col("actual_verdict"))


def missing_predictions(golden: DataFrame, preds: DataFrame) -> DataFrame:
    return golden.join(preds, "id", "left_anti")


def pass_rates(results: DataFrame) -> DataFrame:
    """Pass rate per category and overall (``category`` NULL, ``level`` 1)."""
    return results.rollup("category").agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("passed"),
        F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"),
        F.grouping_id().cast("int").alias("level"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def classification_metrics(results: DataFrame, positive: str = VETO, labels: Sequence[str] = (VETO, "PASS")) -> DataFrame:
    """Confusion counts, precision, recall, F1 and accuracy per category.

    A missing verdict, or one that is none of the expected labels of the category, is wrong: ``unknown``
    counts those where nothing positive was expected; they lower the accuracy, and others are misses.
    """
    want = F.col("expected_verdict") == positive
    got = F.coalesce(F.col("actual_verdict") == positive, F.lit(False))
    known = F.coalesce(F.col("actual_verdict").isin(*labels), F.lit(False))
    counts = results.groupBy("category").agg(
        F.count_if(want & got).alias("tp"),
        F.count_if(~want & got).alias("fp"),
        F.count_if(want & ~got).alias("fn"),
        F.count_if(~want & ~got & known).alias("tn"),
        F.count_if(~want & ~known).alias("unknown"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "category", "tp", "fp", "fn", "tn", "unknown",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + fp + fn + tn + F.col("unknown")).alias("accuracy"),
    )


def confusion_matrix(results: DataFrame, labels: Sequence[str] = (VETO, "PASS")) -> DataFrame:
    """Counts by expected and actual verdict; ``other`` and ``missing`` hold verdicts that are no label, or null."""
    actual = F.col("actual_verdict")
    shown = F.when(actual.isNull(), "missing").when(actual.isin(*labels), actual).otherwise("other")
    by = results.withColumn("_shown", shown).groupBy("expected_verdict")
    return by.pivot("_shown", [*labels, "other", "missing"]).count().na.fill(0)


def retrieval_metrics(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Per query: recall and NDCG at ``k``, reciprocal rank, and share of hits from relevant sources.

    ``hits(query_id, chunk_id, rank)``, ``truth(query_id, chunk_id)``; ranks are unique
    per query, so at most ``k`` hits of a query count.
    """
    top = hits.where(F.col("rank") <= k)
    good = truth.select("query_id", "chunk_id", F.lit(1).alias("_good")).distinct()
    judged = top.join(good, ["query_id", "chunk_id"], "left").withColumn("_good", F.coalesce("_good", F.lit(0)))
    found = judged.groupBy("query_id").agg(
        F.sum("_good").alias("n_good"),
        F.count("*").alias("n_hits"),
        F.min(F.when(F.col("_good") == 1, F.col("rank"))).alias("first_good"),
        F.sum(F.col("_good") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    wanted = good.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)
    )
    return wanted.join(found, "query_id", "left").select(
        "query_id",
        (F.coalesce("n_good", F.lit(0)) / F.col("n_truth")).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("first_good"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"),
        F.coalesce(_ratio(F.col("n_good"), F.col("n_hits")), F.lit(0.0)).alias("attribution"),
    )


def _lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence of two token lists, one machine-word row at a time."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def _rouge_l(pred: pd.Series, ref: pd.Series) -> pd.Series:
    def f1(p: str | None, r: str | None) -> float | None:
        if p is None or r is None:
            return None
        a, b = p.lower().split(), r.lower().split()
        if not a or not b:
            return 0.0
        common = _lcs_length(a, b)
        return 2.0 * common / (len(a) + len(b))

    return pd.Series([f1(p, r) for p, r in zip(pred, ref)], dtype="float64")


def rouge_l(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Adds ``rouge_l``: F1 of the longest common word sequence of two texts."""
    return df.withColumn("rouge_l", _rouge_l(F.col(pred), F.col(ref)))


def rubric_scores(df: DataFrame, dims: Sequence[str], pass_at: float = RUBRIC_PASS) -> DataFrame:
    """Mean total of the rubric's dimensions and share of scenarios that reach ``pass_at``, per strategy."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in dims), F.lit(0))
    return df.withColumn("_total", total).groupBy("strategy").agg(
        F.count("*").alias("scenarios"),
        F.avg("_total").alias("mean_score"),
        F.avg(F.when(F.col("_total") >= pass_at, 1.0).otherwise(0.0)).alias("pass_rate"),
    )


def pair_variants(results: DataFrame) -> DataFrame:
    """Base and variant verdict of every pair."""
    side = lambda role, name: results.where(F.col("role") == role).select("pair_id", F.col("actual_verdict").alias(name))
    return side("base", "base_verdict").join(side("variant", "variant_verdict"), "pair_id")


def metamorphic(pairs: DataFrame) -> DataFrame:
    """Adds ``holds``: invariance and symmetry keep the verdict, monotonicity never lifts a veto."""
    same = F.col("base_verdict") == F.col("variant_verdict")
    stricter = ~((F.col("base_verdict") == VETO) & (F.col("variant_verdict") != VETO))
    rule = F.when(F.col("type").isin("invariance", "symmetry"), same).when(F.col("type") == "monotonicity", stricter)
    return pairs.withColumn("holds", rule)


def compare_strategies(results: DataFrame, a: str, b: str) -> DataFrame:
    """Paired comparison over shared scenarios: means, mean difference and its t statistic."""
    score = lambda s: F.max(F.when(F.col("strategy") == s, F.col("score")))
    both = (
        results.where(F.col("strategy").isin(a, b))
        .groupBy("scenario_id")
        .agg(score(a).alias("a"), score(b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn("d", F.col("a") - F.col("b"))
    )
    error = F.nullif(F.stddev_samp("d") / F.sqrt(F.count("*").cast("double")), F.lit(0.0))
    return both.agg(
        F.count("*").alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("d").alias("mean_diff"),
        (F.avg("d") / error).alias("t_statistic"),
    )

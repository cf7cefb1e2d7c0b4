"""Quantiles from stored sketches: made once, merged for any rollup, without another scan of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midmile.functions.columns import hour_bucket

SIZE = 800  # of a sketch: quantiles are off by well under a hundredth of the rows


def hourly_sketches(log: DataFrame, keys: Sequence[str], value: str = "execution_time_ms", at: str = "created_at", size: int = SIZE) -> DataFrame:
    """``keys, hour, rows, sketch``: a mergeable sketch of the values of every hour and key; null values are not counted."""
    known = log.where(F.col(value).isNotNull())
    sketch = F.kll_sketch_agg_bigint(F.col(value).cast("long"), size)
    return known.groupBy(*keys, hour_bucket(F.col(at)).alias("hour")).agg(F.count("*").alias("rows"), sketch.alias("sketch"))


def merged(sketches: DataFrame, keys: Sequence[str], size: int = SIZE) -> DataFrame:
    """Sketches of fewer keys, and of all rows together: ``level`` has a bit for every key left out, as of a rollup."""
    together = F.kll_merge_agg_bigint("sketch", size)
    return sketches.rollup(*keys).agg(F.sum("rows").alias("rows"), together.alias("sketch"), F.grouping_id().cast("int").alias("level"))


def _quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q)))


def quantiles(sketches: DataFrame, qs: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Every row of ``sketches`` with each ``q`` and its estimated ``value``."""
    pairs = F.array(*[F.struct(F.lit(float(q)).alias("q"), _quantile(q).alias("value")) for q in qs])
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.inline(pairs))


def rank_errors(log: DataFrame, estimates: DataFrame, keys: Sequence[str], value: str = "execution_time_ms") -> DataFrame:
    """``estimates(keys, q, value)`` with ``error``: how far the value's exact rank is from ``q``, as a share of the rows of its key."""
    known = log.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    met = known.join(estimates, list(keys))
    ranks = met.groupBy(*keys, "q", "value").agg(
        F.count("*").alias("rows"), F.count_if(F.col("_v") <= F.col("value")).alias("upto"), F.count_if(F.col("_v") < F.col("value")).alias("below")
    )
    error = F.greatest(F.lit(0.0), F.col("q") - F.col("upto") / F.col("rows"), F.col("below") / F.col("rows") - F.col("q"))
    return ranks.select(*keys, "q", "value", "rows", error.alias("error"))

"""What several operators share: folds, bytes per Arrow batch, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.runtime import stage

BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch sent to Python, unless the session has set its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return free memory to the machine: a task's worker lives on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives back memory at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of one given table, without any others."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def _star(edges: DataFrame, keep: Column) -> DataFrame:
    """Link every end that ``keep`` selects to the least node next to (or at) its start."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = edges.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v"), least


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): the least node that can be reached, for each node of an edge.

    Alternates large and small stars until the links stop changing. Every step is an
    aggregate that combines before its shuffle and an equi-join that adaptive execution
    can split, so a node with very many edges is no bottleneck. Each round is a staged
    table. Null ends and loops are left out; an empty input gives an empty result.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = stage(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _star(both, F.col("v") > F.col("u"))
        down = large.distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()

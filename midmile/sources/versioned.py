"""A table in parts that are rewritten only when touched, with a manifest that commits every change at once.

Rows lie in ``data/version=V/part=P``; ``manifests/version=V`` tells which version of every part is current. A
change writes new files of the parts that it touches and then its manifest; what broke off before the manifest is
never read and is replaced by the next try. A batch that a manifest names already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.operators.ranking import top_per_group
from midmile.runtime import stage

_MANIFEST = "part int, current int, batch string, version int"


@dataclass(frozen=True)
class Table:
    """``schema`` as text without the part; rows are dealt to ``parts`` by the hash of ``keys``."""

    path: str
    schema: str
    keys: tuple[str, ...]
    parts: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")


def _manifests(spark: SparkSession, table: Table) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{table.path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _current(spark: SparkSession, table: Table, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The last version, and of every part the version of its files; at most one row a part."""
    found = _manifests(spark, table)
    if found is None:
        return 0, {}
    if version is None:
        version = found.agg(F.max("version")).first()[0] or 0
    rows = found.where((F.col("version") == version) & (F.col("part") >= 0)).select("part", "current").collect()
    return version, {r.part: r.current for r in rows}


def read(spark: SparkSession, table: Table, parts: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
    """Current rows, or those of an earlier version; of some parts only the folders of these are read."""
    _, current = _current(spark, table, version)
    wanted: dict[int, list[int]] = {}
    for part, at in current.items():
        if parts is None or part in parts:
            wanted.setdefault(at, []).append(part)
    empty = spark.createDataFrame([], table.schema)
    if not wanted:
        return empty
    chosen = reduce(Column.__or__, [(F.col("version") == at) & F.col("part").isin(held) for at, held in sorted(wanted.items())])
    return spark.read.schema(f"{table.schema}, version int, part int").parquet(f"{table.path}/data").where(chosen).select(*empty.columns)


def batches(spark: SparkSession, table: Table) -> DataFrame:
    """``version, batch`` of everything that was committed."""
    found = _manifests(spark, table)
    empty = spark.createDataFrame([], "version int, batch string")
    return empty if found is None else found.select("version", "batch").distinct()


def rewrite(table: Table, touching: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: str) -> int | None:
    """Replace the parts of the rows in ``touching`` by ``change(rows there, touching)``; the new version, or None for a batch known already.

    The manifest of a version can be written once, so of two writers at a time the later one fails and may try again.
    """
    spark = touching.sparkSession
    if not batches(spark, table).where(F.col("batch") == batch).isEmpty():
        return None
    touching = stage(touching, "touching")
    touched = sorted(r[0] for r in touching.select(table.part()).distinct().collect())  # at most one row a part
    last, current = _current(spark, table)
    version = last + 1
    new = change(read(spark, table, touched), touching).withColumn("part", table.part())
    new.repartition(max(1, len(touched)), "part").write.mode("overwrite").partitionBy("part").parquet(f"{table.path}/data/version={version}")
    held = spark.read.schema(f"{table.schema}, part int").parquet(f"{table.path}/data/version={version}").select("part").distinct()
    kept = {part: at for part, at in current.items() if part not in set(touched)} | {r.part: version for r in held.collect()}
    rows = [(part, at, batch) for part, at in sorted(kept.items())] or [(-1, version, batch)]
    spark.createDataFrame(rows, "part int, current int, batch string").coalesce(1).write.mode("error").parquet(f"{table.path}/manifests/version={version}")
    return version


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(table: Table, rows: DataFrame, order: Sequence[Column], batch: str) -> int | None:
    """Put rows in the place of those with the same key; of several rows with a key the first by ``order`` counts. Null keys are keys."""
    columns = rows.columns
    best = top_per_group(rows, list(table.keys), order, 1, "_r").drop("_r")

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new, _same(old, new, table.keys), "left_anti").unionByName(new.select(*columns))

    return rewrite(table, best, change, batch)


def delete(table: Table, keys: DataFrame, batch: str) -> int | None:
    """Take out the rows with one of the given keys."""

    def change(old: DataFrame, gone: DataFrame) -> DataFrame:
        return old.join(gone, _same(old, gone, table.keys), "left_anti")

    return rewrite(table, keys.select(*table.keys).distinct(), change, batch)


def fold(table: Table, signed: DataFrame, sums: Sequence[str], count: str, batch: str) -> int | None:
    """Add signed sums to the rows of their keys; a row whose ``count`` comes to 0 goes."""
    added = lambda df: df.groupBy(*table.keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums])

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        return added(old.unionByName(new.select(*old.columns))).where(F.col(count) != 0)

    return rewrite(table, added(signed), change, batch)


# --- the heatmap, kept up to date


def heat_table(path: str, parts: int = 64) -> Table:
    return Table(path, "state string, city string, hour timestamp_ntz, incident_count long, severity_sum long, severities long", ("state", "city", "hour"), parts)


def heat_changes(added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Signed hours of incidents that came and went; an update is both. Late and deleted rows are no different from others."""
    from midmile.functions.columns import hour_bucket

    given = [df.withColumn("_sign", F.lit(sign)) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    rows = reduce(DataFrame.unionByName, [df.select("state", "city", "start_time", "severity", "_sign") for df in given])
    hour = hour_bucket(F.col("start_time")).cast("timestamp_ntz").alias("hour")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("state", "city", hour).agg(
        total(F.col("_sign")).alias("incident_count"), total(F.col("_sign") * F.col("severity")).alias("severity_sum"),
        total(F.when(F.col("severity").isNotNull(), F.col("_sign"))).alias("severities"),
    )


def fold_heat(table: Table, changes: DataFrame, batch: str) -> int | None:
    return fold(table, changes, ["incident_count", "severity_sum", "severities"], "incident_count", batch)


def heat(spark: SparkSession, table: Table) -> DataFrame:
    """``state, city, hour, incident_count, avg_severity`` as stored."""
    rows = read(spark, table)
    return rows.select("state", "city", "hour", "incident_count", F.try_divide("severity_sum", "severities").alias("avg_severity"))

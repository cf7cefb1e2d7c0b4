"""Checks on tables. Every check gives ``check, table, column, observed, threshold, status``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midmile.functions import geo

US_BOX = (24.0, 50.0, -125.0, -66.0)  # lat from/to, lon from/to of the contiguous states


def _status(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def _row(check: str, table: str, column: str, observed: Column, threshold: float, ok: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
        _status(ok).alias("status"),
    )


def _report(df: DataFrame, aggs: Mapping[str, Column], rows: Sequence[Column]) -> DataFrame:
    """One pass over ``df``: its aggregates, then one line per check."""
    one = df.agg(*[a.alias(n) for n, a in aggs.items()])
    return one.select(F.inline(F.array(*rows)))


def check_min_rows(dfs: Mapping[str, DataFrame], minima: Mapping[str, int]) -> DataFrame:
    parts = []
    for table, least in minima.items():
        n = F.col("n")
        parts.append(_report(dfs[table], {"n": F.count("*")}, [_row("min_rows", table, "*", n, least, n >= least)]))
    return reduce(DataFrame.unionByName, parts)


def check_columns(columns: DataFrame, required: DataFrame) -> DataFrame:
    """``required`` and ``columns`` have ``table_name, column_name``; one line per required column."""
    have = columns.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    have = have.withColumn("found", F.lit(1.0))
    same = (F.lower("table_name") == F.col("t")) & (F.lower("column_name") == F.col("c"))
    return required.join(have, same, "left").select(
        F.lit("column_present").alias("check"),
        F.col("table_name").alias("table"),
        F.col("column_name").alias("column"),
        F.coalesce("found", F.lit(0.0)).alias("observed"),
        F.lit(1.0).alias("threshold"),
        _status(F.col("found").isNotNull()).alias("status"),
    )


def check_null_rate(df: DataFrame, table: str, limits: Mapping[str, float]) -> DataFrame:
    """Share of NULLs of several columns in one pass; at most the limit passes."""
    aggs = {f"r{i}": F.avg(F.col(c).isNull().cast("int")) for i, c in enumerate(limits)}
    rows = [
        _row("null_rate", table, c, F.col(f"r{i}"), most, F.coalesce(F.col(f"r{i}"), F.lit(0.0)) <= most)
        for i, (c, most) in enumerate(limits.items())
    ]
    return _report(df, aggs, rows)


def check_range(df: DataFrame, table: str, ranges: Mapping[str, tuple[float, float]], name: str = "range") -> DataFrame:
    """Rows outside [lo, hi] per column, in one pass; NULLs are not judged."""
    aggs = {f"n{i}": F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for i, (c, (lo, hi)) in enumerate(ranges.items())}
    rows = [_row(name, table, c, F.col(f"n{i}"), 0, F.col(f"n{i}") == 0) for i, c in enumerate(ranges)]
    return _report(df, aggs, rows)


def check_geo_bounds(df: DataFrame, table: str, lat: str, lon: str, box=US_BOX) -> DataFrame:
    return check_range(df, table, {lat: box[:2], lon: box[2:]}, "geo_bounds")


def check_no_future(df: DataFrame, table: str, column: str, as_of: str) -> DataFrame:
    late = F.count_if(F.col(column) > F.lit(as_of).cast("timestamp_ntz"))
    return _report(df, {"n": late}, [_row("no_future", table, column, F.col("n"), 0, F.col("n") == 0)])


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose key has no parent; a NULL key is not an orphan."""
    keys = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def check_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str, table: str) -> DataFrame:
    """Number of orphan rows. Keys are counted first, so a hot key is one row in the join."""
    per_key = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("_n"))
    lost = orphans(per_key, parent, fk, pk)
    n = F.coalesce(F.col("n"), F.lit(0))
    return _report(lost, {"n": F.sum("_n")}, [_row("foreign_key", table, fk, n, 0, n == 0)])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    return _report(
        duplicate_keys(df, keys),
        {"n": F.count("*")},
        [_row("unique", table, ",".join(keys), F.col("n"), 0, F.col("n") == 0)],
    )


def check_reconciles(src: DataFrame, agg: DataFrame, keys: Sequence[str], table: str, count: str = "incident_count") -> DataFrame:
    """Groups whose recount from the source differs from the aggregate, missing ones included."""
    a = src.groupBy(*keys).agg(F.count("*").alias("_src"))
    b = agg.groupBy(*keys).agg(F.sum(count).alias("_agg"))
    tagged = a.withColumn("_agg", F.lit(0).cast("long")).unionByName(b.withColumn("_src", F.lit(0).cast("long")))
    both = tagged.groupBy(*keys).agg(F.sum("_src").alias("_src"), F.sum("_agg").alias("_agg"))
    bad = F.count_if(F.col("_src") != F.col("_agg"))
    return _report(both, {"n": bad}, [_row("reconciles", table, count, F.col("n"), 0, F.col("n") == 0)])


def check_data_loss(src: DataFrame, agg: DataFrame, table: str, count: str = "incident_count", max_pct: float = 5.0) -> DataFrame:
    """Percent of source rows that the aggregate no longer counts."""
    kept = agg.agg(F.coalesce(F.sum(count), F.lit(0))).scalar()
    lost = (F.col("n") - kept) * 100.0 / F.nullif(F.col("n"), F.lit(0))
    lost = F.coalesce(lost, F.lit(0.0))
    return _report(src, {"n": F.count("*")}, [_row("data_loss_pct", table, count, lost, max_pct, lost <= max_pct)])


def check_known_points(df: DataFrame, expected: DataFrame, km: float, table: str, key: str = "bridge_id", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distance in km of each known place (``key, known_lat, known_lon``) to where the table has it."""
    here = df.select(key, lat, lon)
    away = geo.point_distance_m(F.col(lat), F.col(lon), F.col("known_lat"), F.col("known_lon")) / 1000
    return expected.join(here, key, "left").select(
        F.lit("known_point").alias("check"),
        F.lit(table).alias("table"),
        F.col(key).cast("string").alias("column"),
        away.alias("observed"),
        F.lit(float(km)).alias("threshold"),
        _status(F.coalesce(away <= km, F.lit(False))).alias("status"),
    )


def check_text(df: DataFrame, table: str, column: str) -> DataFrame:
    empty = F.count_if(F.coalesce(F.length(F.trim(F.col(column))), F.lit(0)) == 0)
    return _report(df, {"n": empty}, [_row("text_not_empty", table, column, F.col("n"), 0, F.col("n") == 0)])

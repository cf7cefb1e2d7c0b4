"""Scalar columns: cleaning, labels, flags, margins and risk replies."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weather labels and their thresholds (mm, inches, miles).
HEAVY_PRCP, DEEP_SNOW, LOW_VISIB = 50, 10, 1
PRECIPITATION = "Heavy precipitation expected"
SNOWFALL = "Significant snowfall"
VISIBILITY = "Low visibility conditions"
NORMAL = "Normal conditions"

# Defaults and class limits of a risk reply.
NEUTRAL_SCORE, DEFAULT_REASON = 0.5, "Heuristic pattern"
HIGH_FROM, MODERATE_FROM = 0.7, 0.4

MISSING_READING = 999.9  # fixed value: the weather feed's code for "no reading"


def _rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    clash = sorted({n for n in names if list(names).count(n) > 1})
    if clash:
        raise ValueError(f"several columns become {clash}")
    return df.toDF(*names)


def normalize_upper(df: DataFrame) -> DataFrame:
    """Upper-case column names with every run of other characters as one ``_``."""
    return _rename(df, [re.sub(r"[^A-Z0-9]+", "_", c.strip().upper()).strip("_") for c in df.columns])


def normalize_lower(df: DataFrame) -> DataFrame:
    """Lower-case column names with blanks as ``_``."""
    return _rename(df, [c.strip().lower().replace(" ", "_") for c in df.columns])


def map_columns(df: DataFrame, ordered_map: Mapping[str, str]) -> DataFrame:
    """Rename and keep mapped columns; of several sources for one target the first wins."""
    chosen: dict[str, str] = {}
    for source, target in ordered_map.items():
        if source in df.columns:
            chosen.setdefault(target, source)
    return df.select(*[F.col(source).alias(target) for target, source in chosen.items()])


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are NULL, bad cells too."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def parse_dates(df: DataFrame, formats: Mapping[str, Sequence[str]], kind: str = "date") -> DataFrame:
    """Parse text columns by the first format that fits; NULL when none does."""
    parse = {
        "date": lambda c, f: F.expr(f"try_to_date(`{c}`, '{f}')"),
        "timestamp": lambda c, f: F.expr(f"cast(try_to_timestamp(`{c}`, '{f}') as timestamp_ntz)"),
    }[kind]
    return df.withColumns({c: F.coalesce(*[parse(c, f) for f in fs]) for c, fs in formats.items()})


def with_loaded_at(df: DataFrame, name: str = "_ingested_at") -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def point(lat: Column, lon: Column) -> Column:
    """``struct(lat, lon)``, NULL when either part is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def point_text(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def null_sentinel(value: Column, sentinel: float = MISSING_READING) -> Column:
    return F.nullif(value, F.lit(sentinel))


def weather_alert(prcp: Column, sndp: Column, visib: Column) -> Column:
    """First label whose reading is beyond its limit; a missing reading never is."""
    return (
        F.when(prcp > HEAVY_PRCP, PRECIPITATION)
        .when(sndp > DEEP_SNOW, SNOWFALL)
        .when(visib < LOW_VISIB, VISIBILITY)
        .otherwise(NORMAL)
    )


def alert_sentence(station: Column, alert: Column, date: Column) -> Column:
    return F.concat(
        F.lit("Station "), station.cast("string"), F.lit(" reports "), alert, F.lit(" on "), date.cast("string")
    )


def delay_days(real: Column, scheduled: Column) -> Column:
    return real - scheduled


def risk_flag(flag: Column) -> Column:
    return flag.try_cast("int")


def weight_margin(limit: Column, weight: Column) -> Column:
    """How many times the vehicle the bridge carries; NULL for a weightless vehicle."""
    return limit / F.nullif(weight, F.lit(0.0))


def clearance_margin(clearance: Column, height: Column) -> Column:
    return clearance - height


def violates(limit: Column, weight: Column, clearance: Column, height: Column) -> Column:
    """Strictly below either need; equal passes and an unknown limit never fails."""
    return F.coalesce(limit < weight, F.lit(False)) | F.coalesce(clearance < height, F.lit(False))


def risk_class(score: Column) -> Column:
    return (
        F.when(score >= HIGH_FROM, "HIGH RISK").when(score >= MODERATE_FROM, "MODERATE RISK").otherwise("LOW RISK")
    )


def parse_risk(reply: Column) -> Column:
    """``struct(score, reason)`` of a "score, reason" reply, score within [0, 1]."""
    parts = F.split(reply, ",", 2)
    score = F.coalesce(F.trim(parts[0]).try_cast("double"), F.lit(NEUTRAL_SCORE))
    reason = F.coalesce(F.trim(F.get(parts, 1)), F.lit(DEFAULT_REASON))
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), reason.alias("reason"))


def transit_hours(miles: Column, mph: Column) -> Column:
    return F.when(mph > 0, F.round(miles / mph, 1))


def transit_error(mph: Column) -> Column:
    return F.when(mph > 0, F.lit(None)).otherwise("Speed must be > 0")


def flag01(flag: Column) -> Column:
    """1 for true, 0 for false and for unknown."""
    return F.when(flag, 1).otherwise(0)


def contains_ci(text: Column, part: Column | str) -> Column:
    """Case-insensitive "contains"; the part is plain text, never a pattern."""
    part = F.lit(part) if isinstance(part, str) else part
    return F.contains(F.lower(text), F.lower(part))


def contains_all_ci(wanted: Mapping[str, str]) -> Column:
    out = F.lit(True)
    for column, part in wanted.items():
        out = out & contains_ci(F.col(column), part)
    return out


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A repeatable shuffle key: the same for a row whatever the partitioning."""
    return F.xxhash64(key, F.lit(seed))


def source_ids(key: Column) -> Column:
    return F.array(key)


def in_years(date: Column, years: Sequence[int]) -> Column:
    """Date within any of the years, as ranges, so that files and row groups are skipped."""
    out = F.lit(False)
    for first, last in _runs(sorted(set(years))):
        out = out | ((date >= F.lit(f"{first}-01-01").cast("date")) & (date < F.lit(f"{last + 1}-01-01").cast("date")))
    return out


def _runs(years: Sequence[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for y in years:
        if runs and runs[-1][1] == y - 1:
            runs[-1] = (runs[-1][0], y)
        else:
            runs.append((y, y))
    return runs

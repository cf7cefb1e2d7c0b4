"""Incidents and weather as two streams, joined on place and time within watermarks."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from midmile.streaming.feeds import _start

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package


def within(incidents: DataFrame, weather: DataFrame, before: str = "2 hours", after: str = "0 seconds") -> DataFrame:
    """Every incident with the readings of its place from ``before`` it to ``after`` it, for batch and stream alike.

    ``incidents(place, start_time, ...)``, ``weather(place, observed_at, ...)``. As streams both need watermarks; the interval then bounds how long
    rows are kept on either side.
    """
    right = weather.withColumnRenamed("place", "_place")
    near = F.expr(f"observed_at >= start_time - INTERVAL {before} AND observed_at <= start_time + INTERVAL {after}")
    return incidents.join(right, (F.col("place") == F.col("_place")) & near).drop("_place")


def _figures(width_us: int, before_us: int, after_us: int):
    """For the incidents of a slice of time: how many readings are near them, how many of those are bad, and the severity of every pair."""

    @F.pandas_udf("readings long, bad_readings long, severity_sum long")
    def count(start: pd.Series, seen: pd.Series, said: pd.Series) -> pd.DataFrame:
        out = []
        for first, incidents, readings in zip(start, seen, said):
            at = np.array([i["at"] for i in incidents], np.int64)
            severity = np.array([0 if i["severity"] is None else i["severity"] for i in incidents], np.int64)
            known = np.array([i["severity"] is not None for i in incidents], bool)
            own = (at >= first) & (at < first + width_us)
            at, severity, known = at[own], severity[own], known[own]
            code = np.sort(np.asarray(readings, np.int64))  # twice the time, and one more for a bad reading
            bad = np.concatenate([[0], np.cumsum(code & 1)])
            lo, hi = np.searchsorted(code, 2 * (at - before_us)), np.searchsorted(code, 2 * (at + after_us) + 2)
            n = hi - lo
            told = bool((known & (n > 0)).any())
            out.append((n.sum(), (bad[hi] - bad[lo]).sum(), (severity * n).sum() if told else None))
        return pd.DataFrame(out, columns=["readings", "bad_readings", "severity_sum"]).astype({"severity_sum": "Int64"})

    return count


def _micros(length: str) -> int:
    return int(pd.Timedelta(length).value // 1000)


def joined_patches(incidents: DataFrame, weather: DataFrame, bad: Column, size: str = "8 hours", slide: str = "4 hours", before: str = "2 hours", after: str = "0 seconds") -> DataFrame:
    """``place, patch_start, patch_end, readings, bad_readings, severity_sum`` of sliding patches over incidents and the readings near them.

    A row of a patch is an incident with one reading, as in `within`; ``bad`` is a condition on the reading. For batch and stream alike. The pairs
    are never made: time is cut into slices that all patches hold whole or not at all, a slice of a place has its incidents and the readings up to
    ``before`` and ``after`` it, and what an incident has is counted among the sorted readings.
    """
    size_us, slide_us, before_us, after_us = (_micros(x) for x in (size, slide, before, after))
    width_us = math.gcd(size_us, slide_us)
    lengths = lambda us: f"{us} microseconds"
    left = incidents.select("place", F.col("start_time").alias("at"), F.col("severity").cast("long").alias("severity"), F.lit(None).cast("long").alias("code"), F.lit(True).alias("incident"))
    flag = F.coalesce(bad, F.lit(False)).cast("long")
    right = weather.select("place", F.col("observed_at").alias("at"), F.lit(None).cast("long").alias("severity"), (F.unix_micros("observed_at") * 2 + flag).alias("code"), F.lit(False).alias("incident"))
    rows = left.unionByName(right).where(F.col("place").isNotNull() & F.col("at").isNotNull())
    slice_ = F.window("at", lengths(width_us + before_us + after_us), lengths(width_us), lengths(-before_us % width_us))
    seen = F.collect_list(F.when(F.col("incident"), F.struct(F.unix_micros("at").alias("at"), "severity"))).alias("seen")
    grouped = rows.groupBy("place", slice_.alias("w")).agg(seen, F.collect_list("code").alias("said"))
    first = F.unix_micros("w.start") + before_us
    met = grouped.where((F.size("seen") > 0) & (F.size("said") > 0)).select("place", F.window_time("w").alias("at"), _figures(width_us, before_us, after_us)(first, "seen", "said").alias("f"))
    # a slice ends ``after`` later than its incidents, and so do its patches
    patch = F.window("at", lengths(size_us), lengths(slide_us), lengths(after_us % slide_us))
    sums = met.where("f.readings > 0").groupBy("place", patch.alias("w")).agg(*[F.sum(f"f.{c}").alias(c) for c in ("readings", "bad_readings", "severity_sum")])
    back = F.expr(f"INTERVAL '{after_us / 1e6:.6f}' SECOND")
    return sums.select("place", (F.col("w.start") - back).alias("patch_start"), (F.col("w.end") - back).alias("patch_end"), "readings", "bad_readings", "severity_sum")


def stream_joined_patches(
    incidents: DataFrame, weather: DataFrame, bad: Column, dst: str, ckpt: str, delay: str = "2 hours", size: str = "8 hours", slide: str = "4 hours",
    before: str = "2 hours", after: str = "0 seconds", trigger: str | None = None,
) -> StreamingQuery:
    """The patches as a stream: one is written when both watermarks have passed it, once and for good.

    Rows later than ``delay`` may be left out, as are patches that end after the watermark of the last batch; the batch form has them.
    """
    left = incidents.withWatermark("start_time", delay)
    right = weather.withWatermark("observed_at", delay)
    patches = joined_patches(left, right, bad, size, slide, before, after)
    writer = patches.writeStream.outputMode("append").format("parquet").option("path", dst).option("checkpointLocation", ckpt)
    return _start(writer, trigger)

"""Hourly heatmap with keyed state and timers: late rows are corrections, none is lost.

Every state and city keeps its open hours. An hour has a timer for when the watermark passes its end: it is then
sent out for good and forgotten. A row for a closed hour goes out as a correction, which readers add to the hour.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from midmile.sources.schema import columns
from midmile.streaming.feeds import _start

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no installed copy of this package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, CLOSED, LATE = "open", "closed", "late"
OUT = "state string, city string, hour timestamp, incident_count bigint, severity_sum bigint, kind string"
HOUR = 3_600_000_000  # times in the state are microseconds


class HourlyState(StatefulProcessor):
    """Open hours of one place: their counts and sums of severity."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "n bigint, severity bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows of a batch may come in several frames; lateness goes by the batches before, so their order does not matter."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        changed, late = {}, {}
        for pdf in rows:
            known = pdf[pdf["at"].notna()]
            at = known["at"].astype("datetime64[us]").astype("int64")
            found = pd.DataFrame({"hour": at - at % HOUR, "severity": known["severity"].fillna(0).astype("int64")})
            sums = found.groupby("hour").agg(n=("severity", "size"), severity=("severity", "sum"))
            for hour, n, severity in sums.astype("int64").itertuples():
                sink = late if hour + HOUR <= passed else changed
                n0, s0 = sink.get(hour, (0, 0))
                sink[hour] = (n0 + n, s0 + severity)
        out = [(*key, hour, *figures, LATE) for hour, figures in late.items()]
        for hour, (n, severity) in changed.items():
            n0, s0 = self.hours.getValue((hour,)) if self.hours.containsKey((hour,)) else (0, 0)
            self.hours.updateValue((hour,), (n0 + n, s0 + severity))
            self.handle.registerTimer((hour + HOUR) // 1000)
            out.append((*key, hour, n0 + n, s0 + severity, OPEN))
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = expiredTimerInfo.getExpiryTimeInMs() * 1000 - HOUR
        figures = self.hours.getValue((hour,))
        self.hours.removeKey((hour,))
        yield _frame([(*key, hour, *figures, CLOSED)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["state", "city", "hour", "incident_count", "severity_sum", "kind"])
    return out.astype({"hour": "datetime64[us]", "incident_count": "int64", "severity_sum": "int64"})


def stream_keyed_heatmap(stream: DataFrame, dst: str, ckpt: str, delay: str = "2 hours", trigger: str | None = None) -> StreamingQuery:
    """Heatmap of ``stream(state, city, start_time, severity)`` in ``dst``: hours as they change, when they close, and corrections.

    Each batch writes a folder of its own, so a repeated batch replaces itself. State is kept in RocksDB: the open
    hours of each place. Rows without a time are left out, null places are a place.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the time is taken anew, as rows later than the watermark of its own column would be dropped
    at = (F.col("start_time") + F.expr("INTERVAL 0 SECONDS")).alias("at")
    rows = stream.withWatermark("start_time", delay).select("state", "city", at, F.col("severity").cast("long").alias("severity"))
    hours = rows.groupBy("state", "city").transformWithStateInPandas(
        statefulProcessor=HourlyState(), outputStructType=OUT, outputMode="Update", timeMode="EventTime"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch_id={batch_id}")

    return _start(hours.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt), trigger)


def keyed_heatmap(spark: SparkSession, dst: str) -> DataFrame:
    """``state, city, hour, incident_count, avg_severity, corrections``: the latest figures of every hour and all that came late."""
    rows = spark.read.schema(columns(f"{OUT}, batch_id bigint")).parquet(dst)
    late = F.col("kind") == LATE
    place = F.struct(F.col("batch_id"), (F.col("kind") == CLOSED).cast("int"))
    known = rows.groupBy("state", "city", "hour").agg(
        F.max_by(F.when(~late, F.col("incident_count")), F.when(~late, place)).alias("n"),
        F.max_by(F.when(~late, F.col("severity_sum")), F.when(~late, place)).alias("s"),
        F.sum(F.when(late, F.col("incident_count"))).alias("more"),
        F.sum(F.when(late, F.col("severity_sum"))).alias("more_s"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, s = zero(F.col("n")) + zero(F.col("more")), zero(F.col("s")) + zero(F.col("more_s"))
    return known.select("state", "city", "hour", n.alias("incident_count"), (s / n).alias("avg_severity"), zero(F.col("more")).alias("corrections"))



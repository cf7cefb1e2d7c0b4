"""Arriving files, fresh heatmaps, patches and the audit log as streams.

Every stream ends after what has arrived (``availableNow``), unless a trigger is given;
its checkpoint makes a restart read each file once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from midmile.sources.schema import columns

BAD_ROW = "_corrupt_record"
FILES_PER_BATCH = 1000


def _start(writer, trigger: str | None) -> StreamingQuery:
    if trigger:
        return writer.trigger(processingTime=trigger).start()
    return writer.trigger(availableNow=True).start()


def read_feed(spark: SparkSession, src: str, schema: T.StructType, fmt: str = "csv", **options: str) -> DataFrame:
    """Files that arrive in ``src``, at most ``FILES_PER_BATCH`` in a batch; a CSV header unlike the schema is an error."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).options(**options)
    return reader.option("header", True).option("enforceSchema", False).csv(src) if fmt == "csv" else reader.format(fmt).load(src)


def stream_files(spark: SparkSession, src: str, schema: T.StructType, dst: str, ckpt: str, trigger: str | None = None) -> StreamingQuery:
    """CSV files that arrive in ``src``, appended to a Parquet table once each."""
    feed = read_feed(spark, src, schema)
    return _start(feed.writeStream.format("parquet").option("path", dst).option("checkpointLocation", ckpt), trigger)


def load_new(spark: SparkSession, src: str, dst: str, schema: T.StructType, ckpt: str) -> int:
    """Load what is new since the last call and return; the number of rows loaded, counted in the table itself."""
    before = _rows(spark, schema, dst)
    stream_files(spark, src, schema, dst, ckpt).awaitTermination()
    return _rows(spark, schema, dst) - before


def _rows(spark: SparkSession, schema: T.StructType, path: str) -> int:
    """Rows of a table by its file footers; 0 if it is not there yet."""
    try:
        return spark.read.schema(schema).parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def stream_with_quarantine(
    spark: SparkSession, src: str, schema: T.StructType, dst: str, bad_dst: str, ckpt: str, trigger: str | None = None,
    clean: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> StreamingQuery:
    """Rows that do not fit the schema go to ``bad_dst`` as text; the load goes on.

    ``clean`` makes the table's columns of the rows that fit.
    A batch writes folders of its own, so a repeated batch replaces itself.
    """
    with_bad = T.StructType(schema.fields + [T.StructField(BAD_ROW, T.StringType())])
    feed = read_feed(spark, src, with_bad, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        good = kept.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW)
        clean(good).write.mode("overwrite").parquet(f"{dst}/batch_id={batch_id}")
        bad = kept.where(F.col(BAD_ROW).isNotNull()).select(BAD_ROW)
        bad.write.mode("overwrite").parquet(f"{bad_dst}/batch_id={batch_id}")
        kept.unpersist()

    return _start(feed.writeStream.foreachBatch(write).option("checkpointLocation", ckpt), trigger)


def hourly(accidents: DataFrame) -> DataFrame:
    """Incidents and mean severity by state, city and hour, for batch and stream alike."""
    hour = F.window("start_time", "1 hour")
    return accidents.groupBy("state", "city", hour.alias("w")).agg(
        F.count("*").alias("incident_count"), F.avg("severity").alias("avg_severity")
    ).select("state", "city", F.col("w.start").alias("hour"), "incident_count", "avg_severity")


def stream_heatmap(stream: DataFrame, dst: str, ckpt: str, delay: str = "2 hours", trigger: str | None = None) -> StreamingQuery:
    """Hourly heatmap that is refreshed with every batch.

    Rows later than ``delay`` are dropped here and appear with the next batch heatmap.
    Each batch writes the hours it changed; ``fresh_heatmap`` reads the latest of each, and
    ``compact_heatmap`` folds old batches into one table.
    """
    fresh = hourly(stream.withWatermark("start_time", delay))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batches/batch_id={batch_id}")

    writer = fresh.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", ckpt)
    return _start(writer, trigger)


_HEAT = columns("state string, city string, hour timestamp, incident_count bigint, avg_severity double")


def _compacted(spark: SparkSession, dst: str) -> int:
    """The last batch that a finished compaction holds, -1 if there is none."""
    try:
        last = spark.read.schema(columns("upto bigint")).parquet(f"{dst}/compactions").agg(F.max("upto")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return -1 if last is None else last


def _heat_rows(spark: SparkSession, dst: str, upto: int) -> DataFrame:
    """Rows of the compaction and of the batches after it, with their ``batch_id``; older folders are not read."""
    with_id = T.StructType(_HEAT.fields + [T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(with_id).parquet(f"{dst}/batches").where(F.col("batch_id") > upto)
    if upto < 0:
        return rows
    return rows.unionByName(spark.read.schema(_HEAT).parquet(f"{dst}/compacted-{upto}").withColumn("batch_id", F.lit(upto).cast("long")))


def _latest(rows: DataFrame) -> DataFrame:
    figures = F.struct("incident_count", "avg_severity")
    latest = rows.groupBy("state", "city", "hour").agg(F.max_by(figures, "batch_id").alias("f"))
    return latest.select("state", "city", "hour", "f.*")


def fresh_heatmap(spark: SparkSession, dst: str) -> DataFrame:
    return _latest(_heat_rows(spark, dst, _compacted(spark, dst)))


def compact_heatmap(spark: SparkSession, dst: str) -> None:
    """Fold all batches but the last, which a restart may write again, into one table that is read in their place.

    The compaction is noted when it is whole, so one that broke off is written anew.
    """
    upto = _compacted(spark, dst)
    rows = _heat_rows(spark, dst, upto)
    last = rows.agg(F.max("batch_id")).first()[0]
    if last is None or last - 1 <= upto:
        return
    _latest(rows.where(F.col("batch_id") < last)).write.mode("overwrite").parquet(f"{dst}/compacted-{last - 1}")
    spark.range(1).select(F.lit(last - 1).cast("long").alias("upto")).write.mode("append").parquet(f"{dst}/compactions")


def patches(df: DataFrame, time: str, value: Column, size: str = "8 hours", slide: str = "4 hours") -> DataFrame:
    """Sliding windows with their number of rows and mean value, for batch and stream alike."""
    return df.groupBy(F.window(time, size, slide).alias("w")).agg(
        F.count("*").alias("incidents"), F.avg(value).alias("mean_value")
    ).select(F.col("w.start").alias("patch_start"), F.col("w.end").alias("patch_end"), "incidents", "mean_value")


def stream_log(spark: SparkSession, src: str, schema: T.StructType, dst: str, ckpt: str, trigger: str | None = None) -> StreamingQuery:
    """Log lines that arrive as JSON files, appended to the audit table."""
    feed = read_feed(spark, src, schema, fmt="json")
    return _start(feed.writeStream.format("parquet").option("path", dst).option("checkpointLocation", ckpt), trigger)

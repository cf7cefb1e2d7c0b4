"""Session, shared scratch folder and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_scratch: dict[str, str] = {}
_staged: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def session(app: str = "midmile", cores: int | None = None, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the submitted session."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def workspace(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="midmile-")
    return _local_scratch[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the workspace; nothing is ever overwritten there."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one file read, keeps a result
    that several branches need from being computed twice, and gives Catalyst real
    file sizes for its choice between broadcast and shuffle joins. Nothing reads the shuffles
    that made it afterwards, so their files go at once and not when the driver's memory is next collected.
    """
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    was = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, was)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _staged[table] = path
    return table


def release(table: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more: what was made of it must be staged itself by now."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop(table))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_staged(df: DataFrame) -> bool:
    """Whether ``df`` is a staged table itself: a repeated task reads its rows in the same order."""
    return df in _staged

"""Sinks: overwrite, append, replace, view, audit log and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from midmile.sources.tables import GOLD


def write_full(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def write_append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def write_replace(df: DataFrame, table: str) -> None:
    """Replace rows and schema, so that a re-run with other columns succeeds."""
    df.write.mode("overwrite").option("overwriteSchema", True).saveAsTable(table)


def publish_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def log_rows(df: DataFrame) -> DataFrame:
    """Log lines from ``user_id, query_text, response_text, sources (JSON text), execution_time_ms, is_grounded``."""
    return df.select(
        F.expr("uuid()").alias("query_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "query_text",
        "response_text",
        F.from_json("sources", "array<string>").alias("grounding_sources"),
        F.col("execution_time_ms").cast("bigint").alias("execution_time_ms"),
        "is_grounded",
        F.current_timestamp().alias("created_at"),
    )


def append_log(df: DataFrame, table: str) -> None:
    rows = log_rows(df)
    write_append(rows.select(*GOLD["query_logs"].fieldNames()), table)


def write_results(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.json(path)

"""Typed table definitions of the three layers and their introspection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.operators.silver import UNIFIED
from midmile.sources.schema import columns

_STAMPED_UNIFIED = T.StructType(UNIFIED.fields + [T.StructField("_ingested_at", T.TimestampType())])

BRONZE = {
    "traffic_incidents": columns(
        "accident_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_lat double, start_lng double, "
        "end_lat double, end_lng double, distance double, description string, street string, city string, "
        "county string, state string, zipcode string, weather_condition string, severity int"
    ),
    "noaa_gsod": columns(
        "station string, date date, latitude double, longitude double, elevation double, name string, "
        "temp double, temp_attributes int, dewp double, dewp_attributes int, slp double, slp_attributes int, "
        "stp double, stp_attributes int, visib double, visib_attributes int, wdsp double, wdsp_attributes int, "
        "mxspd double, gust double, max double, max_attributes string, min double, min_attributes string, "
        "prcp double, prcp_attributes string, sndp double, frshtt string"
    ),
    "bridge_inventory": columns(
        "bridge_id string, bridge_name string, state_code int, condition string, clearance_mt double, "
        "load_limit_tons double, latitude double, longitude double"
    ),
    "raw_logistics": columns(
        "order_id string, order_date date, shipping_date date, delivery_date date, shipping_mode string, "
        "days_for_shipping_real int, days_for_shipment_scheduled int, late_delivery_risk string"
    ),
    "logistics": _STAMPED_UNIFIED,
}
SILVER = {
    "risk_heatmap": columns(
        "state string, city string, hour timestamp_ntz, incident_count bigint, avg_severity double, _updated_at timestamp"
    ),
    "weather_alerts": columns(
        "station string, date date, latitude double, longitude double, temp double, prcp double, sndp double, "
        "visib double, weather_alert string, alert_description string"
    ),
    "bridge_inventory_geo": columns(
        "bridge_id string, bridge_name string, state_code int, condition string, clearance_mt double, "
        "load_limit_tons double, latitude double, longitude double, location point, _processed_at timestamp"
    ),
    "cleaned_logistics": columns(
        "order_id string, order_date date, shipping_date date, delivery_date date, shipping_mode string, "
        "late_delivery_risk string, delay_days int, late_delivery_risk_score int, delay_propensity double, "
        "delay_zscore double, _inserted_at timestamp"
    ),
    "logistics_vectorized": columns(
        "chunk_id string, record_type string, text_content string, metadata string, embedding floats, "
        "source_record_ids strings, _vectorized_at timestamp"
    ),
}
GOLD = {
    "vector_embeddings": columns("chunk_id string, text_content string, embedding floats, _created_at timestamp"),
    "disruption_reports": columns(
        "report_id string, route_id string, location point, severity int, summary string, "
        "created_at timestamp"
    ),
    "query_logs": columns(
        "query_id string, user_id string, query_text string, response_text string, grounding_sources strings, "
        "execution_time_ms bigint, is_grounded boolean, created_at timestamp"
    ),
}
LAYERS = {"bronze": BRONZE, "silver": SILVER, "gold": GOLD}


def create_layer(spark: SparkSession, database: str, tables: Mapping[str, T.StructType], location: str | None = None) -> list[str]:
    """Create the database and its empty Parquet tables where they are missing."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")
    for name, schema in tables.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.catalog.createTable(f"{database}.{name}", schema=schema, source="parquet")
    return [f"{database}.{name}" for name in tables]


def describe_columns(spark: SparkSession, database: str) -> DataFrame:
    """One row per column of a database: ``table_name, position, column_name, data_type``."""
    rows = [
        (t.name, i, c.name, c.dataType)
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")


def with_stamp(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.current_timestamp())

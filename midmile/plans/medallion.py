"""Bronze loads, silver jobs and their verification, one function per dataset.

Every load replaces its bronze table and every job its silver table, so a re-run gives
the same result. ``bronze`` and ``silver`` are database names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from midmile.functions import columns as C
from midmile.operators import analytics as A
from midmile.operators import quality as Q
from midmile.operators import silver as S
from midmile.operators.retrieval import embed_text
from midmile.sources import readers, tables, writers
from midmile.streaming import feeds

# Cleaned header name -> bronze column.
ACCIDENT_COLUMNS = {
    "ID": "accident_id", "START_TIME": "start_time", "END_TIME": "end_time", "START_LAT": "start_lat",
    "START_LNG": "start_lng", "END_LAT": "end_lat", "END_LNG": "end_lng", "DISTANCE_MI": "distance",
    "DESCRIPTION": "description", "STREET": "street", "CITY": "city", "COUNTY": "county", "STATE": "state",
    "ZIPCODE": "zipcode", "WEATHER_CONDITION": "weather_condition", "SEVERITY": "severity",
}
BRIDGE_COLUMNS = {
    "STRUCTURE_NUMBER_008": "bridge_id", "FEATURES_DESC_006A": "bridge_name", "STATE_CODE_001": "state_code",
    "BRIDGE_CONDITION": "condition", "VERT_CLR_OVER_MT_053": "clearance_mt", "OPERATING_RATING_064": "load_limit_tons",
    "LATDD": "latitude", "LONGDD": "longitude",
}
ORDER_COLUMNS = {
    "ORDER_ID": "order_id", "ORDER_DATE_DATEORDERS": "order_date", "SHIPPING_DATE_DATEORDERS": "shipping_date",
    "DELIVERY_DATE": "delivery_date", "SHIPPING_MODE": "shipping_mode", "DAYS_FOR_SHIPPING_REAL": "days_for_shipping_real",
    "DAYS_FOR_SHIPMENT_SCHEDULED": "days_for_shipment_scheduled", "LATE_DELIVERY_RISK": "late_delivery_risk",
}
# Accepted date texts, and the columns each silver table must have.
DAY_FORMATS = ["MM/dd/yyyy", "yyyy-MM-dd"]
ORDER_DAY_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy", "yyyy-MM-dd"]
REQUIRED = {
    "risk_heatmap": ["state", "city", "incident_count", "avg_severity", "_updated_at"],
    "bridge_inventory_geo": ["bridge_id", "location", "clearance_mt", "load_limit_tons", "_processed_at"],
    "cleaned_logistics": [
        "order_id", "order_date", "shipping_date", "delivery_date", "shipping_mode", "late_delivery_risk", "delay_days",
        "delay_propensity", "_inserted_at",
    ],
    "logistics_vectorized": ["chunk_id", "record_type", "text_content", "metadata", "source_record_ids", "_vectorized_at"],
}


def _bronze(raw: DataFrame, mapping: Mapping[str, str], table: str) -> DataFrame:
    return C.conform(C.map_columns(C.normalize_upper(raw), mapping), tables.BRONZE[table])


def _orders(raw: DataFrame) -> DataFrame:
    named = C.map_columns(C.normalize_upper(raw), ORDER_COLUMNS)
    days = {c: ORDER_DAY_FORMATS for c in ("order_date", "shipping_date", "delivery_date") if c in named.columns}
    return C.conform(C.parse_dates(named, days), tables.BRONZE["raw_logistics"])


def feed(spark: SparkSession, dataset: str, src: str, header: Sequence[str], dst: str, bad_dst: str, ckpt: str) -> None:
    """Load the files of a dataset that arrived in ``src`` since the last call, each once.

    ``dataset`` is ``accidents``, ``bridges``, ``orders`` or the name of an operation file. Files have
    the columns ``header``, which are mapped as in the batch loads; another header is an error. Lines
    with too few or too many cells go to ``bad_dst``, cells that do not fit become NULL.
    """
    clean = {
        "accidents": lambda raw: _bronze(raw, ACCIDENT_COLUMNS, "traffic_incidents"),
        "bridges": lambda raw: _bronze(raw, BRIDGE_COLUMNS, "bridge_inventory"),
        "orders": _orders,
        **{file: lambda raw, kind=kind: S.unify(raw, kind) for file, kind in S.RECORD_FILES.items()},
    }[dataset]
    feeds.stream_with_quarantine(spark, src, readers.all_text(header), dst, bad_dst, ckpt, clean=clean).awaitTermination()


def ingest_accidents(spark: SparkSession, path: str, bronze: str) -> None:
    rows = _bronze(readers.scan_by_header(spark, path), ACCIDENT_COLUMNS, "traffic_incidents")
    writers.write_replace(rows, f"{bronze}.traffic_incidents")


def ingest_bridges(spark: SparkSession, path: str, bronze: str) -> None:
    rows = _bronze(readers.scan_by_header(spark, path), BRIDGE_COLUMNS, "bridge_inventory")
    writers.write_replace(rows, f"{bronze}.bridge_inventory")


def ingest_orders(spark: SparkSession, path: str, bronze: str, encoding: str = "ISO-8859-1") -> None:
    writers.write_replace(_orders(readers.scan_by_header(spark, path, encoding)), f"{bronze}.raw_logistics")


def ingest_weather(spark: SparkSession, path: str, bronze: str) -> None:
    """Station files by column position; bad cells become NULL."""
    schema = tables.BRONZE["noaa_gsod"]
    day = F.coalesce(*[F.expr(f"try_to_date(date, '{f}')") for f in DAY_FORMATS])
    casts = {f.name: day if f.name == "date" else F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    rows = readers.scan_positional(spark, path, schema.fieldNames(), casts)
    rows = rows.withColumn("data_year", F.year("date"))
    rows.write.mode("overwrite").partitionBy("data_year").saveAsTable(f"{bronze}.noaa_gsod")


def ingest_operations(spark: SparkSession, folder: str, bronze: str) -> None:
    """The operation files that are present, as unified records with ids."""
    parts = [
        S.unify(readers.scan_by_header(spark, f"{folder}/{file}"), kind)
        for file, kind in S.RECORD_FILES.items()
        if readers.file_exists(spark, f"{folder}/{file}")
    ]
    if not parts:
        raise FileNotFoundError(f"no operation file in {folder}")
    rows = C.with_loaded_at(S.with_record_id(S.union_records(parts), from_files=True))
    writers.write_replace(rows, f"{bronze}.logistics")


def _save(df: DataFrame, silver: str, table: str, stamp: str | None) -> None:
    df = tables.with_stamp(df, stamp) if stamp else df
    writers.write_full(df.select(*tables.SILVER[table].fieldNames()), f"{silver}.{table}")


def preprocess_accidents(spark: SparkSession, bronze: str, silver: str) -> None:
    _save(A.risk_heatmap(spark.table(f"{bronze}.traffic_incidents")), silver, "risk_heatmap", "_updated_at")


def preprocess_weather(spark: SparkSession, bronze: str, silver: str, years: Sequence[int]) -> None:
    """Alerts of the given years; the year folders keep the others unread."""
    readings = spark.table(f"{bronze}.noaa_gsod").where(F.col("data_year").isin(*years))
    _save(S.weather_alerts(readings, years), silver, "weather_alerts", None)


def preprocess_bridges(spark: SparkSession, bronze: str, silver: str) -> None:
    _save(S.bridge_points(spark.table(f"{bronze}.bridge_inventory")), silver, "bridge_inventory_geo", "_processed_at")


def preprocess_orders(spark: SparkSession, bronze: str, silver: str) -> None:
    rows = S.delay_zscore(S.delay_propensity(S.shipment_delays(spark.table(f"{bronze}.raw_logistics"))))
    _save(rows, silver, "cleaned_logistics", "_inserted_at")


def preprocess_operations(spark: SparkSession, bronze: str, silver: str) -> None:
    """Text chunks of the operation records with their vectors."""
    chunks = S.text_chunks(spark.table(f"{bronze}.logistics"))
    _save(embed_text(chunks, "text_content"), silver, "logistics_vectorized", "_vectorized_at")


def verify(spark: SparkSession, silver: str, minima: Mapping[str, int]) -> DataFrame:
    """Row minima and required columns of the silver tables, one line per check."""
    counts = Q.check_min_rows({t: spark.table(f"{silver}.{t}") for t in minima}, minima)
    wanted = [(t, c) for t, cs in REQUIRED.items() for c in cs]
    required = spark.createDataFrame(wanted, "table_name string, column_name string")
    present = Q.check_columns(tables.describe_columns(spark, silver), required)
    return reduce(DataFrame.unionByName, [counts, present])

"""Silver tables: weather alerts, shipment delays, bridge points, operation records and their text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions import columns as C
from midmile.operators.ranking import row_index
from midmile.runtime import stage

# The unified operations record, in order.
_TEXT = ["record_id", "record_type", "load_id", "trip_id", "driver_id", "truck_id", "trailer_id",
         "customer_id", "facility_id", "route_id", "origin_city", "destination_city"]
UNIFIED = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [
        T.StructField("distance_miles", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("fuel_gallons", T.DoubleType()),
        T.StructField("fuel_cost", T.DoubleType()),
        T.StructField("maintenance_type", T.StringType()),
        T.StructField("maintenance_cost", T.DoubleType()),
        T.StructField("delivery_status", T.StringType()),
        T.StructField("on_time_flag", T.BooleanType()),
        T.StructField("detention_minutes", T.DoubleType()),
        T.StructField("safety_incident_type", T.StringType()),
        T.StructField("booking_type", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("description", T.StringType()),
    ]
)

# Source column -> unified column; a source named earlier wins its target.
SOURCE_COLUMNS = {
    **{c: c for c in _TEXT[2:]},
    "distance_miles": "distance_miles",
    "revenue": "revenue",
    "total_cost": "cost",
    "cost": "cost",
    "fuel_gallons": "fuel_gallons",
    "fuel_cost": "fuel_cost",
    "maintenance_type": "maintenance_type",
    "service_type": "maintenance_type",
    "maintenance_cost": "maintenance_cost",
    "delivery_status": "delivery_status",
    "status": "delivery_status",
    "on_time": "on_time_flag",
    "detention_minutes": "detention_minutes",
    "incident_type": "safety_incident_type",
    "booking_type": "booking_type",
    "event_date": "event_date",
    "date": "event_date",
    "event_timestamp": "event_timestamp",
    "timestamp": "event_timestamp",
    "description": "description",
    "notes": "description",
}

# File name -> record type.
RECORD_FILES = {
    "loads.csv": "load",
    "trips.csv": "trip",
    "drivers.csv": "driver",
    "trucks.csv": "truck",
    "trailers.csv": "trailer",
    "customers.csv": "customer",
    "facilities.csv": "facility",
    "routes.csv": "route",
    "fuel_purchases.csv": "fuel",
    "maintenance_records.csv": "maintenance",
    "delivery_events.csv": "delivery",
    "safety_incidents.csv": "safety",
    "driver_monthly_metrics.csv": "driver_metric",
    "truck_utilization_metrics.csv": "truck_metric",
}

# Sentence per record type, with {column} places.
SENTENCES = {
    "load": "Load {load_id}: {origin_city} → {destination_city}, {distance_miles} miles, revenue ${revenue}, "
            "cost ${cost}, booking type: {booking_type}, status: {delivery_status}.",
    "trip": "Trip {trip_id}: Driver {driver_id} in truck {truck_id}, {origin_city} → {destination_city}, "
            "{distance_miles} miles on {event_date}.",
    "fuel": "Fuel purchase: {fuel_gallons} gal at ${fuel_cost} for truck {truck_id} on {event_date}.",
    "maintenance": "Maintenance for truck {truck_id}: {maintenance_type}, cost ${maintenance_cost} on {event_date}. "
                   "Notes: {description}.",
    "safety": "Safety incident: {safety_incident_type} involving driver {driver_id} on {event_date}. "
              "Details: {description}.",
    "delivery": "Delivery for load {load_id}: Status {delivery_status}, on-time: {on_time_flag}, "
                "detention: {detention_minutes} min on {event_date}.",
    "driver": "Driver {driver_id}: {description}.",
    "truck": "Truck {truck_id}: {description}.",
}
DEFAULT_SENTENCE = "Record {record_id} ({record_type}): {description}."


def weather_alerts(weather: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Readings of the given years with their alert label and sentence."""
    df = weather if years is None else weather.where(C.in_years(F.col("date"), years))
    clean = df.withColumns({c: C.null_sentinel(F.col(c)) for c in ("prcp", "sndp", "visib")})
    return clean.withColumn(
        "weather_alert", C.weather_alert(F.col("prcp"), F.col("sndp"), F.col("visib"))
    ).withColumn("alert_description", C.alert_sentence(F.col("station"), F.col("weather_alert"), F.col("date")))


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("weather_alert") != C.NORMAL)


def shipment_delays(shipments: DataFrame) -> DataFrame:
    """Delay days and the late flag as a number; dates pass through."""
    return shipments.withColumn(
        "delay_days", C.delay_days(F.col("days_for_shipping_real"), F.col("days_for_shipment_scheduled"))
    ).withColumn("late_delivery_risk_score", C.risk_flag(F.col("late_delivery_risk")))


def _with_mode_stats(shipments: DataFrame, *stats: Column) -> DataFrame:
    """Add per-mode figures to every row.

    There are few modes and one may hold most rows, so a window would put whole modes
    in single tasks. The aggregate is staged: its real size lets Catalyst broadcast it.
    """
    per_mode = stage(shipments.groupBy("shipping_mode").agg(*stats), "mode-stats")
    same = F.col("shipping_mode").eqNullSafe(F.col("_mode"))
    return shipments.join(per_mode.withColumnRenamed("shipping_mode", "_mode"), same, "left").drop("_mode")


def delay_propensity(shipments: DataFrame) -> DataFrame:
    """Mean shipping days of the row's mode."""
    return _with_mode_stats(shipments, F.avg("days_for_shipping_real").alias("delay_propensity"))


def delay_zscore(shipments: DataFrame) -> DataFrame:
    """Delay days against their mode: (x - mean) / sample standard deviation, NULL when that is 0."""
    delay = C.delay_days(F.col("days_for_shipping_real"), F.col("days_for_shipment_scheduled"))
    df = shipments.withColumn("delay_days", delay)
    df = _with_mode_stats(df, F.avg("delay_days").alias("_mean"), F.stddev_samp("delay_days").alias("_sd"))
    z = (F.col("delay_days") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return df.withColumn("delay_zscore", z).drop("_mean", "_sd")


def bridge_points(bridges: DataFrame) -> DataFrame:
    """Bridges with a location struct and its text form."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return bridges.withColumn("location", C.point(lat, lon)).withColumn("location_text", C.point_text(lat, lon))


def bridge_display(bridges: DataFrame) -> DataFrame:
    return bridges.select(
        F.col("bridge_name"),
        F.col("state_code"),
        F.col("clearance_mt").alias("vertical_clearance_mt"),
        F.col("load_limit_tons").alias("load_rating"),
        F.col("condition").alias("bridge_condition"),
    )


def low_clearance(bridges: DataFrame, max_m: float, state: int) -> DataFrame:
    return bridges.where((F.col("clearance_mt") < max_m) & (F.col("state_code") == state)).orderBy(
        "clearance_mt", "bridge_id"
    )


# ---- operation records -------------------------------------------------------------


def unify(source: DataFrame, record_type: str) -> DataFrame:
    """One source file as unified records without ids."""
    return C.conform(C.map_columns(C.normalize_lower(source), SOURCE_COLUMNS), UNIFIED).withColumn(
        "record_type", F.lit(record_type)
    )


def union_records(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_record_id(records: DataFrame, order: Sequence[str] | None = None, from_files: bool = False) -> DataFrame:
    """``record_type`` + ``_`` + 0-based position of the record within its type; ``from_files`` as in `row_index`."""
    order = order or [f.name for f in UNIFIED.fields if f.name not in ("record_id", "record_type")]
    keys = [F.col(c).asc_nulls_first() for c in order]
    numbered = row_index(records, keys, "_i", "record_type", from_files)
    rid = F.concat_ws("_", "record_type", F.col("_i").cast("string"))
    return numbered.withColumn("record_id", rid).drop("_i").select(*records.columns)


def _text(column: str) -> Column:
    """A record field as text; money and lengths keep two decimals."""
    kind = UNIFIED[column].dataType
    value = F.col(column)
    if isinstance(kind, T.DoubleType):
        value = value.cast("decimal(18,2)")
    return value.cast("string")


def record_sentence() -> Column:
    """Generic sentence; a section with an unknown part is left out."""
    def section(*parts: str | tuple[str]) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else _text(p[0]) for p in parts])

    return F.concat_ws(
        " ",
        section("Record type: ", ("record_type",), "."),
        section("Route: ", ("origin_city",), " → ", ("destination_city",), ", ", ("distance_miles",), " miles."),
        section("Revenue: $", ("revenue",), ", Cost: $", ("cost",), "."),
        section("Status: ", ("delivery_status",), ", On-time: ", ("on_time_flag",), "."),
        section("Notes: ", ("description",), "."),
    )


def record_sentence_typed(
    templates: Mapping[str, str] = SENTENCES, default: str = DEFAULT_SENTENCE, unknown: str = "unknown"
) -> Column:
    """Sentence by record type from ``{column}`` templates; a missing field reads ``unknown``."""
    def fill(template: str) -> Column:
        parts = []
        for piece in template.split("{"):
            name, closed, rest = piece.partition("}")
            if closed:
                parts += [F.coalesce(_text(name), F.lit(unknown)), F.lit(rest)]
            else:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    out = None
    for record_type, template in templates.items():
        matched = F.col("record_type") == record_type
        out = F.when(matched, fill(template)) if out is None else out.when(matched, fill(template))
    return out.otherwise(fill(default))


def chunk_metadata() -> Column:
    """JSON object of a record's route, ids, date and money; unknown keys are left out."""
    route = F.concat("origin_city", F.lit(" → "), "destination_city")
    return F.to_json(F.struct(route.alias("route"), "driver_id", "truck_id", "event_date", "revenue", "cost"))


def text_chunks(records: DataFrame) -> DataFrame:
    """Chunk table: id, type, text, metadata and source ids of every record."""
    return records.select(
        F.col("record_id").alias("chunk_id"),
        "record_type",
        record_sentence().alias("text_content"),
        chunk_metadata().alias("metadata"),
        C.source_ids(F.col("record_id")).alias("source_record_ids"),
    )

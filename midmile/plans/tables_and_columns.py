"""Registered queries for sources, sinks, columns, filters, orders and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.functions import columns as C
from midmile.functions import geo
from midmile.operators import analytics as A
from midmile.operators import ranking
from midmile.operators import retrieval as R
from midmile.operators import silver as S
from midmile.operators import spatial
from midmile.plans.oracle import PROFILE
from midmile.plans.registry import register
from midmile.plans.views import OPS_FILES, Views
from midmile.runtime import fresh_path, stage
from midmile.sources import clustered, readers, tables, writers
from midmile.sources.schema import columns

ACCIDENTS = columns(
    "accident_id bigint, start_time timestamp_ntz, state string, city string, severity int, start_lat double, start_lng double"
)
_CONFORMED = "record_type, load_id, truck_id, driver_id, customer_id, facility_id, route_id, revenue, cost, delivery_status, CAST(on_time_flag AS VARCHAR) AS on_time, detention_minutes, event_date, description"
_OTHERS = "trip_id, trailer_id, distance_miles, booking_type, fuel_gallons, fuel_cost, maintenance_type, maintenance_cost, safety_incident_type, event_timestamp"
_UNION_ROWS = f"SELECT {_CONFORMED}, {_OTHERS} FROM ops_union"
_ACCIDENT_ROWS = "SELECT accident_id, start_time, state, city, severity, start_lat, start_lng FROM accidents"


def _csv(df, name: str, path: str | None = None, **options: str) -> str:
    """Write ``df`` as CSV files below the workspace, or add them to ``path``; timestamps as text with all digits."""
    path = path or fresh_path(df.sparkSession, name)
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    df.withColumns({c: F.col(c).cast("string") for c in times}).write.mode("append").options(header=True, escape='"', **options).csv(path)
    return path


def _union_rows(rows):
    return rows.selectExpr(*[e.strip().replace("VARCHAR", "STRING") for e in _CONFORMED.split(", ")], *_OTHERS.split(", "))


def _database(v: Views, name: str) -> str:
    """A new database below the workspace."""
    db = f"{name}_{uuid.uuid4().hex}"
    v.spark.sql(f"CREATE DATABASE {db} LOCATION '{fresh_path(v.spark, db)}'")
    return db


# ---- sources -----------------------------------------------------------------------


@register("s1_scan_csv", _ACCIDENT_ROWS)
def _(v: Views):
    names = ACCIDENTS.fieldNames()
    path, even = fresh_path(v.spark, "accidents"), F.col("accident_id") % 2 == 0
    _csv(v.accidents.where(even).select(*names), "accidents", path)
    _csv(v.accidents.where(~even).select(*reversed(names)), "accidents", path)
    return readers.scan_csv(v.spark, path, ACCIDENTS)


@register("s2_scan_latin1", "SELECT o_orderkey AS order_id, 'Priorité ' || o_orderpriority AS priority FROM orders")
def _(v: Views):
    rows = v.orders.select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Priorité "), "o_orderpriority").alias("priority"))
    path = _csv(rows, "latin1", encoding="ISO-8859-1")
    return readers.scan_csv(v.spark, path, rows.schema, encoding="ISO-8859-1")


@register(
    "s3_scan_mixed_text",
    "SELECT CAST(bridge_id AS VARCHAR) AS bridge_id, bridge_name, CASE WHEN bridge_id % 3 = 0 THEN 'N' ELSE CAST(state_code AS VARCHAR) END AS code FROM bridges",
)
def _(v: Views):
    code = F.when(F.col("bridge_id") % 3 == 0, "N").otherwise(F.col("state_code").cast("string")).alias("code")
    path = _csv(v.bridges.select("bridge_id", "bridge_name", code), "mixed")
    return readers.scan_csv(v.spark, path, readers.all_text(["bridge_id", "bridge_name", "code"]))


@register("s4_scan_tagged", _UNION_ROWS)
def _(v: Views):
    folder = fresh_path(v.spark, "ops-files")
    for file, view in OPS_FILES.items():
        getattr(v, view).write.option("header", True).option("escape", '"').csv(f"{folder}/{file}")
    schemas = {f: getattr(v, OPS_FILES[f]).schema if f in OPS_FILES else T.StructType() for f in S.RECORD_FILES}
    parts = readers.scan_tagged(v.spark, folder, S.RECORD_FILES, schemas)
    rows = S.union_records([S.unify(p.drop("record_type"), S.RECORD_FILES[f]) for f, p in parts.items()])
    return _union_rows(rows)


@register(
    "s5_scan_positional",
    """SELECT CAST(station AS VARCHAR) AS station, CASE WHEN station % 7 = 0 THEN NULL ELSE date END AS date,
       CASE WHEN station % 5 = 0 THEN NULL ELSE prcp END AS prcp FROM weather""",
)
def _(v: Views):
    bad = lambda c, n: F.when(F.col("station") % n == 0, "bad cell").otherwise(F.col(c).cast("string"))
    path = _csv(v.weather.select("station", bad("date", 7).alias("D"), bad("prcp", 5).alias("P")), "positional")
    casts = {"date": F.col("date").try_cast("date"), "prcp": F.col("prcp").try_cast("double")}
    return readers.scan_positional(v.spark, path, ["station", "date", "prcp"], casts)


@register(
    "s6_scan_years",
    """SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS readings, sum(CAST(station AS BIGINT)) :: BIGINT AS stations FROM weather
       WHERE year(date) IN (1997, 1998, 2000) GROUP BY 1""",
)
def _(v: Views):
    path = fresh_path(v.spark, "weather-by-year")
    readers.write_by_year(v.weather, path)
    rows = readers.scan_years(v.spark, path, [1997, 1998, 2000])
    return rows.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("readings"), F.sum("station").alias("stations"))


@register("s8_load_table", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _(v: Views):
    return readers.load(v.spark, v.folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@register("s9_write_full", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(v: Views):
    table = f"{_database(v, 'full')}.t"
    rows = v.supplier.select("s_suppkey", "s_name", "s_nationkey")
    writers.write_full(rows, table)
    writers.write_full(rows, table)  # a re-run replaces, it does not add
    return v.spark.table(table)


@register("s10_write_append", "SELECT o_orderstatus, count(*) * 2 AS records FROM orders GROUP BY 1")
def _(v: Views):
    table = f"{_database(v, 'append')}.t"
    for _i in range(2):
        writers.write_append(v.orders.select("o_orderkey", "o_orderstatus"), table)
    return v.spark.table(table).groupBy("o_orderstatus").agg(F.count("*").alias("records"))


@register("s11_write_replace", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer")
def _(v: Views):
    table = f"{_database(v, 'replaced')}.t"
    writers.write_replace(v.customer.select("c_custkey", "c_name"), table)
    writers.write_replace(v.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), table)
    return v.spark.table(table)


@register("s12_publish_view", "SELECT state, city, hour, incident_count, avg_severity FROM heat")
def _(v: Views):
    name = f"risk_heatmap_{uuid.uuid4().hex}"
    writers.publish_view(A.risk_heatmap(v.accidents), name)
    return v.spark.table(name)


@register(
    "s13_append_log",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, query_text, 'done' AS response_text, CASE WHEN is_grounded THEN 'risk_heatmap,bridges' ELSE '' END AS sources,
       execution_time_ms, is_grounded, true AS stamped, count(*) OVER () AS ids FROM query_log""",
)
def _(v: Views):
    table = f"{_database(v, 'gold')}.query_logs"
    sources = F.when(F.col("is_grounded"), '["risk_heatmap", "bridges"]').otherwise("[]")
    lines = v.query_log.withColumns({"response_text": F.lit("done"), "sources": sources})
    writers.append_log(lines, table)
    log = v.spark.table(table)
    return log.select(
        "user_id", "query_text", "response_text", F.array_join("grounding_sources", ",").alias("sources"), "execution_time_ms", "is_grounded",
        F.col("created_at").isNotNull().alias("stamped"), log.agg(F.countDistinct("query_id")).scalar().alias("ids"),
    )


@register(
    "s14_create_layer",
    """SELECT 'traffic_incidents' AS table_name, 16 AS n_columns, count(*) AS records FROM accidents
       UNION ALL SELECT 'bridge_inventory', 8, count(*) FROM bridges
       UNION ALL SELECT 'raw_logistics', 8, count(*) FROM shipments
       UNION ALL SELECT 'noaa_gsod', 28, count(*) FROM weather""",
)
def _(v: Views):
    db = _database(v, "bronze")
    tables.create_layer(v.spark, db, tables.BRONZE)
    loads = {
        "traffic_incidents": v.accidents, "bridge_inventory": v.bridges, "raw_logistics": v.shipments, "noaa_gsod": v.weather,
    }
    parts = []
    for name, df in loads.items():
        rows = C.conform(df, tables.BRONZE[name])
        rows.write.insertInto(f"{db}.{name}")
        stored = v.spark.table(f"{db}.{name}")
        parts.append(stored.agg(F.count("*").alias("records")).select(
            F.lit(name).alias("table_name"), F.lit(len(stored.columns)).alias("n_columns"), "records"
        ))
    return S.union_records(parts)


@register("s15_load_report", "SELECT 4 AS files, count(*) AS records, true AS all_sized FROM events")
def _(v: Views):
    rows = v.events.select("event_id", "event_type").repartition(4, "event_id")
    report = readers.load_report(v.spark, _csv(rows, "staged"), rows.schema)
    return report.agg(
        F.count("*").cast("int").alias("files"), F.sum("rows").alias("records"), F.bool_and(F.col("file_size") > 0).alias("all_sized")
    )


_DESCRIBED = ", ".join(
    f"('{t}', {i}, '{c}', '{k}')"
    for t, cols in {
        "heat": [("state", "string"), ("city", "string"), ("hour", "timestamp_ntz"), ("incident_count", "bigint"), ("avg_severity", "double")],
        "display": [("bridge_name", "string"), ("state_code", "int"), ("vertical_clearance_mt", "double"), ("load_rating", "double"), ("bridge_condition", "string")],
    }.items()
    for i, (c, k) in enumerate(cols)
)


@register("s16_describe_columns", f"SELECT * FROM (VALUES {_DESCRIBED}) t(table_name, position, column_name, data_type)")
def _(v: Views):
    db = _database(v, "silver")
    writers.write_full(A.risk_heatmap(v.accidents), f"{db}.heat")
    writers.write_full(S.bridge_display(v.bridges), f"{db}.display")
    return tables.describe_columns(v.spark, db)


@register(
    "s17_scenario_json",
    "SELECT category, expected_verdict, count(*) AS scenarios FROM golden GROUP BY 1, 2",
)
def _(v: Views):
    path, out = fresh_path(v.spark, "scenarios"), fresh_path(v.spark, "results")
    C.conform(v.golden, readers.SCENARIO).write.json(path)
    writers.write_results(readers.read_scenarios(v.spark, path, multi_line=False), out)
    back = readers.read_scenarios(v.spark, out, multi_line=False)
    return back.groupBy("category", "expected_verdict").agg(F.count("*").alias("scenarios"))


# ---- columns -----------------------------------------------------------------------


@register(
    "p1_normalize_upper",
    "SELECT p_partkey AS PART_KEY_ID, p_name AS NAME_OF_PART, p_brand AS BRAND, p_size AS SIZE_MM FROM part",
)
def _(v: Views):
    messy = v.part.select("p_partkey", "p_name", "p_brand", "p_size").toDF(" Part key (id)", "name  of--part", "BRAND ", "Size [mm]")
    return C.normalize_upper(messy)


@register("p2_normalize_lower", "SELECT s_suppkey AS driver_id, s_name AS full_name FROM supplier")
def _(v: Views):
    return C.normalize_lower(v.supplier.select("s_suppkey", "s_name").toDF(" Driver ID ", "Full Name"))


@register(
    "p3_map_columns",
    """SELECT load_id, customer_id, origin_city, destination_city, distance_miles, revenue, total_cost AS cost, delivery_status,
       booking_type, event_date FROM src_loads""",
)
def _(v: Views):
    return C.map_columns(v.src_loads, S.SOURCE_COLUMNS).drop("description")


@register("p4_conform", f"SELECT {_CONFORMED}, trip_id FROM ops_union WHERE record_type = 'delivery'")
def _(v: Views):
    rows = S.unify(v.src_delivery_events, "delivery")
    if rows.columns != S.UNIFIED.fieldNames():
        raise ValueError("columns are not in the unified order")
    return rows.selectExpr(*[e.strip().replace("VARCHAR", "STRING") for e in _CONFORMED.split(", ")], "trip_id")


@register("p5_record_id", "SELECT record_id, record_type, load_id, truck_id, driver_id, customer_id, event_date, description FROM ops_records")
def _(v: Views):
    return v.ops_records.select("record_id", "record_type", "load_id", "truck_id", "driver_id", "customer_id", "event_date", "description")


@register(
    "p6_parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""",
)
def _(v: Views):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 11 == 0, "no date")
        .when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )
    return C.parse_dates(v.orders.select("o_orderkey", text.alias("d")), {"d": ["yyyy-MM-dd", "MM/dd/yyyy"]})


@register("p7_loaded_at", "SELECT count(*) AS records, count(*) AS stamped, 1 AS stamps FROM orders")
def _(v: Views):
    return C.with_loaded_at(v.orders).agg(
        F.count("*").alias("records"), F.count("_ingested_at").alias("stamped"),
        F.when(F.min("_ingested_at") == F.max("_ingested_at"), 1).alias("stamps"),
    )


@register("p8_hour_bucket", "SELECT accident_id, date_trunc('hour', start_time) AS hour FROM accidents")
def _(v: Views):
    return v.accidents.select("accident_id", C.hour_bucket(F.col("start_time")).alias("hour"))


@register(
    "p9_point",
    """SELECT bridge_id, CASE WHEN bridge_id % 23 <> 0 THEN round(latitude, 9) END AS lat,
       CASE WHEN bridge_id % 23 <> 0 THEN round(longitude, 9) END AS lon, bridge_id % 23 <> 0 AS has_text FROM bridges""",
)
def _(v: Views):
    some = v.bridges.withColumn("longitude", F.when(F.col("bridge_id") % 23 != 0, F.col("longitude")))
    return S.bridge_points(some).select(
        "bridge_id", F.round("location.lat", 9).alias("lat"), F.round("location.lon", 9).alias("lon"),
        F.col("location_text").isNotNull().alias("has_text"),
    )


@register("p10_weather_alert", "SELECT station, date, round(prcp, 6) AS prcp, weather_alert FROM alerts")
def _(v: Views):
    return S.weather_alerts(v.weather).select("station", "date", F.round("prcp", 6).alias("prcp"), "weather_alert")


@register(
    "p11_null_sentinel",
    "SELECT station, count(*) AS readings, count(prcp) AS with_prcp, count(sndp) AS with_sndp, count(visib) AS with_visib FROM readings GROUP BY 1",
)
def _(v: Views):
    seen = lambda c: F.count(C.null_sentinel(F.col(c))).alias(f"with_{c}")
    return v.weather.groupBy("station").agg(F.count("*").alias("readings"), seen("prcp"), seen("sndp"), seen("visib"))


@register(
    "p12_alert_sentence",
    "SELECT station, 'Station ' || station || ' reports ' || weather_alert || ' on ' || CAST(date AS VARCHAR) AS alert_description FROM alerts",
)
def _(v: Views):
    return S.weather_alerts(v.weather).select("station", "alert_description")


@register("p13_delay_days", "SELECT order_id, order_date, delay_days FROM delays")
def _(v: Views):
    return S.shipment_delays(v.shipments).select("order_id", "order_date", "delay_days")


@register("p14_risk_flag", "SELECT order_id, TRY_CAST(late_delivery_risk AS INT) AS late_delivery_risk_score FROM shipments")
def _(v: Views):
    return S.shipment_delays(v.shipments).select("order_id", "late_delivery_risk_score")


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


@register(
    "p15_record_sentence",
    f"""SELECT record_id, concat_ws(' ', 'Record type: ' || record_type || '.',
        'Route: ' || origin_city || ' → ' || destination_city || ', ' || {_money('distance_miles')} || ' miles.',
        'Revenue: $' || {_money('revenue')} || ', Cost: $' || {_money('cost')} || '.',
        'Status: ' || delivery_status || ', On-time: ' || CAST(on_time_flag AS VARCHAR) || '.',
        'Notes: ' || description || '.') AS text_content FROM ops_records""",
)
def _(v: Views):
    return S.text_chunks(v.ops_records).select(F.col("chunk_id").alias("record_id"), "text_content")


def _or_unknown(c: str, money: bool = False) -> str:
    return f"coalesce({_money(c) if money else f'CAST({c} AS VARCHAR)'}, 'unknown')"


@register(
    "p16_record_sentence_typed",
    f"""SELECT record_id, CASE record_type
        WHEN 'load' THEN 'Load ' || {_or_unknown('load_id')} || ': ' || {_or_unknown('origin_city')} || ' → ' || {_or_unknown('destination_city')}
          || ', ' || {_or_unknown('distance_miles', True)} || ' miles, revenue $' || {_or_unknown('revenue', True)} || ', cost $'
          || {_or_unknown('cost', True)} || ', booking type: ' || {_or_unknown('booking_type')} || ', status: ' || {_or_unknown('delivery_status')} || '.'
        WHEN 'delivery' THEN 'Delivery for load ' || {_or_unknown('load_id')} || ': Status ' || {_or_unknown('delivery_status')} || ', on-time: '
          || {_or_unknown('on_time_flag')} || ', detention: ' || {_or_unknown('detention_minutes', True)} || ' min on ' || {_or_unknown('event_date')} || '.'
        WHEN 'driver' THEN 'Driver ' || {_or_unknown('driver_id')} || ': ' || {_or_unknown('description')} || '.'
        WHEN 'truck' THEN 'Truck ' || {_or_unknown('truck_id')} || ': ' || {_or_unknown('description')} || '.'
        WHEN 'trip' THEN 'Trip ' || {_or_unknown('trip_id')} || ': Driver ' || {_or_unknown('driver_id')} || ' in truck ' || {_or_unknown('truck_id')} || ', '
          || {_or_unknown('origin_city')} || ' → ' || {_or_unknown('destination_city')} || ', ' || {_or_unknown('distance_miles', True)} || ' miles on ' || {_or_unknown('event_date')} || '.'
        WHEN 'fuel' THEN 'Fuel purchase: ' || {_or_unknown('fuel_gallons', True)} || ' gal at $' || {_or_unknown('fuel_cost', True)} || ' for truck '
          || {_or_unknown('truck_id')} || ' on ' || {_or_unknown('event_date')} || '.'
        WHEN 'maintenance' THEN 'Maintenance for truck ' || {_or_unknown('truck_id')} || ': ' || {_or_unknown('maintenance_type')} || ', cost $'
          || {_or_unknown('maintenance_cost', True)} || ' on ' || {_or_unknown('event_date')} || '. Notes: ' || {_or_unknown('description')} || '.'
        WHEN 'safety' THEN 'Safety incident: ' || {_or_unknown('safety_incident_type')} || ' involving driver ' || {_or_unknown('driver_id')} || ' on '
          || {_or_unknown('event_date')} || '. Details: ' || {_or_unknown('description')} || '.'
        ELSE 'Record ' || record_id || ' (' || record_type || '): ' || {_or_unknown('description')} || '.' END AS sentence FROM ops_records""",
)
def _(v: Views):
    return v.ops_records.select("record_id", S.record_sentence_typed().alias("sentence"))


@register(
    "p17_chunk_metadata",
    """SELECT record_id, origin_city || ' → ' || destination_city AS route, driver_id, truck_id, CAST(event_date AS VARCHAR) AS event_date,
       revenue, cost FROM ops_records""",
)
def _(v: Views):
    keys = ["route", "driver_id", "truck_id", "event_date", "revenue", "cost"]
    read = S.text_chunks(v.ops_records).select(F.col("chunk_id").alias("record_id"), F.json_tuple("metadata", *keys).alias(*keys))  # one parse a record
    return read.withColumns({c: F.col(c).cast("double") for c in ("revenue", "cost")})


@register("p18_source_ids", "SELECT record_type, count(*) AS chunks, count(*) AS ids, 1 AS longest FROM ops_records GROUP BY 1")
def _(v: Views):
    ids = F.size("source_record_ids")
    same = F.count_if(F.get("source_record_ids", F.lit(0)) == F.col("chunk_id"))
    return S.text_chunks(v.ops_records).groupBy("record_type").agg(
        F.count("*").alias("chunks"), same.alias("ids"), F.max(ids).alias("longest")
    )


_MET = f"{PROFILE}, bridge_id"


def _met(v: Views):
    """Distinct vehicles of every route with its bridges (route lines meet bridges within 500 m)."""
    from midmile.operators.gate import bridge_hits

    hits = stage(bridge_hits(spatial.with_route_points(v.routes), v.bridges, 500.0), "bridge-hits")
    return ranking.balanced_join(hits, v.route_requests.select(*PROFILE.split(", ")).distinct(), "route_id")


@register("p19_weight_margin", f"SELECT DISTINCT {_MET}, weight_margin FROM met")
def _(v: Views):
    return _met(v).select(*_MET.split(", "), C.weight_margin(F.col("load_limit_tons"), F.col("vehicle_weight_tons")).alias("weight_margin"))


@register("p20_clearance_margin", f"SELECT DISTINCT {_MET}, clearance_margin FROM met")
def _(v: Views):
    return _met(v).select(*_MET.split(", "), C.clearance_margin(F.col("clearance_mt"), F.col("vehicle_height_mt")).alias("clearance_margin"))


@register("p21_parse_risk", "SELECT request_id, score, reason FROM replies")
def _(v: Views):
    parsed = C.parse_risk(F.col("reply"))
    return v.risk_replies.select("request_id", parsed["score"].alias("score"), parsed["reason"].alias("reason"))


@register(
    "p22_risk_class",
    "SELECT request_id, CASE WHEN score >= 0.7 THEN 'HIGH RISK' WHEN score >= 0.4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END AS risk_class FROM replies",
)
def _(v: Views):
    return v.risk_replies.select("request_id", C.risk_class(C.parse_risk(F.col("reply"))["score"]).alias("risk_class"))


@register(
    "p23_transit_hours",
    """SELECT truck_id, route_id, actual_distance_miles, CASE WHEN route_id % 8 > 0 THEN round(actual_distance_miles / (route_id % 8 * 16), 1) END
       AS transit_hours, CASE WHEN route_id % 8 > 0 THEN NULL ELSE 'Speed must be > 0' END AS error FROM trips""",
)
def _(v: Views):
    mph = F.col("route_id") % 8 * 16
    return A.transit_times(v.trips, mph).select("truck_id", "route_id", "actual_distance_miles", "transit_hours", "error")


@register("p24_flag01", "SELECT incident_id, CASE WHEN at_fault_flag THEN 1 ELSE 0 END AS at_fault FROM safety")
def _(v: Views):
    return v.safety.select("incident_id", C.flag01(F.col("at_fault_flag")).alias("at_fault"))


@register(
    "p25_parse_linestring",
    """SELECT route_id, 2 AS n_points, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM routes""",
)
def _(v: Views):
    wkt = F.format_string("LINESTRING(%.6f %.6f, %.6f %.6f)", "lon1", "lat1", "lon2", "lat2")
    points = geo.parse_linestring(wkt)
    at = lambda i, k: F.round(F.col("p")[i][k], 6)
    return v.routes.select("route_id", points.alias("p")).select(
        "route_id", F.size("p").alias("n_points"), at(0, "lat").alias("lat1"), at(0, "lon").alias("lon1"),
        at(1, "lat").alias("lat2"), at(1, "lon").alias("lon2"),
    )


@register(
    "p26_bridge_display",
    "SELECT bridge_name, state_code, clearance_mt AS vertical_clearance_mt, load_limit_tons AS load_rating, condition AS bridge_condition FROM bridges",
)
def _(v: Views):
    return S.bridge_display(v.bridges)


# ---- filters -----------------------------------------------------------------------


@register("f1_in_years", "SELECT station, date FROM weather WHERE year(date) IN (1996, 1997, 2001)")
def _(v: Views):
    return v.weather.where(C.in_years(F.col("date"), [1996, 1997, 2001])).select("station", "date")


@register("f2_contains_ci", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'than')")
def _(v: Views):
    return v.documents.where(C.contains_ci(F.col("text"), "THAN")).select("doc_id", "lang")


@register(
    "f3_contains_all_ci",
    """SELECT state, city, incident_count, avg_severity FROM heat_city WHERE contains(lower(city), 'ick') AND contains(lower(state), 'nation_1')
       ORDER BY incident_count DESC, state, city LIMIT 1""",
)
def _(v: Views):
    heat = A.heatmap_by_city(A.risk_heatmap(v.accidents))
    return A.city_lookup(heat, "ICK", "Nation_1").select("state", "city", "incident_count", "avg_severity")


@register(
    "f4_keyword_match",
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'bridge') OR contains(lower(text), 'tionthe') OR contains(lower(text), 'enhaa')",
)
def _(v: Views):
    return R.keyword_match(v.documents, "text", "the Bridge of tionthe or enhaa").select("doc_id", "source")


@register("f5_has_embedding", "SELECT vec_id, label FROM embeddings WHERE label <> 3")
def _(v: Views):
    some = v.embeddings.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    return R.has_embedding(some).select("vec_id", "label")


@register("f6_by_route", "SELECT truck_id, actual_distance_miles FROM trips WHERE route_id = 17")
def _(v: Views):
    return A.by_route(v.trips, 17).select("truck_id", "actual_distance_miles")


@register(
    "f7_blackspots",
    "SELECT state, city, incident_count, avg_severity FROM heat_city WHERE incident_count > 75 ORDER BY incident_count DESC, state, city LIMIT 50",
)
def _(v: Views):
    heat = A.heatmap_by_city(A.risk_heatmap(v.accidents))
    return A.blackspots(heat, min_count=75).select("state", "city", "incident_count", "avg_severity")


@register("f8_active_alerts", "SELECT station, date, weather_alert FROM alerts WHERE weather_alert <> 'Normal conditions'")
def _(v: Views):
    return S.active_alerts(S.weather_alerts(v.weather)).select("station", "date", "weather_alert")


@register(
    "f9_completed_trips",
    "SELECT truck_id, fuel_type, CAST(revenue AS DOUBLE) AS revenue FROM trips WHERE trip_status = 'Completed' AND fuel_type IN ('Diesel', 'CNG', 'Electric')",
)
def _(v: Views):
    return A.completed_trips(v.trips).select("truck_id", "fuel_type", F.col("revenue").cast("double").alias("revenue"))


@register("f10_violates", f"SELECT DISTINCT {_MET}, fails FROM met")
def _(v: Views):
    fails = C.violates(F.col("load_limit_tons"), F.col("vehicle_weight_tons"), F.col("clearance_mt"), F.col("vehicle_height_mt"))
    return _met(v).select(*_MET.split(", "), fails.alias("fails"))


@register(
    "f11_min_group",
    "SELECT truck_id, fuel_type, count(*) AS trips FROM trips GROUP BY 1, 2 HAVING count(*) >= 600",
)
def _(v: Views):
    return A.min_group(v.trips.groupBy("truck_id", "fuel_type").agg(F.count("*").alias("trips")), 600)


@register(
    "f12_profitable",
    "SELECT route_id, total_loads, margin_pct FROM scorecard WHERE total_loads >= 5 AND margin_pct >= 0",
)
def _(v: Views):
    return A.profitable(A.route_scorecard(v.trips), n=None).select("route_id", "total_loads", "margin_pct")


@register("f13_low_clearance", "SELECT bridge_id, clearance_mt, condition FROM bridges WHERE clearance_mt < 4.5 AND state_code = 6")
def _(v: Views):
    return S.low_clearance(v.bridges, 4.5, 6).select("bridge_id", "clearance_mt", "condition")


_RADIUS = """SELECT bridge_id, round(d, 3) AS distance_m FROM (SELECT bridge_id, 2 * 6371008.8 * asin(sqrt(sin(radians(latitude - 33.7) / 2) ** 2
       + cos(radians(33.7)) * cos(radians(latitude)) * sin(radians(longitude + 114.6) / 2) ** 2)) AS d FROM bridges) x WHERE d <= 16093"""


@register("f14_within_radius", _RADIUS)
def _(v: Views):
    near = spatial.within_radius(v.bridges, 33.7, -114.6, 16093.0)
    return near.select("bridge_id", F.round("distance_m", 3).alias("distance_m"))


@register("f15_meets_route", "SELECT bridge_id FROM hits WHERE route_id = 3")
def _(v: Views):
    line = [(41.1, -104.1), (41.2, -103.65)]  # the line of route 3
    return v.bridges.where(spatial.meets_route(v.bridges, line, 500.0)).select("bridge_id")


def _clustered(v: Views) -> str:
    """Bridges stored along the curve."""
    path = fresh_path(v.spark, "clustered")
    clustered.write(v.bridges, path, 64)
    return path


@register("f14_clustered_radius", _RADIUS)
def _(v: Views):
    near = clustered.within_radius(v.spark, _clustered(v), 33.7, -114.6, 16093.0)
    return near.select("bridge_id", F.round("distance_m", 3).alias("distance_m"))


@register("f15_clustered_route", "SELECT bridge_id FROM hits WHERE route_id = 3")
def _(v: Views):
    return clustered.meets_route(v.spark, _clustered(v), [(41.1, -104.1), (41.2, -103.65)], 500.0).select("bridge_id")


# ---- windows, orders, unions -------------------------------------------------------


@register("w1_delay_propensity", "SELECT order_id, shipping_mode, avg(days_for_shipping_real) OVER (PARTITION BY shipping_mode) AS delay_propensity FROM shipments")
def _(v: Views):
    return S.delay_propensity(v.shipments).select("order_id", "shipping_mode", "delay_propensity")


@register(
    "w2_delay_zscore",
    """SELECT order_id, delay_days, round((delay_days - avg(delay_days) OVER p) / nullif(stddev_samp(delay_days) OVER p, 0), 8) AS delay_zscore
       FROM delays WINDOW p AS (PARTITION BY shipping_mode)""",
)
def _(v: Views):
    return S.delay_zscore(v.shipments).select("order_id", "delay_days", F.round("delay_zscore", 8).alias("delay_zscore"))


@register(
    "t1_top_cities",
    "SELECT state, city, incident_count FROM heat_city ORDER BY incident_count DESC, state, city LIMIT 20",
)
def _(v: Views):
    heat = A.heatmap_by_city(A.risk_heatmap(v.accidents)).select("state", "city", "incident_count")
    return ranking.top_n(heat, [F.desc("incident_count")], ["state", "city"], 20)


@register("t2_latest_log", "SELECT query_id, created_at, is_grounded FROM query_log ORDER BY created_at DESC, query_id LIMIT 25")
def _(v: Views):
    return A.latest(v.query_log).select("query_id", "created_at", "is_grounded")


@register("t3_preview", "SELECT order_id, shipping_mode, late_delivery_risk FROM shipments ORDER BY order_id LIMIT 5")
def _(v: Views):
    return A.preview(v.shipments.select("order_id", "shipping_mode", "late_delivery_risk"), ["order_id"], 5)


@register("t4_seeded_order", "SELECT lang, count(*) AS docs, count(*) AS places, true AS repeats FROM documents GROUP BY 1")
def _(v: Views):
    """Every document gets a place of its own, the same one in another partitioning."""
    place = lambda df: df.select("doc_id", "lang", C.seeded_order(F.col("doc_id")).alias("place"))
    again = place(v.documents.select("doc_id", "lang").repartition(3, "lang")).select("doc_id", F.col("place").alias("again"))
    return place(v.documents).join(again, "doc_id").groupBy("lang").agg(
        F.count("*").alias("docs"), F.countDistinct("place").alias("places"), F.bool_and(F.col("place") == F.col("again")).alias("repeats")
    )


@register("t5_state_heatmap", "SELECT city, hour, incident_count, avg_severity FROM heat WHERE state = 'NATION_7'")
def _(v: Views):
    return A.state_heatmap(A.risk_heatmap(v.accidents), "NATION_7").select("city", "hour", "incident_count", "avg_severity")


@register("u1_union_records", _UNION_ROWS)
def _(v: Views):
    return _union_rows(S.union_records(v.ops_parts))

"""Domain views over the given tables; each text runs on Spark and on a SQL oracle alike.

``VIEWS`` names base tables in braces, so that the same text works with DataFrames and
with plain table names.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_LAT1 = "30 + (s_suppkey * 37 % 150) / 10.0e0"
_LON1 = "-120 + (s_suppkey * 53 % 400) / 10.0e0"

VIEWS = {
    "accidents": """SELECT event_id AS accident_id, ts AS start_time, n_name AS state, event_type AS city,
        CAST(1 + event_id % 4 AS INT) AS severity, 30 + (user_id * 37 % 150) / 10.0e0 AS start_lat,
        -120 + (user_id * 53 % 400) / 10.0e0 AS start_lng
        FROM {events} JOIN {nation} ON n_nationkey = user_id % 25""",
    "weather": """SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date,
        CASE WHEN l_partkey % 97 = 0 THEN 999.9e0 ELSE l_quantity * 1.2e0 END AS prcp,
        CASE WHEN l_partkey % 89 = 0 THEN 999.9e0 ELSE l_discount * 150 END AS sndp,
        CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE l_tax * 100 END AS visib FROM {lineitem}""",
    "routes": f"""SELECT s_suppkey AS route_id, {_LAT1} AS lat1, {_LON1} AS lon1,
        {_LAT1} + (s_suppkey % 5 - 2) / 10.0e0 AS lat2,
        {_LON1} + 0.3e0 + (s_suppkey % 4) / 20.0e0 AS lon2 FROM {{supplier}}""",
    "stations": f"""SELECT s_suppkey AS station, {_LAT1} + 0.11e0 AS latitude, {_LON1} + 0.07e0 AS longitude
        FROM {{supplier}}""",
    "bridges": """SELECT p_partkey AS bridge_id, p_name AS bridge_name, CAST(p_partkey % 50 AS INT) AS state_code,
        p_brand AS condition,
        CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE 3.0e0 + p_size / 20.0e0 END AS clearance_mt,
        CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 15.0e0 + p_partkey % 53 END AS load_limit_tons,
        30 + ((p_partkey % 100) * 37 % 150) / 10.0e0
          + (p_partkey % 100 % 5 - 2) / 10.0e0 * ((p_partkey * 13 % 97 + 1) / 98.0e0)
          + CASE WHEN p_partkey % 100 >= 90 THEN 0.05e0 ELSE (p_partkey % 7 - 3) / 100.0e0 END AS latitude,
        -120 + ((p_partkey % 100) * 53 % 400) / 10.0e0
          + (0.3e0 + (p_partkey % 100 % 4) / 20.0e0) * ((p_partkey * 13 % 97 + 1) / 98.0e0) AS longitude FROM {part}""",
    "route_requests": """SELECT c_custkey AS request_id, c_custkey % 100 AS route_id,
        8.0e0 + c_custkey % 25 AS vehicle_weight_tons, 2.6e0 + (c_custkey % 15) / 10.0e0 AS vehicle_height_mt
        FROM {customer}""",
    "risk_replies": """SELECT c_custkey AS request_id, CASE c_custkey % 6 WHEN 0 THEN '0.85, Heavy snowfall alert'
        WHEN 1 THEN '0.15, Clear weather' WHEN 2 THEN 'n/a, unknown' WHEN 3 THEN '1.7, pileup, icing'
        WHEN 4 THEN '-0.2, below range' ELSE '0.45' END AS reply FROM {customer}""",
    "shipments": """SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
        o_orderpriority AS shipping_mode, CAST(o_orderkey % 7 AS INT) AS days_for_shipping_real,
        CAST(1 + o_custkey % 4 AS INT) AS days_for_shipment_scheduled,
        CASE WHEN o_orderkey % 41 = 0 THEN 'x' WHEN o_orderkey % 7 > 1 + o_custkey % 4 THEN '1' ELSE '0' END
        AS late_delivery_risk FROM {orders}""",
    "trips": """SELECT s_name AS truck_id, n_name AS driver_terminal, 'Make ' || CAST(s_suppkey % 6 AS STRING) AS truck_make,
        CAST(2010 + s_suppkey % 14 AS INT) AS truck_year, 'Driver ' || CAST(l_partkey % 3 AS STRING) AS driver_name, CASE l_suppkey % 4 WHEN 0 THEN 'Diesel'
        WHEN 1 THEN 'CNG' WHEN 2 THEN 'Electric' ELSE 'Other' END AS fuel_type, l_partkey % 50 AS route_id,
        CASE WHEN l_linestatus = 'F' THEN 'Completed' ELSE 'Open' END AS trip_status,
        l_quantity AS actual_distance_miles, 5 + l_tax * 50 AS average_mpg,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue,
        CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(70 + l_partkey % 50 AS DECIMAL(5,0)) * 0.01 AS cost
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey""",
    "fuel": """SELECT n_name AS location_state, s_name AS location, l_partkey % 50 AS route_id,
        l_quantity AS fuel_gallons, CAST(3 + l_tax * 10 AS DECIMAL(10,3)) AS price_per_gallon,
        CAST(l_quantity * (3 + l_tax * 10) AS DECIMAL(18,2)) AS fuel_cost
        FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey""",
    "safety": """SELECT event_id AS incident_id, event_type AS incident_type,
        CAST(value AS DECIMAL(18,2)) AS claim_amount, CAST(value * 2 AS DECIMAL(18,2)) AS vehicle_damage_cost,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 2 = 0 END AS at_fault_flag,
        event_id % 5 = 0 AS injury_flag, event_id % 3 = 0 AS preventable_flag FROM {events}""",
    "query_log": """SELECT event_id AS query_id, user_id, event_type AS query_text,
        CAST(event_id * 37 % 15000 AS BIGINT) AS execution_time_ms, event_id % 4 <> 0 AS is_grounded,
        ts AS created_at FROM {events}""",
    "golden": """SELECT o_orderkey AS id, o_orderkey - o_orderkey % 2 AS pair_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'variant' END AS role, o_orderpriority AS category,
        CASE WHEN o_custkey % 3 = 0 THEN 'HARD_VETO' ELSE 'PASS' END AS expected_verdict,
        CASE WHEN (o_custkey + o_orderkey % 5) % 3 = 0 THEN 'HARD_VETO' ELSE 'PASS' END AS actual_verdict
        FROM {orders}""",
    "votes": "SELECT o_custkey AS query_id, o_orderkey AS chain_id, o_orderstatus AS answer FROM {orders}",
    "rubric": """SELECT o_orderkey AS scenario_id, o_orderpriority AS strategy, o_orderkey % 3 AS decision,
        o_custkey % 3 AS grounding, (o_orderkey + o_custkey) % 3 AS citation, o_orderkey % 2 + 1 AS reasoning,
        o_custkey % 2 + 1 AS jargon FROM {orders}""",
    "strategy_scores": """SELECT o_orderkey AS scenario_id, 'plain' AS strategy, o_custkey % 11 AS score FROM {orders}
        UNION ALL SELECT o_orderkey, 'chains', (o_custkey + o_orderkey % 4) % 11 FROM {orders}""",
    # operation files as they would arrive, with names of their own
    "src_loads": """SELECT CAST(o_orderkey AS STRING) AS load_id, CAST(o_custkey AS STRING) AS customer_id,
        'City ' || CAST(o_custkey % 40 AS STRING) AS origin_city,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'City ' || CAST(o_orderkey % 40 AS STRING) END AS destination_city,
        CAST(o_orderkey % 900 AS STRING) AS distance_miles, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS revenue,
        CAST(o_custkey * 3 AS STRING) AS total_cost, 'not used' AS cost,
        o_orderstatus AS delivery_status, 'not used' AS status, o_orderpriority AS booking_type,
        CAST(CAST(o_orderdate AS DATE) AS STRING) AS event_date, CAST(NULL AS STRING) AS notes FROM {orders}""",
    "src_delivery_events": """SELECT CAST(l_orderkey AS STRING) AS load_id, CAST(l_partkey AS STRING) AS truck_id,
        CAST(l_suppkey AS STRING) AS driver_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS revenue,
        l_linestatus AS status, CASE l_returnflag WHEN 'N' THEN 'true' WHEN 'R' THEN 'false' ELSE NULL END AS on_time,
        CAST(CAST(l_quantity AS DECIMAL(18,0)) AS STRING) AS detention_minutes,
        CAST(CAST(l_shipdate AS DATE) AS STRING) AS date FROM {lineitem}""",
    "src_trucks": """SELECT CAST(p_partkey AS STRING) AS truck_id, p_name AS description, p_type AS notes FROM {part}""",
    "src_drivers": "SELECT CAST(s_suppkey AS STRING) AS driver_id, s_name AS description FROM {supplier}",
    "src_customers": """SELECT CAST(c_custkey AS STRING) AS customer_id, c_mktsegment AS origin_city,
        c_name AS description FROM {customer}""",
    "src_facilities": "SELECT CAST(n_nationkey AS STRING) AS facility_id, n_name AS description FROM {nation}",
    "src_routes": "SELECT CAST(r_regionkey AS STRING) AS route_id, r_name AS notes FROM {region}",
    "src_trips": """SELECT CAST(c_custkey AS STRING) AS trip_id, CAST(c_custkey % 100 AS STRING) AS driver_id,
        CAST(c_custkey % 500 + 1 AS STRING) AS truck_id, CAST(c_nationkey AS STRING) AS trailer_id,
        'City ' || CAST(c_custkey % 40 AS STRING) AS origin_city,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'City ' || CAST(c_custkey % 37 AS STRING) END AS destination_city,
        CAST(c_custkey % 700 AS STRING) AS distance_miles,
        CASE WHEN c_custkey % 29 = 0 THEN 'no date' ELSE '2024-01-' || CAST(10 + c_custkey % 20 AS STRING) END AS event_date FROM {customer}""",
    "src_trailers": "SELECT CAST(s_suppkey AS STRING) AS trailer_id, s_name AS notes FROM {supplier}",
    "src_fuel_purchases": """SELECT CAST(user_id AS STRING) AS truck_id, CAST(event_id % 90 + 10 AS STRING) AS fuel_gallons,
        CASE WHEN event_id % 19 = 0 THEN 'n/a' ELSE CAST(CAST((event_id % 90 + 10) * 3.5 AS DECIMAL(12,2)) AS STRING) END AS fuel_cost,
        CAST(CAST(ts AS DATE) AS STRING) AS date FROM {events}""",
    "src_maintenance_records": """SELECT CAST(p_partkey AS STRING) AS truck_id, p_type AS service_type,
        CAST(p_size * 25 AS STRING) AS maintenance_cost, '2024-02-' || CAST(10 + p_partkey % 19 AS STRING) AS date,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS notes FROM {part}""",
    "src_safety_incidents": """SELECT CAST(user_id % 100 AS STRING) AS driver_id, event_type AS incident_type,
        CAST(CAST(ts AS DATE) AS STRING) AS event_date, CAST(date_trunc('second', ts) AS STRING) AS timestamp,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Report ' || CAST(event_id AS STRING) END AS description FROM {events}""",
    "src_driver_monthly_metrics": """SELECT CAST(s_suppkey AS STRING) AS driver_id, CAST(s_suppkey * 31 % 9000 AS STRING) AS distance_miles,
        CAST(s_nationkey * 100 AS STRING) AS revenue, 'Month 2024-01' AS description FROM {supplier}""",
    "src_truck_utilization_metrics": """SELECT CAST(n_nationkey AS STRING) AS truck_id, CAST(n_nationkey * 11 AS STRING) AS distance_miles,
        CAST(n_nationkey % 7 AS STRING) AS detention_minutes, n_name AS notes FROM {nation}""",
}

OPS_FILES = {
    "loads.csv": "src_loads",
    "delivery_events.csv": "src_delivery_events",
    "trucks.csv": "src_trucks",
    "drivers.csv": "src_drivers",
    "customers.csv": "src_customers",
    "facilities.csv": "src_facilities",
    "routes.csv": "src_routes",
    "trips.csv": "src_trips",
    "trailers.csv": "src_trailers",
    "fuel_purchases.csv": "src_fuel_purchases",
    "maintenance_records.csv": "src_maintenance_records",
    "safety_incidents.csv": "src_safety_incidents",
    "driver_monthly_metrics.csv": "src_driver_monthly_metrics",
    "truck_utilization_metrics.csv": "src_truck_utilization_metrics",
}


class Views:
    """Base tables and views of one folder as DataFrames, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._frames = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__["_frames"]
        if name not in frames:
            if name in TABLES:
                frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                used = re.findall(r"\{(\w+)\}", VIEWS[name])
                frames[name] = self.spark.sql(VIEWS[name], **{t: getattr(self, t) for t in used})
            else:
                raise AttributeError(name)
        return frames[name]

    @cached_property
    def ops_parts(self) -> list[DataFrame]:
        """Unified records of every source file, without ids."""
        from midmile.operators.silver import RECORD_FILES, unify

        return [unify(getattr(self, view), RECORD_FILES[file]) for file, view in OPS_FILES.items()]

    @cached_property
    def ops_records(self) -> DataFrame:
        from midmile.operators.silver import union_records, with_record_id

        return with_record_id(union_records(self.ops_parts), from_files=True)


def oracle_views(sql: str, extra: dict[str, str]) -> str:
    """``sql`` with a CTE for every view it names, directly or through another."""
    known = {**{n: t.format(**{b: b for b in TABLES}) for n, t in VIEWS.items()}, **extra}
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(known[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + sql

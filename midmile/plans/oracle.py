"""Shared oracle CTEs, written from the definitions for a plain SQL engine."""

from __future__ import annotations

R = 6371008.8


def _vector(lat: str, lon: str, p: str) -> str:
    return (
        f"cos(radians({lat})) * cos(radians({lon})) AS {p}x, cos(radians({lat})) * sin(radians({lon})) AS {p}y, "
        f"sin(radians({lat})) AS {p}z"
    )


def _arc(a: str, b: str) -> str:
    return f"2 * asin(least(1.0e0, sqrt(({a}x-{b}x)**2 + ({a}y-{b}y)**2 + ({a}z-{b}z)**2) / 2)) * {R}"


def near_route(points: str, lat: str, lon: str, metres: float) -> str:
    """Every point within ``metres`` of a route, by comparing all pairs."""
    return f"""SELECT * FROM (SELECT *, CASE WHEN nn > 0 AND pb >= pa * ab AND pa >= pb * ab
        THEN asin(least(1.0e0, num / nn)) * {R} ELSE least(da, db) END AS distance_m FROM (
      SELECT *, ax*bx + ay*by_ + az*bz AS ab, px*ax + py*ay + pz*az AS pa, px*bx + py*by_ + pz*bz AS pb,
        abs(px*(ay*bz - az*by_) + py*(az*bx - ax*bz) + pz*(ax*by_ - ay*bx)) AS num,
        sqrt((ay*bz - az*by_)**2 + (az*bx - ax*bz)**2 + (ax*by_ - ay*bx)**2) AS nn,
        {_arc('p', 'a')} AS da, {_arc('p', 'b').replace('by', 'by_')} AS db
      FROM (SELECT route_id, {_vector('lat1', 'lon1', 'a')}, {_vector('lat2', 'lon2', 'b').replace('AS by', 'AS by_')} FROM routes) rt,
           (SELECT *, {_vector(lat, lon, 'p')} FROM {points}) pt) pairs) judged WHERE distance_m <= {metres}"""


_UNIFIED = (
    "record_id record_type load_id trip_id driver_id truck_id trailer_id customer_id facility_id route_id origin_city "
    "destination_city distance_miles revenue cost fuel_gallons fuel_cost maintenance_type maintenance_cost "
    "delivery_status on_time_flag detention_minutes safety_incident_type booking_type event_date event_timestamp description"
).split()
_KINDS = {
    **{c: "DOUBLE" for c in "distance_miles revenue cost fuel_gallons fuel_cost maintenance_cost detention_minutes".split()},
    "on_time_flag": "BOOLEAN", "event_date": "DATE", "event_timestamp": "TIMESTAMP",
}


def _unified(view: str, record_type: str, have: dict[str, str]) -> str:
    cols = []
    for c in _UNIFIED:
        kind = _KINDS.get(c, "VARCHAR")
        expr = f"'{record_type}'" if c == "record_type" else have.get(c, "NULL")
        cols.append(f"CAST({expr} AS {kind}) AS {c}")
    return f"SELECT {', '.join(cols)} FROM {view}"


_OPS = [
    ("src_loads", "load", dict(load_id="load_id", customer_id="customer_id", origin_city="origin_city",
        destination_city="destination_city", distance_miles="distance_miles", revenue="revenue", cost="total_cost",
        delivery_status="delivery_status", booking_type="booking_type", event_date="event_date", description="notes")),
    ("src_delivery_events", "delivery", dict(load_id="load_id", truck_id="truck_id", driver_id="driver_id",
        revenue="revenue", delivery_status="status", on_time_flag="on_time", detention_minutes="detention_minutes",
        event_date="date")),
    ("src_trucks", "truck", dict(truck_id="truck_id", description="description")),
    ("src_drivers", "driver", dict(driver_id="driver_id", description="description")),
    ("src_customers", "customer", dict(customer_id="customer_id", origin_city="origin_city", description="description")),
    ("src_facilities", "facility", dict(facility_id="facility_id", description="description")),
    ("src_routes", "route", dict(route_id="route_id", description="notes")),
    ("src_trips", "trip", dict(trip_id="trip_id", driver_id="driver_id", truck_id="truck_id", trailer_id="trailer_id", origin_city="origin_city",
        destination_city="destination_city", distance_miles="distance_miles", event_date="TRY_CAST(event_date AS DATE)")),
    ("src_trailers", "trailer", dict(trailer_id="trailer_id", description="notes")),
    ("src_fuel_purchases", "fuel", dict(truck_id="truck_id", fuel_gallons="fuel_gallons", fuel_cost="TRY_CAST(fuel_cost AS DOUBLE)", event_date="date")),
    ("src_maintenance_records", "maintenance", dict(truck_id="truck_id", maintenance_type="service_type", maintenance_cost="maintenance_cost",
        event_date="date", description="notes")),
    ("src_safety_incidents", "safety", dict(driver_id="driver_id", safety_incident_type="incident_type", event_date="event_date",
        event_timestamp="timestamp", description="description")),
    ("src_driver_monthly_metrics", "driver_metric", dict(driver_id="driver_id", distance_miles="distance_miles", revenue="revenue", description="description")),
    ("src_truck_utilization_metrics", "truck_metric", dict(truck_id="truck_id", distance_miles="distance_miles", detention_minutes="detention_minutes", description="notes")),
]
_ORDER = ", ".join(f"{c} ASC NULLS FIRST" for c in _UNIFIED[2:])

PROFILE = "route_id, vehicle_weight_tons, vehicle_height_mt"

CTES = {
    "heat": """SELECT state, city, date_trunc('hour', start_time) AS hour, count(*) AS incident_count,
        avg(severity) AS avg_severity FROM accidents GROUP BY 1, 2, 3""",
    "heat_city": """SELECT state, city, count(*) AS incident_count, avg(severity) AS avg_severity
        FROM accidents GROUP BY 1, 2""",
    "readings": """SELECT station, date, nullif(prcp, 999.9e0) AS prcp, nullif(sndp, 999.9e0) AS sndp, visib FROM weather""",
    "alerts": """SELECT station, date, prcp, sndp, visib, CASE WHEN prcp > 50 THEN 'Heavy precipitation expected'
        WHEN sndp > 10 THEN 'Significant snowfall' WHEN visib < 1 THEN 'Low visibility conditions'
        ELSE 'Normal conditions' END AS weather_alert FROM readings""",
    "ops_union": "\nUNION ALL ".join(_unified(*o) for o in _OPS),
    "ops_records": f"""SELECT record_type || '_' || CAST(row_number() OVER (PARTITION BY record_type ORDER BY {_ORDER}) - 1
        AS VARCHAR) AS record_id, * EXCLUDE (record_id) FROM ops_union""",
    "hits": f"""SELECT route_id, bridge_id, clearance_mt, load_limit_tons, distance_m
        FROM ({near_route('bridges', 'latitude', 'longitude', 500.0)}) h""",
    "met": """SELECT q.request_id, q.route_id, vehicle_weight_tons, vehicle_height_mt, bridge_id, clearance_mt, load_limit_tons,
        load_limit_tons / nullif(vehicle_weight_tons, 0) AS weight_margin, clearance_mt - vehicle_height_mt AS clearance_margin,
        coalesce(load_limit_tons < vehicle_weight_tons, false) OR coalesce(clearance_mt < vehicle_height_mt, false) AS fails
        FROM route_requests q JOIN hits h ON h.route_id = q.route_id""",
    "per_request": """SELECT q.request_id, q.route_id, count(bridge_id) AS intersecting_count,
        min(weight_margin) AS min_weight_margin, min(clearance_margin) AS min_clearance_margin,
        count(*) FILTER (WHERE fails) AS n_failing FROM route_requests q LEFT JOIN met m ON m.request_id = q.request_id
        GROUP BY 1, 2""",
    "worst_w": """SELECT request_id, 'weight limit exceeded on bridge ' || bridge_id || ' (limit '
        || printf('%.1f', load_limit_tons) || ' t < vehicle ' || printf('%.1f', vehicle_weight_tons) || ' t)' AS txt
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY weight_margin, bridge_id) AS rn FROM met
        WHERE fails AND weight_margin < 1) x WHERE rn = 1""",
    "worst_h": """SELECT request_id, 'height clearance insufficient on bridge ' || bridge_id || ' (clearance '
        || printf('%.2f', clearance_mt) || ' m < vehicle ' || printf('%.2f', vehicle_height_mt) || ' m)' AS txt
        FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY clearance_margin, bridge_id) AS rn FROM met
        WHERE fails AND clearance_margin < 0) x WHERE rn = 1""",
    "verdicts": """SELECT p.*, CASE WHEN n_failing > 0 THEN 'HARD_VETO' ELSE 'PASS' END AS verdict,
        CASE WHEN n_failing > 0 THEN 'HARD VETO — route blocked: ' || concat_ws('; ', w.txt, h.txt) || '. (' || n_failing
          || ' non-compliant bridge(s) of ' || intersecting_count || ' intersecting the route.)' ELSE '' END AS veto_reason
        FROM per_request p LEFT JOIN worst_w w ON w.request_id = p.request_id
        LEFT JOIN worst_h h ON h.request_id = p.request_id""",
    "replies": """SELECT request_id, CASE WHEN position(',' IN reply) > 0 THEN trim(substr(reply, position(',' IN reply) + 1))
        ELSE 'Heuristic pattern' END AS reason, greatest(0.0e0, least(1.0e0, coalesce(TRY_CAST(trim(split_part(reply, ',', 1))
        AS DOUBLE), 0.5e0))) AS score FROM risk_replies""",
    "decisions": """SELECT v.request_id, v.route_id, n_failing > 0 AS blocked, v.veto_reason, intersecting_count,
        min_weight_margin, min_clearance_margin, r.score, r.reason FROM verdicts v JOIN replies r ON r.request_id = v.request_id""",
    "centroids": """SELECT label AS query_id, list(m ORDER BY pos) AS vector FROM (SELECT label, pos, avg(x) AS m FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e
        GROUP BY 1, 2) c GROUP BY 1""",
    "cosines": """SELECT query_id, vec_id AS chunk_id, label, round(list_dot_product(vector, e) / (sqrt(list_dot_product(vector, vector))
        * sqrt(list_dot_product(e, e))), 9) AS score FROM centroids, (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) x""",
    "cosine_hits": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM cosines) x WHERE rank <= 5""",
    "l2_hits": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM (
        SELECT query_id, vec_id AS chunk_id, round(list_distance(vector, CAST(embedding AS DOUBLE[])), 9) AS distance
        FROM centroids, embeddings) d) x WHERE rank <= 5""",
    "delays": """SELECT *, days_for_shipping_real - days_for_shipment_scheduled AS delay_days FROM shipments""",
    "fleet30": """SELECT truck_id, truck_make, truck_year, fuel_type, driver_name, driver_terminal, count(*) AS trips,
        round(CAST(sum(CAST(actual_distance_miles AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_miles,
        round(CAST(sum(CAST(average_mpg AS DECIMAL(18,6))) AS DOUBLE) / count(*), 2) AS avg_mpg,
        CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM trips WHERE trip_status = 'Completed' AND fuel_type IN ('Diesel', 'CNG', 'Electric')
        GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) >= 5 ORDER BY sum(revenue) DESC, truck_id, truck_make, truck_year, fuel_type, driver_name, driver_terminal LIMIT 30""",
    "fuel_spend": """SELECT location, location_state, CAST(sum(fuel_cost) AS DOUBLE) AS total_spend,
        CAST(sum(CAST(fuel_gallons AS DECIMAL(18,4))) AS DOUBLE) AS total_gallons,
        CAST(sum(price_per_gallon) AS DOUBLE) / count(*) AS avg_price_per_gallon FROM fuel GROUP BY 1, 2""",
    "scorecard": """SELECT route_id, count(*) AS total_loads, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
        CAST(sum(revenue) - sum(cost) AS DOUBLE) AS gross_profit,
        CAST(sum(revenue) - sum(cost) AS DOUBLE) / CAST(sum(revenue) AS DOUBLE) * 100 AS margin_pct,
        CAST(sum(CAST(average_mpg AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS avg_mpg FROM trips GROUP BY 1""",
    "pairs_text": """SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output, s.text AS context
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1) s
        ON s.conv_id = u.conv_id WHERE u.role = 'user'""",
    "asked": """SELECT item_id AS query_id, text AS q, CASE WHEN item_id % 3 <> 0 THEN 'item ' || item_id ELSE '' END AS e FROM benchmark""",
    "shown": """SELECT *, row_number() OVER (ORDER BY example_id) AS rn FROM (SELECT conv_id * 100 + turn AS example_id, instruction,
        coalesce(context, '') AS context, output FROM pairs_text) x""",
    "doc_words": r"""SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents""",
    "bm_tf": """SELECT doc_id, len(ws) AS dl, word, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS word FROM doc_words) x
        GROUP BY doc_id, dl, word""",
    "bm_query": r"""SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark""",
    "bm_scores": """SELECT query_id, doc_id AS chunk_id, round(sum(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5e0) / (df + 0.5e0))
        * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / (SELECT avg(len(ws)) FROM doc_words)))), 9) AS score
        FROM bm_query JOIN bm_tf USING (word) JOIN (SELECT word, count(*) AS df FROM bm_tf GROUP BY 1) f USING (word) GROUP BY 1, 2""",
    "bm_hits": """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
        FROM bm_scores WHERE score > 0) x WHERE rank <= 5""",
}

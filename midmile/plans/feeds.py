"""Registered queries for streams over the given tables; each runs until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from midmile.operators import analytics as A
from midmile.plans import medallion
from midmile.plans.registry import register
from midmile.plans.views import Views
from midmile.runtime import fresh_path
from midmile.sources.schema import columns
from midmile.streaming import feeds, joined, keyed

EVENT = columns("event_id bigint, user_id bigint, event_type string, value double")


def _arrive(v: Views, folder: str, part: int, of: int = 2) -> None:
    """Drop a share of the events into an arrival folder; all shares together are the table."""
    rows = v.events.where(F.col("event_id") % of == part).select(*EVENT.fieldNames())
    rows.write.mode("append").option("header", True).csv(folder)


_PER_TYPE = "SELECT event_type, count(*) AS records, sum(user_id) :: BIGINT AS users FROM events GROUP BY 1"


def _per_type(df):
    return df.groupBy("event_type").agg(F.count("*").alias("records"), F.sum("user_id").alias("users"))


@register(
    "s7_load_new",
    """SELECT event_type, count(*) AS records, (SELECT count(*) FROM events WHERE event_id % 2 = 0) AS first_load,
       (SELECT count(*) FROM events WHERE event_id % 2 = 1) AS second_load, CAST(0 AS BIGINT) AS third_load FROM events GROUP BY 1""",
)
def _(v: Views):
    src, dst, ckpt = (fresh_path(v.spark, f"new-{n}") for n in ("src", "dst", "ckpt"))
    loaded = []
    for part in (0, 1, None):
        if part is not None:
            _arrive(v, src, part)
        loaded.append(feeds.load_new(v.spark, src, dst, EVENT, ckpt))
    counts = v.spark.read.schema(EVENT).parquet(dst).groupBy("event_type").agg(F.count("*").alias("records"))
    names = ("first_load", "second_load", "third_load")
    return counts.withColumns({n: F.lit(c).cast("long") for n, c in zip(names, loaded)})


@register("x1_stream_files", _PER_TYPE)
def _(v: Views):
    src, dst, ckpt = (fresh_path(v.spark, f"feed-{n}") for n in ("src", "dst", "ckpt"))
    for part in (0, 1, None):  # the last round restarts with nothing new
        if part is not None:
            _arrive(v, src, part)
        feeds.stream_files(v.spark, src, EVENT, dst, ckpt).awaitTermination()
    return _per_type(v.spark.read.schema(EVENT).parquet(dst))


def _fed(v: Views, dataset: str, rows, key: str):
    """The rows as files that arrive in two parts, one with a broken line, and a restart without news; the loaded table."""
    src, dst, bad_dst, ckpt = (fresh_path(v.spark, f"{dataset}-{n}".replace(".", "-")) for n in ("src", "dst", "bad", "ckpt"))
    text = rows.select([F.col(f"`{c}`").cast("string") for c in rows.columns])
    for part in (0, 1, None):
        if part is not None:
            text.where(F.pmod(F.col(f"`{key}`").cast("long"), F.lit(2)) == part).write.mode("append").option("header", True).csv(src)
        if part == 1:
            broken = v.spark.createDataFrame([(",".join(rows.columns),), ("only one cell",)], "value string").coalesce(1)
            broken.write.mode("append").text(src)
        medallion.feed(v.spark, dataset, src, rows.columns, dst, bad_dst, ckpt)
    n_bad = v.spark.read.schema(f"{feeds.BAD_ROW} string").parquet(bad_dst).agg(F.count("*")).scalar()
    return v.spark.read.parquet(dst).withColumn("broken", n_bad)


@register(
    "x1_feed_accidents",
    """SELECT CAST(accident_id AS VARCHAR) AS accident_id, start_time, state, city, severity, start_lat, start_lng, CAST(1 AS BIGINT) AS broken FROM accidents""",
)
def _(v: Views):
    names = {"Severity": "severity", "ID": "accident_id", "Start_Time": "start_time", "City": "city", "State": "state", "Start_Lat": "start_lat", "Start_Lng": "start_lng"}
    rows = v.accidents.select([F.col(c).alias(n) for n, c in names.items()])
    loaded = _fed(v, "accidents", rows, "ID")
    return loaded.select("accident_id", "start_time", "state", "city", "severity", "start_lat", "start_lng", "broken")


@register(
    "x1_feed_bridges",
    """SELECT CAST(bridge_id AS VARCHAR) AS bridge_id, bridge_name, state_code, condition, clearance_mt, load_limit_tons, latitude, longitude,
       CAST(1 AS BIGINT) AS broken FROM bridges""",
)
def _(v: Views):
    names = {source: c for source, c in medallion.BRIDGE_COLUMNS.items()}
    loaded = _fed(v, "bridges", v.bridges.select([F.col(c).alias(n) for n, c in names.items()]), "STRUCTURE_NUMBER_008")
    return loaded.select(*names.values(), "broken")


@register(
    "x1_feed_orders",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, order_date, shipping_mode, days_for_shipping_real, days_for_shipment_scheduled, late_delivery_risk,
       CAST(1 AS BIGINT) AS broken FROM shipments""",
)
def _(v: Views):
    names = {
        "Shipping Mode": "shipping_mode", "Days for shipping (real)": "days_for_shipping_real", "Days for shipment (scheduled)": "days_for_shipment_scheduled",
        "Late_delivery_risk": "late_delivery_risk", "Order Id": "order_id", "order date (DateOrders)": "order_date",
    }
    loaded = _fed(v, "orders", v.shipments.select([F.col(c).alias(n) for n, c in names.items()]), "Order Id")
    return loaded.select(*names.values(), "broken")


_LOADED = "record_type, load_id, customer_id, origin_city, destination_city, distance_miles, revenue, cost, delivery_status, booking_type, event_date"


@register("x1_feed_operations", f"SELECT {_LOADED}, CAST(1 AS BIGINT) AS broken FROM ops_union WHERE record_type = 'load'")
def _(v: Views):
    return _fed(v, "loads.csv", v.src_loads, "load_id").select(*_LOADED.split(", "), "broken")


@register(
    "x2_stream_quarantine",
    """SELECT count(*) FILTER (WHERE event_id % 10 <> 3) AS good, count(*) FILTER (WHERE event_id % 10 = 3) AS bad, count(*) AS total FROM events""",
)
def _(v: Views):
    src, dst, bad_dst, ckpt = (fresh_path(v.spark, f"quarantine-{n}") for n in ("src", "good", "bad", "ckpt"))
    value = F.when(F.col("event_id") % 10 == 3, "not a number").otherwise(F.col("value").cast("string"))
    rows = v.events.select("event_id", "user_id", "event_type", value.alias("value"))
    rows.write.option("header", True).csv(src)
    feeds.stream_with_quarantine(v.spark, src, EVENT, dst, bad_dst, ckpt).awaitTermination()
    good = v.spark.read.schema(EVENT).parquet(dst).select(F.lit(1).alias("good"), F.lit(0).alias("bad"))
    bad = v.spark.read.parquet(bad_dst).select(F.lit(0).alias("good"), F.lit(1).alias("bad"))
    return good.unionByName(bad).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("total"))


@register("x3_stream_heatmap", "SELECT state, city, hour, incident_count, avg_severity FROM heat")
def _(v: Views):
    dst, ckpt = fresh_path(v.spark, "heat-fresh"), fresh_path(v.spark, "heat-ckpt")
    arriving = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    accidents = arriving.join(v.nation, F.col("n_nationkey") == F.col("user_id") % 25).select(
        F.col("ts").cast("timestamp").alias("start_time"), F.col("n_name").alias("state"), F.col("event_type").alias("city"),
        (1 + F.col("event_id") % 4).cast("int").alias("severity"),
    )
    feeds.stream_heatmap(accidents, dst, ckpt).awaitTermination()
    return feeds.fresh_heatmap(v.spark, dst).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _in_parts(v: Views, rows, at: str, folder: str, parts: int = 3):
    """Drop rows into ``folder`` in the order of ``at``, an equal span of time each time."""
    first, last = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    span = (last - first) // parts + 1
    for part in range(parts):
        due = F.floor((F.unix_micros(at) - first) / span) == part
        rows.where(due).drop(at).write.mode("append").parquet(folder)
        yield part


_INCIDENT = columns("state string, city string, start_time timestamp, severity int")


@register("x3_keyed_heatmap", "SELECT state, city, hour, incident_count, avg_severity FROM heat")
def _(v: Views):
    """Incidents that come up to three hours late, to a stream that closes hours after two and starts anew for every part."""
    src, dst, ckpt = (fresh_path(v.spark, f"keyed-{n}") for n in ("src", "dst", "ckpt"))
    late = F.make_interval(hours=(F.col("accident_id") % 4).cast("int"))
    at = F.col("start_time").cast("timestamp")
    rows = v.accidents.select("state", "city", at.alias("start_time"), "severity", (at + late).alias("arrives"))
    for _ in _in_parts(v, rows, "arrives", src):
        stream = feeds.read_feed(v.spark, src, _INCIDENT, fmt="parquet")
        keyed.stream_keyed_heatmap(stream, dst, ckpt).awaitTermination()
    found = keyed.keyed_heatmap(v.spark, dst).drop("corrections")
    return found.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_PLACED = columns("place string, start_time timestamp, severity int")
_READING = columns("place string, observed_at timestamp, visib double")
# A reading of a state's stations for every delivery, in the days of the incidents.
_READINGS = """SELECT n_name AS place, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' SECOND * CAST((l_orderkey * 7919 + l_linenumber * 104729) % 2592000 AS INT) AS observed_at,
    CASE WHEN l_partkey % 83 = 0 THEN NULL ELSE l_tax * 100 END AS visib FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey"""


@register(
    "x4_joined_patches",
    f"""SELECT place, to_timestamp(w) :: TIMESTAMP AS patch_start, to_timestamp(w + 28800) :: TIMESTAMP AS patch_end, count(*) AS readings,
        count(*) FILTER (WHERE visib < 1) AS bad_readings, sum(severity) :: BIGINT AS severity_sum FROM (
          SELECT place, visib, severity, unnest([s - s % 14400, s - s % 14400 - 14400]) AS w FROM (
            SELECT r.place, visib, severity, CAST(floor(epoch(start_time)) AS BIGINT) AS s FROM accidents a JOIN ({_READINGS.format(lineitem="lineitem", supplier="supplier", nation="nation")}) r
            ON r.place = a.state AND observed_at BETWEEN start_time - INTERVAL 2 HOUR AND start_time) j) p GROUP BY 1, 2, 3""",
)
def _(v: Views):
    """Incidents and readings as two streams, and rows behind all of them that let the last patches pass."""
    left, right, dst, ckpt = (fresh_path(v.spark, f"joined-{n}") for n in ("left", "right", "dst", "ckpt"))
    incidents = v.accidents.select(F.col("state").alias("place"), F.col("start_time").cast("timestamp").alias("start_time"), "severity")
    readings = v.spark.sql(_READINGS, lineitem=v.lineitem, supplier=v.supplier, nation=v.nation).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    end = "TIMESTAMP '2024-03-01 00:00:00'"

    def run() -> None:
        a = feeds.read_feed(v.spark, left, _PLACED, fmt="parquet")
        b = feeds.read_feed(v.spark, right, _READING, fmt="parquet")
        joined.stream_joined_patches(a, b, F.col("visib") < 1, dst, ckpt).awaitTermination()

    pairs = zip(_in_parts(v, incidents.withColumn("at", F.col("start_time")), "at", left, 2), _in_parts(v, readings.withColumn("at", F.col("observed_at")), "at", right, 2), strict=True)
    for _ in pairs:
        run()
    v.spark.sql(f"SELECT 'end' AS place, {end} AS start_time, 1 AS severity").write.mode("append").parquet(left)
    v.spark.sql(f"SELECT 'end of readings' AS place, {end} AS observed_at, 1.0D AS visib").write.mode("append").parquet(right)
    run()
    found = v.spark.read.schema("place string, patch_start timestamp, patch_end timestamp, readings bigint, bad_readings bigint, severity_sum bigint").parquet(dst)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("patch_start", "patch_end")})


@register(
    "x5_stream_log",
    """SELECT count(*) AS total, avg(CASE WHEN is_grounded THEN 1 ELSE 0 END) * 100 AS grounded_pct, avg(execution_time_ms) AS avg_ms,
       (SELECT count(*) FROM query_log) AS lines FROM (SELECT * FROM query_log ORDER BY created_at DESC, query_id LIMIT 25) x""",
)
def _(v: Views):
    src, dst, ckpt = (fresh_path(v.spark, f"log-{n}") for n in ("src", "dst", "ckpt"))
    log = v.query_log.withColumn("created_at", F.col("created_at").cast("string"))
    schema = columns("query_id bigint, user_id bigint, query_text string, execution_time_ms bigint, is_grounded boolean, created_at string")
    for part in (0, 1):
        log.where(F.col("query_id") % 2 == part).write.mode("append").json(src)
        feeds.stream_log(v.spark, src, schema, dst, ckpt).awaitTermination()
    stored = v.spark.read.schema(schema).parquet(dst).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    return A.log_summary(stored).withColumn("lines", stored.agg(F.count("*")).scalar())

"""Registered queries for aggregates, enrichment, data checks and evaluation figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from midmile.operators import analytics as A
from midmile.operators import metrics as M
from midmile.operators import quality as Q
from midmile.operators import silver as S
from midmile.plans.registry import register
from midmile.plans.views import Views
from midmile.runtime import fresh_path
from midmile.sources.tables import describe_columns
from midmile.sources.writers import write_full
from midmile.streaming import feeds


def _heat(v: Views):
    return A.risk_heatmap(v.accidents)


def _alerts(v: Views):
    return S.weather_alerts(v.weather)


def _double(*columns: str):
    return {c: F.col(c).cast("double") for c in columns}


# ---- aggregates --------------------------------------------------------------------


@register("a1_risk_heatmap", "SELECT state, city, hour, incident_count, avg_severity FROM heat")
def _(v: Views):
    return _heat(v)


@register("a2_heatmap_by_city", "SELECT state, city, incident_count, round(avg_severity, 9) AS avg_severity FROM heat_city")
def _(v: Views):
    return A.heatmap_by_city(_heat(v)).withColumn("avg_severity", F.round("avg_severity", 9))


@register(
    "a3_risk_score",
    """SELECT state, city, round(0.5e0 * (incident_count - min(incident_count) OVER ()) / (max(incident_count) OVER () - min(incident_count) OVER ())
       + 0.5e0 * (avg_severity - min(avg_severity) OVER ()) / (max(avg_severity) OVER () - min(avg_severity) OVER ()), 8) AS risk_score FROM heat_city""",
)
def _(v: Views):
    scored = A.risk_score(A.heatmap_by_city(_heat(v)))
    return scored.select("state", "city", F.round("risk_score", 8).alias("risk_score"))


_FLEET = "truck_id, truck_make, truck_year, fuel_type, driver_name, driver_terminal, trips, total_miles, avg_mpg, total_revenue"


@register("a6_fleet_table", f"SELECT {_FLEET} FROM fleet30")
def _(v: Views):
    return A.fleet_table(v.trips).withColumns(_double("total_miles", "avg_mpg", "total_revenue"))


@register(
    "a7_fleet_kpis",
    "SELECT count(*) AS total_trucks, round(sum(total_revenue), 2) AS total_revenue, round(avg(avg_mpg), 4) AS avg_mpg FROM fleet30",
)
def _(v: Views):
    return A.fleet_kpis(v.trips).select(
        "total_trucks", F.round(F.col("total_revenue").cast("double"), 2).alias("total_revenue"),
        F.round(F.col("avg_mpg").cast("double"), 4).alias("avg_mpg"),
    )


@register("a8_route_scorecard", "SELECT route_id, total_loads, total_revenue, gross_profit, margin_pct, avg_mpg FROM scorecard")
def _(v: Views):
    return A.route_scorecard(v.trips).withColumns(_double("total_revenue", "gross_profit"))


_TOP_ROUTES = "SELECT * FROM scorecard WHERE total_loads >= 5 AND margin_pct >= 0 ORDER BY gross_profit DESC, route_id LIMIT 25"


@register("a8_top_routes", f"SELECT route_id, total_loads, total_revenue, gross_profit, margin_pct, avg_mpg FROM ({_TOP_ROUTES}) x")
def _(v: Views):
    return A.profitable(A.route_scorecard(v.trips)).withColumns(_double("total_revenue", "gross_profit"))


@register(
    "a8_route_kpis",
    f"""SELECT count(*) AS total_routes, round(avg(margin_pct), 4) AS avg_margin_pct, round(sum(total_revenue), 2) AS total_revenue,
        round(avg(avg_mpg), 4) AS avg_mpg FROM ({_TOP_ROUTES}) x""",
)
def _(v: Views):
    return A.route_kpis(A.route_scorecard(v.trips)).select(
        "total_routes", F.round("avg_margin_pct", 4).alias("avg_margin_pct"),
        F.round(F.col("total_revenue").cast("double"), 2).alias("total_revenue"),
        F.round(F.col("avg_mpg").cast("double"), 4).alias("avg_mpg"),
    )


@register(
    "a9_fuel_by_location",
    "SELECT location, location_state, total_spend, total_gallons, avg_price_per_gallon FROM fuel_spend",
)
def _(v: Views):
    return A.fuel_by_location(v.fuel).withColumns(_double("total_spend", "total_gallons"))


@register(
    "a10_fuel_kpis",
    """SELECT round(sum(total_spend), 2) AS total_spend, round(sum(total_gallons), 2) AS total_gallons,
       round(avg(avg_price_per_gallon), 4) AS avg_price_per_gallon FROM (SELECT * FROM fuel_spend
       ORDER BY total_spend DESC, location, location_state LIMIT 50) x""",
)
def _(v: Views):
    return A.fuel_kpis(v.fuel).select(
        F.round(F.col("total_spend").cast("double"), 2).alias("total_spend"),
        F.round(F.col("total_gallons").cast("double"), 2).alias("total_gallons"),
        F.round(F.col("avg_price_per_gallon").cast("double"), 4).alias("avg_price_per_gallon"),
    )


@register(
    "a10_fuel_by_state",
    """SELECT location_state, round(sum(total_spend), 2) AS total_spend FROM (SELECT * FROM fuel_spend
       ORDER BY total_spend DESC, location, location_state LIMIT 50) x GROUP BY 1""",
)
def _(v: Views):
    return A.fuel_by_state(v.fuel).withColumn("total_spend", F.round(F.col("total_spend").cast("double"), 2))


@register(
    "a11_safety_kpis",
    """SELECT count(*) AS total_incidents, CAST(round(sum(claim_amount), 0) AS DOUBLE) AS total_claims,
       round(avg(CASE WHEN at_fault_flag THEN 1 ELSE 0 END) * 100, 1) AS at_fault_pct,
       round(avg(CASE WHEN injury_flag THEN 1 ELSE 0 END) * 100, 1) AS injury_pct,
       CAST(round(sum(vehicle_damage_cost), 0) AS DOUBLE) AS total_vehicle_damage,
       round(avg(CASE WHEN preventable_flag THEN 1 ELSE 0 END) * 100, 1) AS preventable_pct FROM safety""",
)
def _(v: Views):
    return A.safety_kpis(v.safety).withColumns(_double("total_claims", "total_vehicle_damage"))


@register(
    "a12_safety_by_type",
    """SELECT incident_type, count(*) AS incidents, CAST(round(sum(claim_amount), 0) AS DOUBLE) AS claims,
       round(CAST(sum(claim_amount) AS DOUBLE) / count(claim_amount), 0) AS avg_claim FROM safety GROUP BY 1""",
)
def _(v: Views):
    return A.safety_by_type(v.safety).withColumns(_double("claims", "avg_claim"))


@register("a13_global_late_risk", "SELECT avg(TRY_CAST(late_delivery_risk AS INT)) AS global_risk FROM shipments")
def _(v: Views):
    return A.global_late_risk(v.shipments)


@register(
    "a14_fuel_by_route",
    """SELECT route_id, CAST(sum(fuel_cost) AS DOUBLE) / count(*) AS avg_fuel_cost,
       CAST(sum(CAST(fuel_gallons AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_fuel_gallons FROM fuel GROUP BY 1""",
)
def _(v: Views):
    return A.fuel_by_route(v.fuel)


@register("a15_delay_by_mode", "SELECT shipping_mode, avg(delay_days) AS avg_delay_days, count(*) AS shipments FROM delays GROUP BY 1")
def _(v: Views):
    return A.delay_by_mode(v.shipments)


@register(
    "a16_log_summary",
    """SELECT count(*) AS total, avg(CASE WHEN is_grounded THEN 1 ELSE 0 END) * 100 AS grounded_pct, avg(execution_time_ms) AS avg_ms
       FROM (SELECT * FROM query_log ORDER BY created_at DESC, query_id LIMIT 25) x""",
)
def _(v: Views):
    return A.log_summary(v.query_log)


@register(
    "a17_pass_rates",
    """SELECT category, count(*) AS total, sum(CASE WHEN expected_verdict = actual_verdict THEN 1 ELSE 0 END) :: BIGINT AS passed,
       avg(CASE WHEN expected_verdict = actual_verdict THEN 1.0e0 ELSE 0.0e0 END) AS pass_rate, CAST(grouping(category) AS INT) AS level
       FROM golden GROUP BY ROLLUP (category)""",
)
def _(v: Views):
    return M.pass_rates(v.golden.withColumn("passed", F.col("expected_verdict") == F.col("actual_verdict")))


@register(
    "a18_latency_quantiles",
    """SELECT unnest([0.5e0, 0.9e0, 0.99e0]) AS q, unnest(CAST(quantile_disc(execution_time_ms, [0.5, 0.9, 0.99]) AS DOUBLE[])) AS value FROM query_log""",
)
def _(v: Views):
    return A.latency_quantiles(v.query_log)


@register("a19_alert_timeline", "SELECT date, weather_alert, count(*) AS alerts FROM alerts GROUP BY 1, 2")
def _(v: Views):
    return A.alert_timeline(_alerts(v))


@register("a20_severity_histogram", "SELECT severity, count(*) AS incidents FROM accidents GROUP BY 1")
def _(v: Views):
    return A.severity_histogram(v.accidents)


@register(
    "a21_condition_rollup",
    """SELECT state_code, condition, count(*) AS bridges, CAST(grouping(state_code) * 2 + grouping(condition) AS INT) AS level
       FROM bridges GROUP BY ROLLUP (state_code, condition)""",
)
def _(v: Views):
    return A.condition_rollup(v.bridges)


# ---- enrichment and joins over result tables ---------------------------------------


@register(
    "j5_enrich_ops",
    """SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
       LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def _(v: Views):
    rich = A.enrich_ops(v.orders, {"o_custkey": (v.customer, "c_custkey"), "c_nationkey": (v.nation, "n_nationkey")})
    return rich.select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment", "n_name")


@register(
    "j6_match_predictions",
    "SELECT id, category, expected_verdict, actual_verdict, expected_verdict = actual_verdict AS passed FROM golden",
)
def _(v: Views):
    both = M.match_predictions(v.golden.drop("actual_verdict"), v.golden.select("id", "actual_verdict"))
    return both.select("id", "category", "expected_verdict", "actual_verdict", "passed")


@register("j7_pair_variants", """SELECT b.pair_id, b.actual_verdict AS base_verdict, n.actual_verdict AS variant_verdict FROM golden b
       JOIN golden n ON n.pair_id = b.pair_id AND n.role = 'variant' WHERE b.role = 'base'""")
def _(v: Views):
    return M.pair_variants(v.golden)


@register("j9_orphans", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(v: Views):
    return Q.orphans(v.documents, v.labels, "doc_id", "doc_id").select("doc_id", "lang")


# ---- data checks -------------------------------------------------------------------

_CHECK = "SELECT '{0}' AS \"check\", '{1}' AS \"table\", '{2}' AS \"column\", CAST({3} AS DOUBLE) AS observed, CAST({4} AS DOUBLE) AS threshold, CASE WHEN {5} THEN 'PASS' ELSE 'FAIL' END AS status FROM {6}"


@register(
    "q1_min_rows",
    _CHECK.format("min_rows", "accidents", "*", "count(*)", 1000, "count(*) >= 1000", "accidents")
    + " UNION ALL " + _CHECK.format("min_rows", "bridges", "*", "count(*)", 1000000000, "count(*) >= 1000000000", "bridges"),
)
def _(v: Views):
    return Q.check_min_rows({"accidents": v.accidents, "bridges": v.bridges}, {"accidents": 1000, "bridges": 1000000000})


@register(
    "q2_columns",
    " UNION ALL ".join(
        f"SELECT 'column_present' AS \"check\", 'heat' AS \"table\", '{c}' AS \"column\", {n}.0e0 AS observed, 1.0e0 AS threshold, '{s}' AS status"
        for c, n, s in [("STATE", 1, "PASS"), ("INCIDENT_COUNT", 1, "PASS"), ("_UPDATED_AT", 0, "FAIL")]
    ),
)
def _(v: Views):
    """The heatmap as it is stored, without the stamp that is asked for."""
    db = f"silver_{uuid.uuid4().hex}"
    v.spark.sql(f"CREATE DATABASE {db} LOCATION '{fresh_path(v.spark, db)}'")
    write_full(_heat(v), f"{db}.heat")
    required = v.spark.createDataFrame(
        [("heat", c) for c in ("STATE", "INCIDENT_COUNT", "_UPDATED_AT")], "table_name string, column_name string"
    )
    return Q.check_columns(describe_columns(v.spark, db), required)


@register(
    "q3_null_rate",
    " UNION ALL ".join(
        _CHECK.format("null_rate", "bridges", c, f"avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)", t, f"avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= {t}", "bridges")
        for c, t in [("clearance_mt", 0.05), ("load_limit_tons", 0.01), ("bridge_name", 0.0)]
    ),
)
def _(v: Views):
    return Q.check_null_rate(v.bridges, "bridges", {"clearance_mt": 0.05, "load_limit_tons": 0.01, "bridge_name": 0.0})


@register(
    "q4_range",
    " UNION ALL ".join(
        _CHECK.format("range", "accidents", c, f"count(*) FILTER (WHERE {c} < {a} OR {c} > {b})", 0, f"count(*) FILTER (WHERE {c} < {a} OR {c} > {b}) = 0", "accidents")
        for c, a, b in [("severity", 1, 4), ("start_lat", -90, 90), ("start_lng", -100, 180)]
    ),
)
def _(v: Views):
    return Q.check_range(v.accidents, "accidents", {"severity": (1, 4), "start_lat": (-90, 90), "start_lng": (-100, 180)})


@register(
    "q5_no_future",
    _CHECK.format("no_future", "accidents", "start_time", "count(*) FILTER (WHERE start_time > TIMESTAMP '2024-01-15 00:00:00')", 0,
                  "count(*) FILTER (WHERE start_time > TIMESTAMP '2024-01-15 00:00:00') = 0", "accidents"),
)
def _(v: Views):
    return Q.check_no_future(v.accidents, "accidents", "start_time", "2024-01-15 00:00:00")


@register(
    "q6_foreign_key",
    _CHECK.format("foreign_key", "orders", "o_custkey", "count(*)", 0, "count(*) = 0", "orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
    + " UNION ALL "
    + _CHECK.format("foreign_key", "documents", "doc_id", "count(*)", 0, "count(*) = 0", "documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
)
def _(v: Views):
    good = Q.check_fk(v.orders, v.customer, "o_custkey", "c_custkey", "orders")
    return good.unionByName(Q.check_fk(v.documents, v.labels, "doc_id", "doc_id", "documents"))


@register(
    "q7_unique",
    _CHECK.format("unique", "lineitem", "l_orderkey,l_linenumber", "count(*)", 0, "count(*) = 0",
                  "(SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) d"),
)
def _(v: Views):
    return Q.check_unique(v.lineitem, "lineitem", ["l_orderkey", "l_linenumber"])


@register(
    "q8_geo_bounds",
    " UNION ALL ".join(
        _CHECK.format("geo_bounds", "bridges", c, f"count(*) FILTER (WHERE {c} < {a} OR {c} > {b})", 0, f"count(*) FILTER (WHERE {c} < {a} OR {c} > {b}) = 0", "bridges")
        for c, a, b in [("latitude", 24, 50), ("longitude", -125, -66)]
    ),
)
def _(v: Views):
    return Q.check_geo_bounds(v.bridges, "bridges", "latitude", "longitude")


_RECOUNT = """(SELECT coalesce(a.state, b.state) AS s, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM
    (SELECT state, city, count(*) AS n FROM accidents GROUP BY 1, 2) a FULL OUTER JOIN
    (SELECT state, city, count(*) AS n FROM accidents WHERE severity < 4 GROUP BY 1, 2) b ON a.state = b.state AND a.city = b.city) r"""


@register(
    "q9_reconciles",
    _CHECK.format("reconciles", "heat", "incident_count", "0", 0, "true", "(SELECT count(*) FROM accidents) x")
    + " UNION ALL "
    + _CHECK.format("reconciles", "mild", "incident_count", "count(*) FILTER (WHERE x <> y)", 0, "count(*) FILTER (WHERE x <> y) = 0", _RECOUNT),
)
def _(v: Views):
    whole = Q.check_reconciles(v.accidents, _heat(v), ["state", "city"], "heat")
    mild = A.risk_heatmap(v.accidents.where("severity < 4"))  # an aggregate that lost its gravest rows
    return whole.unionByName(Q.check_reconciles(v.accidents, mild, ["state", "city"], "mild"))


@register(
    "q10_data_loss",
    _CHECK.format("data_loss_pct", "mild", "incident_count", "round(count(*) FILTER (WHERE severity >= 4) * 100.0e0 / count(*), 6)", 5,
                  "count(*) FILTER (WHERE severity >= 4) * 100.0e0 / count(*) <= 5", "accidents"),
)
def _(v: Views):
    mild = A.risk_heatmap(v.accidents.where("severity < 4"))
    return Q.check_data_loss(v.accidents, mild, "mild").withColumn("observed", F.round("observed", 6))


@register(
    "q11_known_points",
    """SELECT 'known_point' AS "check", 'stations' AS "table", CAST(station AS VARCHAR) AS "column", round(km, 4) AS observed, 1.0e0 AS threshold,
       CASE WHEN km <= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT station, 2 * 6371.0088 * asin(sqrt(sin(radians(CASE WHEN station % 5 = 0
       THEN 0.2 ELSE 0.001 END) / 2) ** 2)) AS km FROM stations) s""",
)
def _(v: Views):
    off = F.when(F.col("station") % 5 == 0, 0.2).otherwise(0.001)  # every fifth place is known elsewhere
    expected = v.stations.select(
        F.col("station"), (F.col("latitude") + off).alias("known_lat"), F.col("longitude").alias("known_lon")
    )
    checks = Q.check_known_points(v.stations, expected, 1.0, "stations", key="station")
    return checks.withColumn("observed", F.round("observed", 4))


@register("q12_text", _CHECK.format("text_not_empty", "documents", "text", "count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0)", 0,
                                    "count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0) = 0", "documents"))
def _(v: Views):
    return Q.check_text(v.documents, "documents", "text")


# ---- evaluation --------------------------------------------------------------------


@register(
    "e1_classification",
    """SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS "precision", tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall,
       2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0) AS f1, (tp + tn) / nullif(CAST(tp + fp + fn + tn + unknown AS DOUBLE), 0) AS accuracy FROM (
       SELECT category, count(*) FILTER (WHERE expected_verdict = 'HARD_VETO' AND actual_verdict = 'HARD_VETO') AS tp,
       count(*) FILTER (WHERE expected_verdict <> 'HARD_VETO' AND actual_verdict = 'HARD_VETO') AS fp,
       count(*) FILTER (WHERE expected_verdict = 'HARD_VETO' AND actual_verdict IS DISTINCT FROM 'HARD_VETO') AS fn,
       count(*) FILTER (WHERE expected_verdict <> 'HARD_VETO' AND actual_verdict = 'PASS') AS tn,
       count(*) FILTER (WHERE expected_verdict <> 'HARD_VETO' AND (actual_verdict IS NULL OR actual_verdict = 'ERROR')) AS unknown
       FROM (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN 'ERROR' WHEN id % 17 = 0 THEN NULL ELSE actual_verdict END AS actual_verdict) FROM golden) g GROUP BY 1) c""",
)
def _(v: Views):
    return M.classification_metrics(_with_failures(v.golden))


def _with_failures(golden):
    """Some scenarios ended in an error, or without a verdict."""
    verdict = F.when(F.col("id") % 13 == 0, "ERROR").when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("actual_verdict"))
    return golden.withColumn("actual_verdict", verdict)


@register(
    "e1_confusion_matrix",
    """SELECT expected_verdict, count(*) FILTER (WHERE actual_verdict = 'HARD_VETO') AS "HARD_VETO",
       count(*) FILTER (WHERE actual_verdict = 'PASS') AS "PASS", count(*) FILTER (WHERE actual_verdict = 'ERROR') AS other,
       count(*) FILTER (WHERE actual_verdict IS NULL) AS missing
       FROM (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN 'ERROR' WHEN id % 17 = 0 THEN NULL ELSE actual_verdict END AS actual_verdict) FROM golden) g GROUP BY 1""",
)
def _(v: Views):
    return M.confusion_matrix(_with_failures(v.golden))


@register(
    "e4_rubric_scores",
    """SELECT strategy, count(*) AS scenarios, avg(t) AS mean_score, avg(CASE WHEN t >= 7 THEN 1.0e0 ELSE 0.0e0 END) AS pass_rate FROM (
       SELECT strategy, decision + grounding + citation + reasoning + jargon AS t FROM rubric) x GROUP BY 1""",
)
def _(v: Views):
    return M.rubric_scores(v.rubric, ["decision", "grounding", "citation", "reasoning", "jargon"])


@register(
    "e5_metamorphic",
    """SELECT type, count(*) AS pairs, count(*) FILTER (WHERE CASE WHEN type = 'monotonicity' THEN NOT (x = 'HARD_VETO' AND y <> 'HARD_VETO')
       ELSE x = y END) AS hold FROM (SELECT CASE b.pair_id % 3 WHEN 0 THEN 'invariance' WHEN 1 THEN 'monotonicity' ELSE 'symmetry' END AS type,
       b.actual_verdict AS x, n.actual_verdict AS y FROM golden b JOIN golden n ON n.pair_id = b.pair_id AND n.role = 'variant' WHERE b.role = 'base') p
       GROUP BY 1""",
)
def _(v: Views):
    kind = F.when(F.col("pair_id") % 3 == 0, "invariance").when(F.col("pair_id") % 3 == 1, "monotonicity").otherwise("symmetry")
    judged = M.metamorphic(M.pair_variants(v.golden).withColumn("type", kind))
    return judged.groupBy("type").agg(F.count("*").alias("pairs"), F.count_if("holds").alias("hold"))


@register(
    "e6_compare_strategies",
    """SELECT count(*) AS n, avg(x) AS mean_a, avg(y) AS mean_b, round(avg(x - y), 9) AS mean_diff,
       round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 6) AS t_statistic FROM (SELECT a.scenario_id, a.score AS x, b.score AS y
       FROM strategy_scores a JOIN strategy_scores b ON b.scenario_id = a.scenario_id AND b.strategy = 'chains' WHERE a.strategy = 'plain') p""",
)
def _(v: Views):
    compared = M.compare_strategies(v.strategy_scores, "plain", "chains")
    return compared.withColumns({"mean_diff": F.round("mean_diff", 9), "t_statistic": F.round("t_statistic", 6)})


@register(
    "x4_patches",
    """SELECT patch_start, patch_start + INTERVAL 8 HOUR AS patch_end, count(*) AS incidents, avg(severity) AS mean_value FROM (
       SELECT unnest([time_bucket(INTERVAL 4 HOUR, start_time), time_bucket(INTERVAL 4 HOUR, start_time) - INTERVAL 4 HOUR]) AS patch_start,
       severity FROM accidents) x GROUP BY 1""",
)
def _(v: Views):
    return feeds.patches(v.accidents, "start_time", F.col("severity"))

"""Registered queries for the corridor joins and the safety gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from midmile.operators import gate as G
from midmile.operators import silver as S
from midmile.operators import spatial
from midmile.plans.oracle import PROFILE, near_route
from midmile.plans.registry import register
from midmile.plans.views import Views
from midmile.runtime import stage

CORRIDOR_M = 500.0


def _routes(v: Views):
    return spatial.with_route_points(v.routes)


def _hits(v: Views):
    return stage(G.bridge_hits(_routes(v), v.bridges, CORRIDOR_M), "bridge-hits")


def _fails(v: Views):
    return G.violations(_hits(v), v.route_requests)


@register("j1_corridor_join", "SELECT route_id, bridge_id, clearance_mt, load_limit_tons, round(distance_m, 2) AS distance_m FROM hits")
def _(v: Views):
    found = spatial.corridor_join(_routes(v), v.bridges, CORRIDOR_M)
    return found.select("route_id", "bridge_id", "clearance_mt", "load_limit_tons", F.round("distance_m", 2).alias("distance_m"))


_FAILED = f"SELECT DISTINCT {PROFILE}, bridge_id, weight_margin, clearance_margin FROM met WHERE fails"


@register("j2_violations", _FAILED)
def _(v: Views):
    return _fails(v).select(*G.PROFILE, "bridge_id", "weight_margin", "clearance_margin")


@register(
    "j3_route_blackspots",
    f"""SELECT route_id, count(*) AS incident_count, avg(severity) AS avg_severity FROM ({near_route('accidents', 'start_lat', 'start_lng', 5000.0)}) a
        GROUP BY 1""",
)
def _(v: Views):
    return spatial.route_blackspots(_routes(v), v.accidents, 5000.0)


_NEAREST = f"""SELECT route_id, date, station, weather_alert, round(distance_m, 2) AS distance_m FROM (
        SELECT n.route_id, a.date, n.station, a.weather_alert, n.distance_m,
        row_number() OVER (PARTITION BY n.route_id, a.date ORDER BY n.distance_m, n.station) AS rn
        FROM ({near_route('stations', 'latitude', 'longitude', 100000.0)}) n JOIN (SELECT station, date, min(weather_alert) AS weather_alert
        FROM alerts WHERE weather_alert <> 'Normal conditions' GROUP BY 1, 2) a ON a.station = n.station) r WHERE rn = 1"""


def _daily_alerts(v: Views):
    alerts = S.active_alerts(S.weather_alerts(v.weather))
    return stage(alerts.groupBy("station", "date").agg(F.min("weather_alert").alias("weather_alert")), "daily-alerts")


@register("j4_route_weather", _NEAREST)
def _(v: Views):
    return spatial.route_weather(_routes(v), v.stations, _daily_alerts(v)).withColumn("distance_m", F.round("distance_m", 2))


@register("j4_nearest_alerts", _NEAREST)
def _(v: Views):
    return spatial.nearest_alerts(_routes(v), v.stations, _daily_alerts(v)).withColumn("distance_m", F.round("distance_m", 2))


@register(
    "a4_gate_aggregate",
    "SELECT request_id, intersecting_count, min_weight_margin, min_clearance_margin FROM per_request",
)
def _(v: Views):
    return G.gate_aggregate(_hits(v), v.route_requests)


@register(
    "a5_failing_bridges",
    f"""SELECT {PROFILE}, count(*) AS n_failing, string_agg(CAST(bridge_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 50) AS listed
        FROM (SELECT *, row_number() OVER (PARTITION BY {PROFILE} ORDER BY weight_margin ASC NULLS LAST, bridge_id) AS rn FROM ({_FAILED}) f) r GROUP BY 1, 2, 3""",
)
def _(v: Views):
    listed = G.failing_bridges(_fails(v))
    return listed.select(
        *G.PROFILE, "n_failing", F.array_join(F.transform("bridges", lambda b: b["bridge_id"].cast("string")), ",").alias("listed"),
    )


@register(
    "w4_worst_bridges",
    f"""SELECT * FROM (SELECT {PROFILE}, bridge_id, CAST(row_number() OVER (PARTITION BY {PROFILE} ORDER BY weight_margin ASC NULLS LAST, bridge_id) AS INTEGER) AS rank
        FROM ({_FAILED}) f) r WHERE rank <= 50""",
)
def _(v: Views):
    return G.worst_bridges(_fails(v)).select(*G.PROFILE, "bridge_id", "rank")


@register(
    "w5_worst_per_limit",
    f"""SELECT {PROFILE}, count(*) AS n_failing, arg_min(bridge_id, weight_margin * 1e9 + bridge_id / 1e6) FILTER (WHERE weight_margin < 1) AS worst_weight,
        arg_min(bridge_id, clearance_margin * 1e9 + bridge_id / 1e6) FILTER (WHERE clearance_margin < 0) AS worst_height FROM ({_FAILED}) f GROUP BY 1, 2, 3""",
)
def _(v: Views):
    return G.worst_per_limit(_fails(v)).select(
        *G.PROFILE, "n_failing", F.col("worst_weight.bridge_id").alias("worst_weight"), F.col("worst_height.bridge_id").alias("worst_height")
    )


@register("g1_bridge_verdict", "SELECT request_id, route_id, verdict, n_failing, intersecting_count, min_weight_margin, min_clearance_margin FROM verdicts")
def _(v: Views):
    return G.bridge_verdict(v.route_requests, _hits(v)).drop("veto_reason")


@register("g2_veto_reason", "SELECT request_id, veto_reason FROM verdicts WHERE n_failing > 0")
def _(v: Views):
    judged = G.bridge_verdict(v.route_requests, _hits(v))
    return judged.where("verdict = 'HARD_VETO'").select("request_id", "veto_reason")


@register("g3_risk_veto", "SELECT request_id, score AS risk_score, score >= 0.90 AS vetoed FROM replies")
def _(v: Views):
    scored = G.risk_scores(v.risk_replies)
    return scored.select("request_id", "risk_score", G.risk_veto(F.col("risk_score")).alias("vetoed"))


def decisions(v: Views):
    """The flagship: both gates for every request."""
    return G.route_decisions(v.route_requests, _routes(v), v.bridges, G.risk_scores(v.risk_replies), CORRIDOR_M)


_CLASS = "CASE WHEN score >= 0.7 THEN 'HIGH RISK' WHEN score >= 0.4 THEN 'MODERATE RISK' ELSE 'LOW RISK' END"


@register(
    "g4_route_decisions",
    f"""SELECT request_id, route_id, CASE WHEN blocked OR score >= 0.90 THEN 'HARD_VETO' ELSE 'PASS' END AS verdict,
        CASE WHEN blocked THEN 'bridge' WHEN score >= 0.90 THEN 'risk' END AS vetoed_by,
        CASE WHEN blocked THEN veto_reason WHEN score >= 0.90 THEN 'HARD VETO: extreme route risk (Score: ' || printf('%.2f', score) || '). Reason: ' || reason
          ELSE '' END AS veto_reason, intersecting_count, min_weight_margin, min_clearance_margin,
        CASE WHEN NOT blocked THEN score END AS risk_score, CASE WHEN NOT blocked THEN {_CLASS} END AS risk_class,
        NOT blocked AND score < 0.90 AS needs_narrative FROM decisions""",
)
def _(v: Views):
    return decisions(v)


@register(
    "g5_consensus",
    """SELECT request_id, intersecting_count > 0 AS context_agrees, NOT blocked AND score < 0.90 AS efficiency_agrees, NOT blocked AS compliance_agrees,
       NOT blocked AND score < 0.90 AND intersecting_count > 0 AS dispatched, CASE WHEN blocked THEN 'HARD_VETO'
       WHEN score < 0.90 AND intersecting_count > 0 THEN 'DISPATCH' ELSE 'HOLD' END AS outcome FROM decisions""",
)
def _(v: Views):
    judged = decisions(v).select(
        "request_id", (~F.col("vetoed_by").eqNullSafe("bridge")).alias("compliance_ok"),
        "risk_score", F.col("intersecting_count").alias("evidence_count"),
    )
    return G.consensus(judged)


@register(
    "g6_choose_route",
    """SELECT request_id // 10 AS shipment_id, arg_min(route_id, score * 1e6 + route_id) AS route_id, min(score) AS risk_score,
       count(*) AS n_passing FROM decisions WHERE NOT blocked AND score < 0.90 GROUP BY 1""",
)
def _(v: Views):
    candidates = decisions(v).withColumn("shipment_id", F.floor(F.col("request_id") / 10))
    return G.choose_route(candidates)

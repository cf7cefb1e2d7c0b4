"""The safety gate: one verdict per request (a route and a vehicle), for all requests at once.

``hits`` is one row per (route, bridge in its corridor) with ``route_id, bridge_id,
clearance_mt, load_limit_tons``. ``vehicles`` is one row per request with ``request_id,
route_id, vehicle_weight_tons, vehicle_height_mt``.

Margins need only each route's smallest limits, so requests meet one row per route, not
every bridge. Bridges are met only by the distinct vehicles that some bridge of the
route does stop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from midmile.functions import columns as C
from midmile.operators.ranking import balanced_join, top_per_group
from midmile.operators.spatial import corridor_join
from midmile.runtime import stage

RISK_VETO_FROM = 0.90  # fixed value: a score at or above this stops the trip
NO_REPLY_SCORE, NO_REPLY_REASON = 0.5, "Unknown risk"  # fixed values: a request without a reply

PROFILE = ["route_id", "vehicle_weight_tons", "vehicle_height_mt"]


def bridge_hits(routes: DataFrame, bridges: DataFrame, corridor_m: float = 50.0) -> DataFrame:
    """(route, bridge) pairs with the bridge's limits."""
    found = corridor_join(routes, bridges.select("bridge_id", "latitude", "longitude", "clearance_mt", "load_limit_tons"), corridor_m)
    return found.select("route_id", "bridge_id", "clearance_mt", "load_limit_tons")


def route_limits(hits: DataFrame) -> DataFrame:
    """Smallest limits of each route."""
    return hits.groupBy("route_id").agg(
        F.count("*").alias("intersecting_count"),
        F.min("load_limit_tons").alias("min_limit"),
        F.max("load_limit_tons").alias("max_limit"),
        F.min("clearance_mt").alias("min_clearance"),
    )


def _with_limits(vehicles: DataFrame, hits: DataFrame) -> DataFrame:
    """Vehicles (requests or profiles) with their route's count and margins.

    One row per route meets a possibly hot route; ``balanced_join`` is not needed, as
    the route side is unique and adaptive execution splits the other side.
    """
    weight, height = F.col("vehicle_weight_tons"), F.col("vehicle_height_mt")
    tightest = F.when(weight < 0, F.col("max_limit")).otherwise(F.col("min_limit"))
    return (
        vehicles.join(route_limits(hits), "route_id", "left")
        .withColumn("intersecting_count", F.coalesce("intersecting_count", F.lit(0)))
        .withColumn("min_weight_margin", C.weight_margin(tightest, weight))
        .withColumn("min_clearance_margin", C.clearance_margin(F.col("min_clearance"), height))
    )


def gate_aggregate(hits: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Per request: bridges met and the smallest margins over all of them."""
    return _with_limits(vehicles, hits).select(
        "request_id", "intersecting_count", "min_weight_margin", "min_clearance_margin"
    )


def violations(hits: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each (route, distinct vehicle, bridge) where the bridge is too weak or too low."""
    weight, height = F.col("vehicle_weight_tons"), F.col("vehicle_height_mt")
    profiles = vehicles.select(*PROFILE).distinct()
    stopped = C.violates(F.col("min_limit"), weight, F.col("min_clearance"), height)
    suspects = stage(_with_limits(profiles, hits).where(stopped).select(*PROFILE), "stopped-vehicles")
    met = balanced_join(suspects, hits.select("route_id", "bridge_id", "clearance_mt", "load_limit_tons"), "route_id")
    return (
        met.where(C.violates(F.col("load_limit_tons"), weight, F.col("clearance_mt"), height))
        .withColumn("weight_margin", C.weight_margin(F.col("load_limit_tons"), weight))
        .withColumn("clearance_margin", C.clearance_margin(F.col("clearance_mt"), height))
    )


def worst_bridges(fails: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` bridges with the least weight margin for every route and vehicle."""
    return top_per_group(fails, PROFILE, [F.col("weight_margin").asc_nulls_last(), F.col("bridge_id").asc()], n)


def failing_bridges(fails: DataFrame, cap: int = 50) -> DataFrame:
    """Per route and vehicle: the true number of failing bridges, and the worst ``cap`` as a list."""
    fails = stage(fails, "failing-bridges")
    listed = worst_bridges(fails, cap).groupBy(*PROFILE).agg(
        F.sort_array(F.collect_list(F.struct("rank", "bridge_id", "weight_margin", "clearance_margin"))).alias("bridges")
    )
    counts = fails.groupBy(*PROFILE).agg(F.count("*").alias("n_failing"))
    return _join_profiles(counts, listed)


def worst_per_limit(fails: DataFrame) -> DataFrame:
    """Per route and vehicle: number of failing bridges, the worst for weight and for height."""
    def worst(margin: str, limit: str, bad: Column) -> Column:
        found = F.struct(F.col("bridge_id").alias("bridge_id"), F.col(limit).alias("limit"))
        return F.min_by(F.when(bad, found), F.when(bad, F.struct(margin, "bridge_id")))

    weight_bad = F.coalesce(F.col("load_limit_tons") < F.col("vehicle_weight_tons"), F.lit(False)) & F.col("weight_margin").isNotNull()
    height_bad = F.coalesce(F.col("clearance_margin") < 0, F.lit(False))
    return fails.groupBy(*PROFILE).agg(
        F.count("*").alias("n_failing"),
        worst("weight_margin", "load_limit_tons", weight_bad).alias("worst_weight"),
        worst("clearance_margin", "clearance_mt", height_bad).alias("worst_height"),
    )


def _join_profiles(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on route and vehicle, where an unknown weight or height equals itself."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in PROFILE})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PROFILE]
    cond = same[0] & same[1] & same[2]
    return left.join(renamed, cond, how).drop(*[f"_{c}" for c in PROFILE])


def veto_reason() -> Column:
    """Sentence over the columns of ``worst_per_limit`` joined to a request."""
    weight, height = F.col("worst_weight"), F.col("worst_height")
    too_heavy = F.when(
        weight.isNotNull(),
        F.format_string(
            "weight limit exceeded on bridge %s (limit %.1f t < vehicle %.1f t)",
            weight["bridge_id"].cast("string"), weight["limit"], F.col("vehicle_weight_tons"),
        ),
    )
    too_tall = F.when(
        height.isNotNull(),
        F.format_string(
            "height clearance insufficient on bridge %s (clearance %.2f m < vehicle %.2f m)",
            height["bridge_id"].cast("string"), height["limit"], F.col("vehicle_height_mt"),
        ),
    )
    return F.format_string(
        "HARD VETO — route blocked: %s. (%d non-compliant bridge(s) of %d intersecting the route.)",
        F.concat_ws("; ", too_heavy, too_tall), F.col("n_failing"), F.col("intersecting_count"),
    )


def bridge_verdict(vehicles: DataFrame, hits: DataFrame) -> DataFrame:
    """Per request: HARD_VETO when a bridge fails, else PASS; margins, counts and the reason."""
    worst = worst_per_limit(violations(hits, vehicles))
    judged = _join_profiles(_with_limits(vehicles, hits), worst, "left")
    vetoed = F.coalesce("n_failing", F.lit(0)) > 0
    return judged.select(
        "request_id",
        "route_id",
        F.when(vetoed, "HARD_VETO").otherwise("PASS").alias("verdict"),
        F.when(vetoed, veto_reason()).otherwise("").alias("veto_reason"),
        F.coalesce("n_failing", F.lit(0)).alias("n_failing"),
        "intersecting_count",
        "min_weight_margin",
        "min_clearance_margin",
    )


def risk_scores(replies: DataFrame) -> DataFrame:
    """Parsed replies: ``request_id, risk_score, risk_reason, risk_class``."""
    parsed = C.parse_risk(F.col("reply"))
    return replies.select(
        "request_id",
        parsed["score"].alias("risk_score"),
        parsed["reason"].alias("risk_reason"),
        C.risk_class(parsed["score"]).alias("risk_class"),
    )


def risk_veto(score: Column, limit: float = RISK_VETO_FROM) -> Column:
    return score >= limit


def route_decisions(
    requests: DataFrame, routes: DataFrame, bridges: DataFrame, risk: DataFrame, corridor_m: float = 50.0
) -> DataFrame:
    """Both gates in order; the first veto decides and the risk gate is not read after it.

    ``risk`` comes from ``risk_scores``. The (route, bridge) pairs are staged, since the
    limits of a route and its failing bridges both need them.
    """
    hits = stage(bridge_hits(routes, bridges, corridor_m), "bridge-hits")
    first = bridge_verdict(requests, hits)
    both = first.join(risk, "request_id", "left")
    stopped = F.col("verdict") == "HARD_VETO"
    score = F.when(~stopped, F.coalesce("risk_score", F.lit(NO_REPLY_SCORE)))
    reason = F.coalesce("risk_reason", F.lit(NO_REPLY_REASON))
    risky = risk_veto(score)
    return both.select(
        "request_id",
        "route_id",
        F.when(stopped | risky, "HARD_VETO").otherwise("PASS").alias("verdict"),
        F.when(stopped, "bridge").when(risky, "risk").alias("vetoed_by"),
        F.when(stopped, F.col("veto_reason"))
        .when(risky, F.format_string("HARD VETO: extreme route risk (Score: %.2f). Reason: %s", score, reason))
        .otherwise("")
        .alias("veto_reason"),
        "intersecting_count",
        "min_weight_margin",
        "min_clearance_margin",
        score.alias("risk_score"),
        F.when(~stopped, C.risk_class(score)).alias("risk_class"),
        (~stopped & ~risky).alias("needs_narrative"),
    )


def consensus(decisions: DataFrame, risk_limit: float = RISK_VETO_FROM) -> DataFrame:
    """Dispatch only when context, efficiency and compliance all agree.

    ``decisions`` has ``request_id, compliance_ok, risk_score, evidence_count``. Context
    agrees when evidence was found, efficiency below the risk limit; an unknown counts
    as no. Compliance alone is a veto that the others cannot lift.
    """
    context = F.coalesce(F.col("evidence_count") > 0, F.lit(False))
    efficiency = F.coalesce(F.col("risk_score") < risk_limit, F.lit(False))
    compliance = F.coalesce("compliance_ok", F.lit(False))
    return decisions.select(
        "request_id",
        context.alias("context_agrees"),
        efficiency.alias("efficiency_agrees"),
        compliance.alias("compliance_agrees"),
        (context & efficiency & compliance).alias("dispatched"),
        F.when(~compliance, "HARD_VETO").when(context & efficiency, "DISPATCH").otherwise("HOLD").alias("outcome"),
    )


def choose_route(decisions: DataFrame, by: Sequence[str] = ("shipment_id",)) -> DataFrame:
    """Per shipment the passing candidate with the least risk, ties to the smaller route id."""
    passing = decisions.where(F.col("verdict") == "PASS")
    pick = F.min(F.struct(F.col("risk_score"), F.col("route_id"))).alias("pick")
    return passing.groupBy(*by).agg(pick, F.count("*").alias("n_passing")).select(
        *by, F.col("pick.route_id").alias("route_id"), F.col("pick.risk_score").alias("risk_score"), "n_passing"
    )

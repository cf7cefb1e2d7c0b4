import math
import random

import pytest
from pyspark.sql import functions as F

from midmile.functions import geo
from midmile.operators import gate as G
from midmile.operators import spatial
from midmile.operators.ranking import balanced_join

R = geo.EARTH_M
HIT = "route_id int, bridge_id int, clearance_mt double, load_limit_tons double"
VEHICLE = "request_id int, route_id int, vehicle_weight_tons double, vehicle_height_mt double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def vec(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return (math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a))


def away(p, a, b, steps=4000):
    """Distance by walking along the great circle in small steps."""
    p, a, b = vec(*p), vec(*a), vec(*b)
    theta = 2 * math.asin(min(1, math.dist(a, b) / 2))
    best = math.inf
    for i in range(steps + 1):
        t = i / steps
        if theta < 1e-12:
            q = a
        else:
            u, v = math.sin((1 - t) * theta) / math.sin(theta), math.sin(t * theta) / math.sin(theta)
            q = tuple(u * x + v * y for x, y in zip(a, b))
        best = min(best, 2 * R * math.asin(min(1, math.dist(p, q) / 2)))
    return best


ROUTES = {
    1: [(40.0, -100.0), (40.5, -99.0), (41.0, -99.5)],
    2: [(10.0, 179.7), (10.2, -179.6)],  # across the date line
    3: [(89.5, 10.0), (89.6, -170.0)],  # over the pole
    4: [(35.0, -90.0)],  # a single point
    5: [(35.0, -90.0), (35.0, -90.0)],  # both ends the same
    6: [(0.0, 0.0), (0.0, 3.0)],  # along the equator
    7: [(60.0, 5.0), (60.0, 9.0)],  # bends north of its parallel
}


def points():
    random.seed(3)
    out = []
    for ends in ROUTES.values():
        for _ in range(60):
            lat, lon = random.choice(ends)
            lat2, lon2 = random.choice(ends)
            t = random.random()
            d = (lon2 - lon + 540) % 360 - 180
            out.append((min(90.0, lat + t * (lat2 - lat) + random.gauss(0, 0.15)), (lon + t * d + random.gauss(0, 0.2) + 540) % 360 - 180))
    return out


@pytest.mark.parametrize("corridor, piece", [(3000.0, 2000.0), (20000.0, 7000.0)])
def test_corridor_join_equals_all_pairs(spark, corridor, piece):
    places = points()
    routes = spark.createDataFrame(
        [(k, [{"lat": a, "lon": b} for a, b in v]) for k, v in ROUTES.items()], "route_id int, points array<struct<lat:double,lon:double>>"
    )
    bridges = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(9999, None, 1.0)], "bridge_id int, latitude double, longitude double")
    found = spatial.corridor_join(routes, bridges, corridor, piece_m=piece)
    got = {(r.route_id, r.bridge_id): r.distance_m for r in found.collect()}
    want, edge = set(), set()
    for k, ends in ROUTES.items():
        for i, p in enumerate(places):
            d = min(away(p, a, b) for a, b in (list(zip(ends, ends[1:])) or [(ends[0], ends[0])]))
            (edge if abs(d - corridor) < 60 else want if d < corridor else set()).add((k, i))
    assert set(got) - edge == want and len(want) > 40
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)


def test_point_on_the_line_and_beyond_its_end(spark):
    a, b = geo.unit_vector(F.lit(0.0), F.lit(0.0)), geo.unit_vector(F.lit(0.0), F.lit(1.0))
    d = lambda lat, lon: spark.range(1).select(geo.segment_distance_m(geo.unit_vector(F.lit(lat), F.lit(lon)), a, b).alias("x")).first().x
    degree = math.pi * R / 180
    assert d(0.0, 0.5) < 1e-3
    assert abs(d(0.1, 0.5) - 0.1 * degree) < 0.01
    assert abs(d(0.0, 1.5) - 0.5 * degree) < 0.01
    assert abs(d(0.0, -0.25) - 0.25 * degree) < 0.01


def test_corridor_must_be_positive(spark):
    with pytest.raises(ValueError):
        spatial.corridor_join(spark.range(1), spark.range(1), 0)


def test_reversed_route_meets_the_same_bridges(spark):
    forth = [(1, [{"lat": 40.0, "lon": -100.0}, {"lat": 40.6, "lon": -99.0}])]
    schema = "route_id int, points array<struct<lat:double,lon:double>>"
    bridges = spark.createDataFrame([(i, 40 + 0.03 * i, -100 + 0.05 * i + 0.01 * (i % 3)) for i in range(21)], "bridge_id int, latitude double, longitude double")
    met = lambda rows: {r.bridge_id for r in spatial.corridor_join(spark.createDataFrame(rows, schema), bridges, 900.0).collect()}
    assert met(forth) == met([(1, forth[0][1][::-1])]) != set()


def verdict(spark, hits, vehicles, replies=None):
    h = spark.createDataFrame(hits, HIT)
    v = spark.createDataFrame(vehicles, VEHICLE)
    return {r.request_id: r for r in G.bridge_verdict(v, h).collect()}


def test_hand_made_cases(spark):
    hits = [
        (1, 11, 5.0, 30.0),  # too weak
        (2, 21, 3.8, 50.0),  # too low
        (3, 31, 5.3, 52.0),  # fits
        (5, 51, 4.5, 40.0),  # exactly at the limits
        (6, 61, None, None),  # limits unknown
    ]
    got = verdict(spark, hits, [(r, r, 40.0, 4.5) for r in range(1, 7)] + [(7, 3, 0.0, 4.5), (8, 2, None, 4.0)])
    assert {k: r.verdict for k, r in got.items()} == {
        1: "HARD_VETO", 2: "HARD_VETO", 3: "PASS", 4: "PASS", 5: "PASS", 6: "PASS", 7: "PASS", 8: "HARD_VETO",
    }
    assert got[1].min_weight_margin == 0.75 and "weight" in got[1].veto_reason
    assert round(got[2].min_clearance_margin, 9) == -0.7 and "clearance" in got[2].veto_reason
    assert got[1].veto_reason == (
        "HARD VETO — route blocked: weight limit exceeded on bridge 11 (limit 30.0 t < vehicle 40.0 t). "
        "(1 non-compliant bridge(s) of 1 intersecting the route.)"
    )
    assert (round(got[3].min_weight_margin, 9), round(got[3].min_clearance_margin, 9)) == (1.3, 0.8)
    assert (got[4].intersecting_count, got[4].min_weight_margin, got[4].veto_reason) == (0, None, "")
    assert (got[6].intersecting_count, got[6].min_weight_margin) == (1, None)
    assert got[7].min_weight_margin is None


def test_worst_bridge_and_true_counts_beyond_the_list(spark):
    hits = [(1, i, 3.0 + (i % 7) / 10, 20.0 + i % 13) for i in range(120)]
    h, v = spark.createDataFrame(hits, HIT), spark.createDataFrame([(1, 1, 40.0, 3.5)], VEHICLE)
    fails = G.violations(h, v)
    listed = G.failing_bridges(fails).first()
    assert listed.n_failing == 120 and len(listed.bridges) == 50
    worst = G.worst_per_limit(fails).first()
    assert (worst.worst_weight.bridge_id, worst.worst_weight.limit) == (0, 20.0)
    assert (worst.worst_height.bridge_id, worst.worst_height.limit) == (0, 3.0)


def test_verdicts_equal_a_plain_loop(spark):
    random.seed(4)
    hits = [(random.randrange(8), i, random.choice([None, 3.0 + random.randrange(20) / 10]), random.choice([None, 20.0 + random.randrange(30)])) for i in range(150)]
    vehicles = [(i, random.randrange(10), random.choice([10.0, 25.0, 40.0]), random.choice([2.5, 3.5, 4.5])) for i in range(200)]
    got = verdict(spark, hits, vehicles)
    for request, route, w, h in vehicles:
        mine = [x for x in hits if x[0] == route]
        bad = [x for x in mine if (x[3] is not None and x[3] < w) or (x[2] is not None and x[2] < h)]
        r = got[request]
        assert (r.n_failing, r.intersecting_count) == (len(bad), len(mine))
        assert r.min_weight_margin == min((x[3] / w for x in mine if x[3] is not None), default=None)
        assert r.min_clearance_margin == min((x[2] - h for x in mine if x[2] is not None), default=None)


def test_tighter_limits_and_more_bridges_never_lift_a_veto(spark):
    random.seed(5)
    hits = [(random.randrange(6), i, 3.0 + random.randrange(20) / 10, 20.0 + random.randrange(30)) for i in range(60)]
    vehicles = [(i, random.randrange(6), 20.0 + i % 20, 3.0 + i % 10 / 10) for i in range(60)]
    before = verdict(spark, hits, vehicles)
    tighter = verdict(spark, [(r, b, c - 0.2, t - 3) for r, b, c, t in hits], vehicles)
    more = verdict(spark, hits + [(r, 1000 + r, 3.1, 25.0) for r in range(6)], vehicles)
    for k, r in before.items():
        if r.verdict == "HARD_VETO":
            assert tighter[k].verdict == more[k].verdict == "HARD_VETO"


def test_gates_run_in_order(spark):
    routes = spark.createDataFrame([(1, 40.0, -100.0, 40.2, -99.8), (2, 30.0, -90.0, 30.1, -89.9)], "route_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    bridges = spark.createDataFrame([(5, 40.0, -100.0, 3.0, 20.0)], "bridge_id int, latitude double, longitude double, clearance_mt double, load_limit_tons double")
    requests = spark.createDataFrame([(1, 1, 40.0, 4.5), (2, 2, 40.0, 4.5), (3, 2, 40.0, 4.5), (4, 2, 40.0, 4.5)], VEHICLE)
    risk = G.risk_scores(spark.createDataFrame([(1, "0.99, ice"), (2, "0.90, ice"), (3, "0.89, wind")], "request_id int, reply string"))
    rows = G.route_decisions(requests, spatial.with_route_points(routes), bridges, risk, 100.0)
    got = {r.request_id: r for r in rows.collect()}
    assert (got[1].vetoed_by, got[1].risk_score, got[1].needs_narrative) == ("bridge", None, False)
    assert (got[2].vetoed_by, got[2].verdict) == ("risk", "HARD_VETO") and "0.90" in got[2].veto_reason
    assert (got[3].verdict, got[3].risk_class, got[3].needs_narrative) == ("PASS", "HIGH RISK", True)
    assert (got[4].verdict, got[4].risk_score) == ("PASS", 0.5)


def test_consensus_and_choice(spark):
    d = spark.createDataFrame(
        [(1, True, 0.2, 3), (2, False, 0.2, 3), (3, True, 0.95, 3), (4, True, None, 3), (5, True, 0.2, 0)],
        "request_id int, compliance_ok boolean, risk_score double, evidence_count int",
    )
    assert {r.request_id: r.outcome for r in G.consensus(d).collect()} == {1: "DISPATCH", 2: "HARD_VETO", 3: "HOLD", 4: "HOLD", 5: "HOLD"}
    c = spark.createDataFrame(
        [("s", 3, "PASS", 0.3), ("s", 2, "PASS", 0.3), ("s", 1, "HARD_VETO", 0.0), ("t", 9, "HARD_VETO", 0.1)],
        "shipment_id string, route_id int, verdict string, risk_score double",
    )
    assert [tuple(r) for r in G.choose_route(c).collect()] == [("s", 2, 0.3, 2)]


def test_gate_plans_have_no_cross_join(spark):
    h = spark.createDataFrame([(1, 1, 3.0, 20.0)], HIT)
    v = spark.createDataFrame([(1, 1, 40.0, 3.5)], VEHICLE)
    for df in (G.bridge_verdict(v, h), balanced_join(h, v, "route_id")):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_within_radius_and_meets_route(spark):
    df = spark.createDataFrame([(1, 40.0, -100.0), (2, 40.05, -100.0), (3, 41.0, -100.0)], "bridge_id int, latitude double, longitude double")
    assert [r.bridge_id for r in spatial.within_radius(df, 40.0, -100.0, 6000.0).orderBy("bridge_id").collect()] == [1, 2]
    on = spatial.meets_route(df, [(40.0, -101.0), (40.0, -99.0), (41.0, -99.0)], 700.0)
    assert [r.bridge_id for r in df.where(on).collect()] == [1]

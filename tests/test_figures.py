import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from midmile.operators import analytics as A
from midmile.operators import metrics as M
from midmile.operators import quality as Q
from midmile.operators import silver as S


def test_heatmap_by_city_weights_hours(spark):
    rows = [("s", "c", dt.datetime(2024, 1, 1, h), sev) for h, sev in [(1, 1), (1, 1), (1, 1), (2, 4)]]
    acc = spark.createDataFrame(rows, "state string, city string, start_time timestamp_ntz, severity int")
    heat = A.risk_heatmap(acc)
    assert sorted((r.incident_count, r.avg_severity) for r in heat.collect()) == [(1, 4.0), (3, 1.0)]
    city = A.heatmap_by_city(heat).first()
    assert (city.incident_count, city.avg_severity) == (4, 1.75)


def test_risk_score_range_and_constant(spark):
    heat = spark.createDataFrame([("a", 1, 2.0), ("b", 11, 2.0)], "city string, incident_count int, avg_severity double")
    got = {r.city: r.risk_score for r in A.risk_score(heat, 3.0, 1.0).collect()}
    assert got == {"a": 0.0, "b": 0.75}
    with pytest.raises(ValueError):
        A.risk_score(heat, 0.0, 0.0)


@pytest.mark.parametrize("values", [[5], [1, 2, 3, 4], [7] * 50, [1e12] + list(range(999)), list(range(1000, 0, -1))])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "execution_time_ms double")
    got = {r.q: r.value for r in A.latency_quantiles(df).collect()}
    import math

    ordered = sorted(values)
    assert got == {q: ordered[max(1, math.ceil(q * len(ordered))) - 1] for q in (0.5, 0.9, 0.99)}


def test_approx_quantiles_are_near(spark):
    df = spark.range(10_000).select(F.col("id").alias("execution_time_ms"))
    got = {r.q: r.value for r in A.approx_quantiles(df).collect()}
    assert abs(got[0.5] - 5000) < 50 and abs(got[0.99] - 9900) < 50


def test_scorecard_and_floor(spark):
    trips = spark.createDataFrame(
        [(1, "100", "60", 6.0)] * 5 + [(2, "100", "160", 5.0)] * 9 + [(3, "10", "1", 5.0)] * 2,
        "route_id int, revenue string, cost string, average_mpg double",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("revenue", "cost")})
    card = A.route_scorecard(trips)
    row = card.where("route_id = 1").first()
    assert (row.total_loads, float(row.gross_profit), row.margin_pct) == (5, 200.0, 40.0)
    assert [r.route_id for r in A.profitable(card).collect()] == [1]


def test_mode_statistics_with_one_hot_mode(spark):
    rows = [(i, "hot", i % 5, 2) for i in range(400)] + [(1000 + i, None, 3, 1) for i in range(3)] + [(2000, "lone", 9, 1)]
    df = spark.createDataFrame(rows, "order_id int, shipping_mode string, days_for_shipping_real int, days_for_shipment_scheduled int")
    got = {r.order_id: r for r in S.delay_propensity(df).collect()}
    assert len(got) == 404 and got[0].delay_propensity == 2.0 and got[1001].delay_propensity == 3.0
    z = {r.order_id: r.delay_zscore for r in S.delay_zscore(df).collect()}
    assert z[2000] is None and z[1000] is None and abs(z[0] + z[4]) < 1e-9


def test_enrich_keeps_facts_without_a_match(spark):
    fact = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id int, fk int")
    dim = spark.createDataFrame([(5, "x")], "pk int, name string")
    assert sorted((r.id, r.name) for r in A.enrich_ops(fact, {"fk": (dim, "pk")}).collect()) == [(1, "x"), (2, None), (3, None)]


def statuses(df):
    return {r.column: (r.observed, r.status) for r in df.collect()}


def test_checks(spark):
    df = spark.createDataFrame(
        [(1, 40.0, -100.0, "a"), (1, 99.0, -100.0, " "), (2, None, 5.0, None)], "id int, lat double, lon double, t string"
    )
    assert statuses(Q.check_min_rows({"x": df}, {"x": 4})) == {"*": (3.0, "FAIL")}
    assert statuses(Q.check_null_rate(df, "x", {"lat": 0.34, "id": 0.0})) == {"lat": (1 / 3, "PASS"), "id": (0.0, "PASS")}
    assert statuses(Q.check_range(df, "x", {"lat": (-90, 90)})) == {"lat": (1.0, "FAIL")}
    assert statuses(Q.check_geo_bounds(df, "x", "lat", "lon")) == {"lat": (1.0, "FAIL"), "lon": (1.0, "FAIL")}
    assert statuses(Q.check_unique(df, "x", ["id"])) == {"id": (1.0, "FAIL")}
    assert statuses(Q.check_text(df, "x", "t")) == {"t": (2.0, "FAIL")}
    parent = spark.createDataFrame([(1,)], "pk int")
    assert statuses(Q.check_fk(df, parent, "id", "pk", "x")) == {"id": (1.0, "FAIL")}
    assert statuses(Q.check_fk(df.where("id = 1"), parent, "id", "pk", "x")) == {"id": (0.0, "PASS")}
    empty = df.limit(0)
    assert statuses(Q.check_null_rate(empty, "x", {"lat": 0.0}))["lat"][1] == "PASS"
    times = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-02 00:00:00",)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert statuses(Q.check_no_future(times, "x", "t", "2024-01-01 00:00:00")) == {"t": (1.0, "FAIL")}


def test_reconcile_and_loss(spark):
    src = spark.createDataFrame([("a",)] * 19 + [("b",)], "state string")
    whole = spark.createDataFrame([("a", 19), ("b", 1)], "state string, incident_count int")
    lost = whole.where("state = 'a'")
    extra = whole.unionByName(spark.createDataFrame([("z", 1)], whole.schema))
    observed = lambda agg: Q.check_reconciles(src, agg, ["state"], "t").first().observed
    assert (observed(whole), observed(lost), observed(extra)) == (0.0, 1.0, 1.0)
    r = Q.check_data_loss(src, lost, "t").first()
    assert (r.observed, r.status) == (5.0, "PASS")
    assert Q.check_data_loss(src, lost, "t", max_pct=4.9).first().status == "FAIL"


def test_known_point(spark):
    df = spark.createDataFrame([("gg", 37.8199, -122.4783)], "bridge_id string, latitude double, longitude double")
    want = spark.createDataFrame([("gg", 37.825, -122.4783), ("none", 0.0, 0.0)], "bridge_id string, known_lat double, known_lon double")
    got = {r.column: r.status for r in Q.check_known_points(df, want, 1.0, "b").collect()}
    assert got == {"gg": "PASS", "none": "FAIL"}


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_rouge_equals_slow_lcs(spark):
    random.seed(10)
    texts = [" ".join(random.choices("abcde", k=random.randrange(0, 200))) for _ in range(40)]
    for x, y in zip(texts, texts[::-1]):
        assert M._lcs_length(x.split(), y.split()) == slow_lcs(x.split(), y.split())
    df = spark.createDataFrame([("The cat sat", "the cat ran away"), (None, "x"), ("", "x")], "p string, r string")
    assert [r.rouge_l for r in M.rouge_l(df, "p", "r").collect()] == [2 * 2 / 7, None, 0.0]


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 9), (2, 20, 1)], "query_id int, chunk_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 21), (3, 30)], "query_id int, chunk_id int")
    got = {r.query_id: r for r in M.retrieval_metrics(hits, truth).collect()}
    import math

    assert (got[1].recall_at_k, got[1].reciprocal_rank, got[1].attribution) == (0.5, 0.5, 0.5)
    assert abs(got[1].ndcg_at_k - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert got[2].reciprocal_rank == got[3].recall_at_k == got[3].ndcg_at_k == 0.0


def test_classification_without_positives(spark):
    df = spark.createDataFrame([("c", "PASS", "PASS")], "category string, expected_verdict string, actual_verdict string")
    r = M.classification_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (None, None, None, 1.0)


def test_unknown_verdicts_are_wrong(spark):
    rows = [("c", "PASS", "PASS"), ("c", "PASS", "ERROR"), ("c", "PASS", None), ("c", "HARD_VETO", None)]
    df = spark.createDataFrame(rows, "category string, expected_verdict string, actual_verdict string")
    r = M.classification_metrics(df).first()
    assert (r.tn, r.unknown, r.fn, r.accuracy) == (1, 2, 1, 0.25)
    got = {x.expected_verdict: x for x in M.confusion_matrix(df).collect()}
    assert (got["PASS"]["PASS"], got["PASS"].other, got["PASS"].missing, got["HARD_VETO"].missing) == (1, 1, 1, 1)


def test_fleet_without_a_key_is_refused(spark):
    trips = spark.createDataFrame([("t", "Completed")], "truck_id string, trip_status string")
    with pytest.raises(ValueError, match="truck_make"):
        A.fleet_table(trips)


def test_metamorphic_rules(spark):
    pairs = spark.createDataFrame(
        [("invariance", "PASS", "HARD_VETO"), ("monotonicity", "PASS", "HARD_VETO"), ("monotonicity", "HARD_VETO", "PASS"), ("symmetry", "PASS", "PASS")],
        "type string, base_verdict string, variant_verdict string",
    )
    assert [r.holds for r in M.metamorphic(pairs).collect()] == [False, True, False, True]


def test_paired_t(spark):
    rows = [(i, "a", float(s)) for i, s in enumerate([3, 5, 4])] + [(i, "b", float(s)) for i, s in enumerate([1, 4, 4])] + [(9, "a", 1.0)]
    r = M.compare_strategies(spark.createDataFrame(rows, "scenario_id int, strategy string, score double"), "a", "b").first()
    assert (r.n, r.mean_a, r.mean_b, r.mean_diff) == (3, 4.0, 3.0, 1.0) and abs(r.t_statistic - 3**0.5) < 1e-9
    same = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0)], "scenario_id int, strategy string, score double")
    assert M.compare_strategies(same, "a", "b").first().t_statistic is None


def test_missing_predictions(spark):
    golden = spark.createDataFrame([(1, "PASS"), (2, "PASS")], "id int, expected_verdict string")
    preds = spark.createDataFrame([(1, "PASS"), (7, "PASS")], "id int, actual_verdict string")
    assert [r.id for r in M.missing_predictions(golden, preds).collect()] == [2]
    assert M.match_predictions(golden, preds).first().passed

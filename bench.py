"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the input, BENCH_CPUS the local cores.
Each query is run once to the end on the noop sink after a short warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_risk_heatmap", "a2_heatmap_by_city", "a3_risk_score", "a6_fleet_table", "a8_route_scorecard", "a9_fuel_by_location",
    "a11_safety_kpis", "a15_delay_by_mode", "a18_latency_quantiles", "a19_alert_timeline",
    "p10_weather_alert", "p15_record_sentence", "u1_union_records", "w1_delay_propensity", "w2_delay_zscore",
    "j1_corridor_join", "j3_route_blackspots", "j4_route_weather", "g1_bridge_verdict", "g4_route_decisions", "g6_choose_route",
    "r1_cosine_topk", "r2_l2_topk", "r4_keyword_fallback", "r5_evidence_block", "r9_bm25", "r10_rrf", "r11_token_chunks",
    "r12_graph_edges", "r13_expand", "r14_majority_vote",
    "q3_null_rate", "q6_foreign_key", "q7_unique", "q9_reconciles", "e1_classification", "e2_retrieval_metrics",
    "x1_stream_files", "x3_stream_heatmap",
    "r1_index_open", "r9_index", "r12_adjacency", "r13_expand_best", "j4_nearest_alerts", "a18_sketch_quantiles", "s10_upsert_by_key",
]


def main() -> None:
    from midmile.plans.catalog import QUERIES
    from midmile.runtime import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    for name in ("a1_risk_heatmap", "r1_cosine_topk"):  # starts the JVM's hot paths and the Python workers
        run(name)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

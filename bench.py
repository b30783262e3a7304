"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankloom.plans.registry import full_catalog  # noqa: E402
from rankloom.session import build_session  # noqa: E402

HEADLINE = (
    "serp_relative_all", "comparison_summary", "peer_benchmark", "relevance_guardrail", "score_pages", "score_explanation", "ndcg_at_10",
    "spearman_mean", "metric_breakdown", "top3_regressions", "preference_summary", "preference_pairs", "domain_cap", "stratified_split", "partition_stats",
    "hard_negatives", "final_labels", "seo_rubric_labels", "rubric_report_distribution", "run_diagnostics", "model_usage", "transition_violations",
    "extract_documents", "text_stats", "query_core_features", "commercial_trust", "audit_features", "recommendation_priority",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "rankloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="20g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = full_catalog().queries
    if names == ["all"]:
        names = list(queries)
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        # the noop sink runs the whole plan and keeps nothing on the driver
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()

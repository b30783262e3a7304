"""A sample of the registered queries against their oracles on the smallest tables.

``python tests/oracle_compare.py <folder> [key ...]`` runs any or all of them.
"""

from __future__ import annotations

import oracle_compare
import pytest

from rankloom.plans.registry import full_catalog

FOLDER = "/root/testdata/sf0.001"
CATALOG = full_catalog()
SAMPLE = (
    "competitor_selection", "competitiveness", "serp_relative_all", "relevance_guardrail", "score_rebalance", "ndcg_at_10", "spearman_mean",
    "preference_pairs", "preference_summary", "label_apply", "group_split", "stratified_split", "hard_negatives", "final_labels", "partition_stats",
    "stage_diagnostics", "run_diagnostics", "model_usage", "transition_violations", "extract_documents", "page_links", "text_stats",
    "query_core_features", "technical_seo", "commercial_trust", "semantic_similarity", "low_score_reason", "score_confidence", "early_stop_summary",
    "scan_dataset", "scan_seeds", "scan_labels", "scan_snapshots", "append_new_rows", "rewrite_version", "write_manifest", "stream_ingest", "hard_negative_report",
    "preference_accuracy", "preference_split_check", "prediction_delta", "load_summary", "worker_utilization", "peer_benchmark", "context_quality", "comparison_summary",
    "query_core_dataset", "query_core_report", "enrich_dataset", "enrich_report", "feature_matrix_pages", "ranker_blend", "best_model",
)


@pytest.fixture(scope="session")
def duck():
    return oracle_compare.connect(FOLDER)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_oracle(spark, duck, key):
    assert oracle_compare.compare(spark, duck, key, CATALOG.queries[key], CATALOG.oracles[key], FOLDER) is None


def test_every_oracle_has_a_query():
    assert set(CATALOG.oracles) <= set(CATALOG.queries)

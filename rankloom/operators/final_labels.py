"""Final targets: competitiveness base score under the relevance guardrail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import clip, flag, num, rnd
from rankloom.operators.datasets import HARD_NEGATIVE_CAP
from rankloom.operators.relevance import guardrail, preflight, topic_metrics


def label_final_targets(rows: DataFrame) -> DataFrame:
    """Competitiveness base score under the relevance guardrail, hard negatives capped."""
    u = lambda parts: clip(sum((num(n) * F.lit(w) for n, w in parts), F.lit(0.0)), 0.0, 1.0)
    judged = preflight(topic_metrics(rows))
    depth = u((("semantic_content_richness", 0.40), ("content_depth_semantic_score", 0.35), ("keyword_balance_score", 0.25)))
    commercial = u((("commercial_trust_score", 0.45), ("trust_signals_score", 0.30), ("commercial_signals_score", 0.25)))
    technical = u((("technical_seo_score", 0.42), ("canonical_signal_score", 0.22), ("url_hygiene_score", 0.18), ("technical_metadata_score", 0.18)))
    intent = u((("intent_alignment_score", 0.55), ("commercial_intent_alignment", 0.25), ("informational_intent_alignment", 0.20)))
    prior = clip(F.lit(1.0) - (F.greatest(F.lit(1.0), F.col("rank").cast("double")) - 1.0) / 9.0, 0.0, 1.0)
    base = (
        F.col("tm_relevance_score") * F.lit(38.0) + depth * F.lit(20.0) + commercial * F.lit(15.0) + technical * F.lit(12.0)
        + intent * F.lit(10.0) + prior * F.lit(5.0)
    )
    scored = judged.withColumn("competitiveness_base_score", rnd(clip(base, 0.0, 100.0), 4))
    guarded = guardrail(scored, "competitiveness_base_score")
    capped = (F.col("hard_negative") == 1) & (F.col("adjusted_score") > HARD_NEGATIVE_CAP)
    return guarded.withColumn("hard_negative_cap_applied", flag(capped)).select(
        "*", F.when(capped, F.lit(HARD_NEGATIVE_CAP)).otherwise(F.col("adjusted_score")).alias("final_target_score"),
        F.when(capped, "hard_negative_cap").otherwise(F.coalesce("band", F.lit("strong_match"))).alias("query_relevance_band"),
        F.when(capped, "cross_category_hard_negative_cap").otherwise(F.coalesce("band_reason", F.lit("strong_query_topic_fit"))).alias("query_relevance_reason"),
    )

"""Query relevance, guardrail bands, rule score, rebalance and explanation of page scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import clip, flag, num, present_mean, rnd

# --- fixed values -----------------------------------------------------------
ROSBERTA_CODE = 2
SEMANTIC_WEIGHTS = {"default": 0.22, "rosberta": 0.26}
FULL_MISMATCH_SEMANTIC_MAX = {"default": 0.22, "rosberta": 0.18}
PROBABLE_MISMATCH_SEMANTIC_MAX = {"default": 0.38, "rosberta": 0.30}
WEAK_MATCH_SEMANTIC_MAX = {"default": 0.45, "rosberta": 0.40}
RULE_REFERENCE_MAX = 150.0
REBALANCE_MAX_UPLIFT = 8.0
REBALANCE_STRONG_WEIGHT = 0.40
REBALANCE_SOFT_WEIGHT = 0.25
REBALANCE_RELEVANCE_MIN = 0.80
REBALANCE_CORE_MIN = 0.90
# band, reason, lower bound, upper bound, multiplier
BANDS = (
    ("unusable", "page_unusable", 0.0, 10.0, 0.10),
    ("full_mismatch", "confident_full_query_mismatch", 0.0, 5.0, 0.05),
    ("core_mismatch", "commercial_modifier_only_core_mismatch", 0.0, 8.0, 0.15),
    ("probable_mismatch", "local_service_core_mismatch", 6.0, 25.0, 0.25),
    ("probable_mismatch", "probable_query_topic_mismatch", 6.0, 25.0, 0.25),
    ("weak_match", "weak_query_topic_match", 25.0, 55.0, 0.55),
    ("partial_match", "partial_query_topic_match", 55.0, 80.0, 0.80),
)
FACTOR_MAX_IMPACTS = {
    "content_depth": 4.0, "semantic_relevance": 20.0, "keyword_coverage": 10.0, "title_signal": 8.0, "meta_signal": 5.0,
    "heading_structure": 6.0, "title_semantic_alignment": 6.0, "heading_semantic_alignment": 5.0,
    "content_depth_semantic_score": 8.0, "semantic_content_richness": 8.0, "keyword_balance": 7.0, "conversion_signal": 4.0,
    "query_prominence": 8.0, "text_to_html_ratio": 4.0, "uniqueness": 5.0, "technical_indexability": 6.0,
    "technical_canonical": 4.0, "technical_redirects": 4.0, "technical_url_hygiene": 3.0, "technical_metadata": 2.0,
    "commercial_completeness": 6.5, "trust_signals": 5.85, "contact_accessibility": 3.6, "intent_alignment": 5.0,
    "local_intent_fit": 3.6, "commercial_intent_fit": 3.15, "informational_intent_fit": 2.7,
}
SEMANTIC_LIMITING_KEYS = ("semantic_relevance", "content_depth_semantic_score", "semantic_content_richness")
LITERAL_ALIGNMENT_KEYS = ("title_semantic_alignment", "heading_semantic_alignment")
SUPPORT_KEYS = ("query_topic_fit", "trust_signals", "contact_accessibility")
FACTOR_GROUPS = {
    "query_relevance": (
        "query_topic_fit", "query_relevance_guardrail", "semantic_relevance", "keyword_coverage", "query_prominence",
        "intent_alignment", "commercial_intent_fit", "informational_intent_fit", "local_intent_fit",
    ),
    "content_depth": (
        "content_depth", "content_depth_semantic_score", "semantic_content_richness", "heading_structure", "title_signal",
        "title_semantic_alignment", "heading_semantic_alignment", "keyword_balance", "meta_signal",
    ),
    "commercial_trust": (
        "commercial_completeness", "commercial_signals", "trust_signals", "contact_accessibility", "conversion_signal",
    ),
    "technical_access": (
        "technical_indexability", "technical_canonical", "technical_redirects", "technical_url_hygiene",
        "technical_metadata", "text_to_html_ratio",
    ),
}
# --- end of fixed values ----------------------------------------------------

_INPUTS = (
    "semantic_provider_code", "semantic_similarity", "keyword_coverage_ratio", "query_core_keyword_coverage_ratio",
    "query_intent_modifier_coverage_ratio", "query_density", "word_count", "query_core_term_count", "query_in_title",
    "query_in_text", "exact_query_count", "title_semantic_alignment", "heading_semantic_alignment", "query_prominence_score",
    "query_geo_modifier_coverage_ratio", "query_primary_core_term_present", "query_primary_core_term_in_title",
    "query_primary_core_term_in_headings", "modifier_or_geo_only_match", "core_missing_but_geo_present",
    "semantic_fallback_used", "semantic_embedding_failure", "http_status_code", "http_status_ok", "page_indexable",
    "robots_noindex", "text_length_chars",
)


def with_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the absent feature columns as null, which is how "not measured" is written here."""
    absent = {name: F.lit(None).cast("double") for name in names if name not in df.columns}
    return df.withColumns(absent) if absent else df


def _calibrated(values: dict[str, float]) -> Column:
    return F.when(num("semantic_provider_code") == ROSBERTA_CODE, F.lit(values["rosberta"])).otherwise(F.lit(values["default"]))


def topic_metrics(features: DataFrame) -> DataFrame:
    """Adds the relevance metrics of a (query, page) row, prefixed ``tm_``."""
    unit = lambda name: clip(num(name), 0.0, 1.0)
    positive = lambda name: F.greatest(F.lit(0.0), num(name))
    rows = with_missing(features, _INPUTS)
    core = F.when(F.col("query_core_keyword_coverage_ratio").isNotNull(), unit("query_core_keyword_coverage_ratio")).otherwise(
        unit("keyword_coverage_ratio")
    )
    words = positive("word_count")
    core_density = F.when(
        (words > 0) & F.col("query_core_term_count").isNotNull(), positive("query_core_term_count") / words
    ).otherwise(positive("query_density"))
    signals = rows.select(
        "*",
        core.alias("_core"),
        core_density.alias("_core_density"),
        F.greatest(unit("query_in_title"), unit("title_semantic_alignment"), unit("heading_semantic_alignment")).alias("_title_heading"),
        F.greatest(
            unit("exact_query_count"), unit("query_in_title"), unit("query_in_text"),
            unit("title_semantic_alignment"), unit("heading_semantic_alignment"),
        ).alias("_structural"),
    )
    core_density_signal = clip(F.col("_core_density") / F.lit(0.008), 0.0, 1.0)
    relevance = clip(
        F.col("_core") * F.lit(0.38)
        + unit("semantic_similarity") * _calibrated(SEMANTIC_WEIGHTS)
        + unit("keyword_coverage_ratio") * F.lit(0.10)
        + core_density_signal * F.lit(0.15)
        + F.greatest(F.col("_structural"), unit("query_prominence_score")) * F.lit(0.15),
        0.0, 1.0,
    )
    metrics = {
        "relevance_score": rnd(relevance, 4),
        "semantic_similarity": rnd(unit("semantic_similarity"), 4),
        "semantic_provider_code": rnd(num("semantic_provider_code"), 4),
        "semantic_fallback_used": rnd(num("semantic_fallback_used"), 4),
        "semantic_embedding_failure": rnd(num("semantic_embedding_failure"), 4),
        "keyword_coverage_ratio": rnd(unit("keyword_coverage_ratio"), 4),
        "query_core_keyword_coverage_ratio": rnd(F.col("_core"), 4),
        "query_intent_modifier_coverage_ratio": rnd(unit("query_intent_modifier_coverage_ratio"), 4),
        "query_density": rnd(positive("query_density"), 6),
        "query_core_density": rnd(F.col("_core_density"), 6),
        "exact_query_count": rnd(positive("exact_query_count"), 4),
        "query_in_title": rnd(unit("query_in_title"), 4),
        "query_in_text": rnd(unit("query_in_text"), 4),
        "title_semantic_alignment": rnd(unit("title_semantic_alignment"), 4),
        "heading_semantic_alignment": rnd(unit("heading_semantic_alignment"), 4),
        "title_heading_signal": rnd(F.col("_title_heading"), 4),
        "density_signal": rnd(clip(positive("query_density") / F.lit(0.01), 0.0, 1.0), 4),
        "core_density_signal": rnd(core_density_signal, 4),
        "exact_or_structural_signal": rnd(F.col("_structural"), 4),
        "query_geo_modifier_coverage_ratio": rnd(unit("query_geo_modifier_coverage_ratio"), 4),
        "query_primary_core_term_present": rnd(unit("query_primary_core_term_present"), 4),
        "query_primary_core_term_in_title_heading": rnd(
            F.greatest(unit("query_primary_core_term_in_title"), unit("query_primary_core_term_in_headings")), 4
        ),
        "query_core_semantic_alignment": rnd(unit("semantic_similarity") * F.col("_core"), 4),
        "core_missing_but_geo_present": rnd(unit("core_missing_but_geo_present"), 4),
        "modifier_or_geo_only_match": rnd(unit("modifier_or_geo_only_match"), 4),
        "query_prominence_score": rnd(unit("query_prominence_score"), 4),
    }
    return signals.select("*", *[column.alias(f"tm_{name}") for name, column in metrics.items()]).drop(
        "_core", "_core_density", "_title_heading", "_structural"
    )


def _tm(name: str) -> Column:
    return F.col(f"tm_{name}")


def strong_topic_fit() -> Column:
    return (
        (_tm("relevance_score") >= 0.58)
        & (_tm("query_core_keyword_coverage_ratio") >= 0.75)
        & (
            (_tm("core_density_signal") >= 0.5)
            | (_tm("query_prominence_score") >= 0.45)
            | (_tm("exact_or_structural_signal") >= 0.65)
        )
    )


def high_confidence_fit() -> Column:
    return (
        strong_topic_fit()
        & (_tm("relevance_score") >= REBALANCE_RELEVANCE_MIN)
        & (_tm("query_core_keyword_coverage_ratio") >= REBALANCE_CORE_MIN)
    )


def unusable_reasons() -> Column:
    """Array of reasons why the page cannot be judged; empty for a usable page. Absent features raise none."""
    listed = F.array(
        F.when((num("http_status_code") >= 100) & (num("http_status_ok") < 0.5), F.lit("http_status_not_ok")),
        F.when(F.col("page_indexable") < 0.5, F.lit("page_not_indexable")),
        F.when(F.col("robots_noindex") > 0.5, F.lit("robots_noindex")),
        F.when((F.col("word_count") < 20) & (F.col("text_length_chars") < 200), F.lit("empty_or_too_thin_content")),
    )
    return F.array_compact(listed)


def content_evaluable() -> Column:
    status_bad = F.coalesce(F.col("http_status_ok") < 0.5, F.lit(False))
    return ~status_bad & ((num("word_count") >= 80) | (num("text_length_chars") >= 500))


def preflight(metrics: DataFrame) -> DataFrame:
    """Adds fit flags and the early-stop decision to rows that carry topic metrics."""
    judged = metrics.select(
        "*",
        strong_topic_fit().alias("strong_fit"),
        high_confidence_fit().alias("high_confidence"),
        content_evaluable().alias("content_evaluable"),
        unusable_reasons().alias("unusable_reasons"),
    )
    stop = (
        F.col("content_evaluable")
        & (F.size("unusable_reasons") == 0)
        & ~F.col("strong_fit")
        & (_tm("relevance_score") <= 0.15)
        & (_tm("semantic_similarity") <= _calibrated(FULL_MISMATCH_SEMANTIC_MAX))
        & (_tm("query_core_keyword_coverage_ratio") <= 0.05)
        & (_tm("query_core_density") <= 0.0008)
        & (_tm("exact_query_count") <= 0)
        & (_tm("title_heading_signal") <= 0.05)
        & (_tm("query_prominence_score") <= 0.08)
    )
    return judged.withColumn("should_stop", stop).select(
        "*",
        F.when(F.col("should_stop"), "confident_full_query_mismatch").otherwise("not_confident_enough_for_early_stop").alias("preflight_reason"),
        F.when(F.col("should_stop"), "high").when(F.col("content_evaluable"), "low").otherwise("insufficient_content").alias("preflight_confidence"),
        F.when(F.col("should_stop"), F.lit(5.0)).alias("score_ceiling"),
    )


def guardrail(judged: DataFrame, score: str) -> DataFrame:
    """Applies the first matching relevance band to ``score`` of rows that went through ``preflight``."""
    structural, prominence = _tm("exact_or_structural_signal"), _tm("query_prominence_score")
    core, density, relevance = _tm("query_core_keyword_coverage_ratio"), _tm("query_core_density"), _tm("relevance_score")
    local_mismatch = (
        (_tm("modifier_or_geo_only_match") >= 1)
        & (_tm("core_missing_but_geo_present") >= 1)
        & (_tm("query_primary_core_term_present") < 0.5)
        & (_tm("query_primary_core_term_in_title_heading") < 0.5)
        & (core < 0.75)
        & (structural < 0.45)
        & ((_tm("semantic_similarity") < 0.62) | (_tm("query_core_semantic_alignment") < 0.35))
    )
    conditions = (
        F.size("unusable_reasons") > 0,
        F.col("should_stop"),
        ~F.col("strong_fit") & (core <= 0.05) & (_tm("keyword_coverage_ratio") <= 0.40)
        & (_tm("query_intent_modifier_coverage_ratio") >= 0.75) & (density < 0.0008) & (structural < 0.25) & (prominence < 0.35),
        ~F.col("strong_fit") & F.col("content_evaluable") & local_mismatch,
        ~F.col("strong_fit") & (relevance < 0.35) & (core < 0.34)
        & (_tm("semantic_similarity") < _calibrated(PROBABLE_MISMATCH_SEMANTIC_MAX)) & (density < 0.002),
        ~F.col("strong_fit") & (relevance < 0.48) & (core < 0.5)
        & (_tm("semantic_similarity") < _calibrated(WEAK_MATCH_SEMANTIC_MAX)) & (density < 0.004),
        ~F.col("strong_fit") & (relevance < 0.58) & (core < 0.75) & (structural < 0.35) & (prominence < 0.35),
    )
    none = F.lit(None).cast("int")
    step = reduce(lambda rest, i: F.when(conditions[i], F.lit(i)).otherwise(rest), range(len(BANDS) - 1, -1, -1), none)
    pick = lambda field: reduce(lambda rest, i: F.when(F.col("_band") == i, F.lit(BANDS[i][field])).otherwise(rest), range(len(BANDS)), F.lit(None))
    banded = judged.withColumn("_band", step).select(
        "*", pick(0).alias("band"), pick(1).alias("band_reason"), pick(2).cast("double").alias("band_min"),
        pick(3).cast("double").alias("band_max"), F.coalesce(pick(4).cast("double"), F.lit(1.0)).alias("relevance_multiplier"),
    )
    adjusted = rnd(
        clip(F.least(rnd(clip(F.col(score) * F.col("relevance_multiplier"), 0.0, 100.0), 4), F.coalesce("band_max", F.lit(100.0))), 0.0, 100.0), 4
    )
    return banded.drop("_band").withColumn("adjusted_score", adjusted).select(
        "*",
        (F.col("adjusted_score") < F.col(score)).alias("guardrail_active"),
        rnd(F.col("adjusted_score") - F.col(score), 4).alias("guardrail_delta"),
    )


_RULE_INPUTS = (
    "word_count", "title_present", "title_length_quality", "meta_description_present", "meta_length_quality", "heading_count",
    "semantic_similarity", "keyword_coverage_ratio", "title_semantic_alignment", "heading_semantic_alignment",
    "content_depth_semantic_score", "semantic_content_richness", "keyword_balance_score", "conversion_signal_score",
    "query_prominence_score", "text_to_html_ratio", "unique_word_ratio", "page_indexable", "canonical_present",
    "canonical_matches_final_url", "redirect_efficiency_score", "redirect_count", "url_hygiene_score",
    "technical_metadata_score", "commercial_signals_score", "phone_present", "address_present", "business_hours_present",
    "cta_present", "value_proposition_present", "trust_signals_score", "contact_options_score", "intent_alignment_score",
    "intent_is_local_commercial", "local_intent_alignment", "intent_is_commercial", "commercial_intent_alignment",
    "intent_is_informational", "informational_intent_alignment",
)


def _factor(key: str, impact: Column, value: Column, condition: Column | None = None) -> tuple[str, Column, Column]:
    """Key, impact (null where the factor does not apply) and value."""
    rounded = rnd(impact.cast("double"), 4)
    return key, rounded if condition is None else F.when(condition, rounded), rnd(value.cast("double"), 4)


def rule_factors(features: DataFrame) -> DataFrame:
    """Adds ``factors`` (key, impact, value), an ``impact_`` column for each and the 0-100 ``rule_score``."""
    rows = with_missing(features, _RULE_INPUTS)
    has = lambda name: F.col(name).isNotNull()
    capped = lambda name, full: F.least(num(name) / F.lit(full), F.lit(1.0))
    scaled = lambda key, name, weight: _factor(key, num(name) * F.lit(weight), num(name))
    centred = lambda key, name, middle, weight, condition: _factor(
        key, (num(name) - F.lit(middle)) * F.lit(weight), num(name), condition & has(name)
    )
    always = F.lit(True)
    page_level = [f"_u_{name}" for name in ("phone_present", "address_present", "business_hours_present", "cta_present", "value_proposition_present")]
    rows = rows.select("*", *[clip(F.col(name[3:]).cast("double"), 0.0, 1.0).alias(name) for name in page_level])
    rows = rows.select("*", present_mean(page_level).alias("_page_level"))
    offer = F.greatest(num("commercial_signals_score"), F.coalesce("_page_level", num("commercial_signals_score")))
    canonical = F.when(
        num("canonical_present") >= 1, F.when(num("canonical_matches_final_url") >= 1, F.lit(4.0)).otherwise(F.lit(-6.0))
    ).otherwise(F.lit(0.0))
    canonical_value = F.when(num("canonical_present") >= 1, num("canonical_matches_final_url")).otherwise(num("canonical_present"))
    listed = [
        _factor("content_depth", capped("word_count", 700.0) * F.lit(4.0), num("word_count")),
        scaled("semantic_relevance", "semantic_similarity", 20.0),
        scaled("keyword_coverage", "keyword_coverage_ratio", 10.0),
        _factor("title_signal", (num("title_present") * F.lit(0.5) + num("title_length_quality") * F.lit(0.5)) * F.lit(8.0), num("title_length_quality")),
        _factor("meta_signal", (num("meta_description_present") * F.lit(0.5) + num("meta_length_quality") * F.lit(0.5)) * F.lit(5.0), num("meta_length_quality")),
        _factor("heading_structure", capped("heading_count", 6.0) * F.lit(6.0), num("heading_count")),
        scaled("title_semantic_alignment", "title_semantic_alignment", 6.0),
        scaled("heading_semantic_alignment", "heading_semantic_alignment", 5.0),
        scaled("content_depth_semantic_score", "content_depth_semantic_score", 8.0),
        scaled("semantic_content_richness", "semantic_content_richness", 8.0),
        scaled("keyword_balance", "keyword_balance_score", 7.0),
        scaled("conversion_signal", "conversion_signal_score", 4.0),
        scaled("query_prominence", "query_prominence_score", 8.0),
        _factor("text_to_html_ratio", capped("text_to_html_ratio", 0.25) * F.lit(4.0), num("text_to_html_ratio")),
        scaled("uniqueness", "unique_word_ratio", 5.0),
        _factor("technical_indexability", F.when(num("page_indexable") >= 1, F.lit(6.0)).otherwise(F.lit(-12.0)), num("page_indexable"), has("page_indexable")),
        _factor("technical_canonical", canonical, canonical_value, has("canonical_present") | has("canonical_matches_final_url")),
        _factor(
            "technical_redirects", num("redirect_efficiency_score") * F.lit(4.0) - F.least(num("redirect_count"), F.lit(3.0)),
            num("redirect_efficiency_score"), has("redirect_efficiency_score") | has("redirect_count"),
        ),
        centred("technical_url_hygiene", "url_hygiene_score", 0.5, 6.0, always),
        centred("technical_metadata", "technical_metadata_score", 0.5, 4.0, always),
        _factor("commercial_completeness", (offer - F.lit(0.35)) * F.lit(10.0), offer, has("commercial_signals_score")),
        centred("trust_signals", "trust_signals_score", 0.35, 9.0, always),
        centred("contact_accessibility", "contact_options_score", 0.4, 6.0, always),
        centred("intent_alignment", "intent_alignment_score", 0.5, 10.0, always),
        centred("local_intent_fit", "local_intent_alignment", 0.55, 8.0, num("intent_is_local_commercial") >= 1),
        centred("commercial_intent_fit", "commercial_intent_alignment", 0.55, 7.0, num("intent_is_commercial") >= 1),
        centred("informational_intent_fit", "informational_intent_alignment", 0.55, 6.0, num("intent_is_informational") >= 1),
    ]
    if [key for key, _, _ in listed] != list(FACTOR_MAX_IMPACTS):
        raise ValueError("FACTOR_MAX_IMPACTS must list the factors in their order")
    rows = rows.select("*", *[impact.alias(f"impact_{key}") for key, impact, _ in listed])
    impact_of = lambda key: F.col(f"impact_{key}")
    built = [F.when(impact_of(key).isNotNull(), F.struct(F.lit(key).alias("key"), impact_of(key).alias("impact"), value.alias("value"))) for key, _, value in listed]
    total = reduce(lambda sum_, f: sum_ + F.coalesce(F.rint(impact_of(f[0]) * 1e4), F.lit(0.0)), listed, F.lit(0.0)) / F.lit(1e4)
    return (
        rows.withColumn("factors", F.array_compact(F.array(*built)))
        .withColumn("rule_score", rnd(clip(total / F.lit(RULE_REFERENCE_MAX) * F.lit(100.0), 0.0, 100.0), 4))
        .drop("_page_level", *page_level)
    )


def rebalance(judged: DataFrame, ml_score: str, rule_score: str = "rule_score") -> DataFrame:
    """Blends the rule score into a lower model score where the topic fit is strong, by at most 8 points."""
    ml, rule = F.col(ml_score), F.col(rule_score)
    weight = F.when(F.col("high_confidence"), F.lit(REBALANCE_STRONG_WEIGHT)).otherwise(F.lit(REBALANCE_SOFT_WEIGHT))
    blended = rnd(clip(rule * weight + ml * (F.lit(1.0) - weight), 0.0, 100.0), 4)
    raised = rnd(clip(F.least(ml + F.lit(REBALANCE_MAX_UPLIFT), blended), 0.0, 100.0), 4)
    offered = judged.withColumn("_raised", raised).withColumn("_uplift", rnd(F.col("_raised") - ml, 4))
    reason = (
        F.when(rule <= ml, "rule_score_not_higher")
        .when(~F.col("strong_fit"), "weak_or_partial_query_fit")
        .when(F.col("_uplift") <= 0, "uplift_not_positive")
        .when(F.col("high_confidence"), "high_confidence_query_fit")
        .otherwise("strong_query_fit")
    )
    active = F.col("rebalance_reason").isin("high_confidence_query_fit", "strong_query_fit")
    return (
        offered.withColumn("rebalance_reason", reason)
        .withColumn("rule_weight", F.when(active, weight).otherwise(F.lit(0.0)))
        .withColumn("uplift", F.when(active, F.col("_uplift")).otherwise(F.lit(0.0)))
        .withColumn("raw_score", F.when(active, F.col("_raised")).otherwise(rnd(ml, 4)))
        .drop("_raised", "_uplift")
    )


def score_pages(features: DataFrame, ml_score: str) -> DataFrame:
    """Model score in, final score out: rule factors, rebalance and relevance band in one pass over the rows."""
    ml = rnd(clip(F.col(ml_score), 0.0, 100.0), 4)
    judged = preflight(topic_metrics(rule_factors(features.withColumn("ml_score", ml))))
    return guardrail(rebalance(judged, "ml_score"), "raw_score").withColumnRenamed("adjusted_score", "final_score")


def _first(entries: Sequence[Column], k: int) -> Column:
    """The k greatest of the entries that are not null (they sort last), by (order, -place)."""
    return F.slice(F.sort_array(F.array(*entries), asc=False), 1, k)


def explain(scored: DataFrame) -> DataFrame:
    """Top positive and negative factors and the strongest factors per group.

    Ranked inside the row, which needs no shuffle. The factors are known by
    name, so every candidate is a column: the whole is compiled, and no
    function is called for each element of an array.
    """
    guarded = F.coalesce(F.col("guardrail_active"), F.lit(False))
    rows = scored.select(
        "*", F.when(guarded, F.col("guardrail_delta")).alias("impact_query_relevance_guardrail"),
        F.when(~guarded & F.col("strong_fit"), rnd(_tm("relevance_score") * F.lit(8.0), 4)).alias("impact_query_topic_fit"),
    )
    names = [*FACTOR_MAX_IMPACTS, "query_relevance_guardrail", "query_topic_fit"]
    impact = {name: F.col(f"impact_{name}") for name in names}

    def entry(name: str, condition: Column, order: Column, shown: Column | None = None) -> Column:
        built = F.struct(order.alias("order"), F.lit(-names.index(name)).alias("place"), F.lit(name).alias("key"), (impact[name] if shown is None else shown).alias("impact"))
        return F.when(condition, built)

    excluded, fit = F.coalesce(F.col("high_confidence"), F.lit(False)), F.coalesce(F.col("strong_fit"), F.lit(False))
    literal = lambda name: excluded & F.lit(name in LITERAL_ALIGNMENT_KEYS)
    gaps = {name: rnd(F.lit(most) - impact[name], 4) for name, most in FACTOR_MAX_IMPACTS.items()}
    gaps["query_prominence"] = F.when(excluded, F.least(gaps["query_prominence"], F.lit(2.0))).otherwise(gaps["query_prominence"])
    gaps = {name: F.when((impact[name] > 0) & ~literal(name) & ~(fit & F.lit(name in SEMANTIC_LIMITING_KEYS)), gap) for name, gap in gaps.items()}
    rows = rows.select("*", *[gap.alias(f"_gap_{name}") for name, gap in gaps.items()])
    gap_of = lambda name: F.col(f"_gap_{name}")
    rows = rows.select(
        "*", _first([entry(n, impact[n] > 0, impact[n]) for n in names], 5).alias("_positive"),
        _first([entry(n, (impact[n] <= 0) & ~literal(n), -impact[n]) for n in names], 5).alias("_negative"),
        _first([entry(n, gap_of(n) >= 1.25, gap_of(n), rnd(-gap_of(n), 4)) for n in gaps], 5).alias("_limiting"),
        *[_first([entry(n, F.abs(impact[n]) >= 1.0, F.abs(impact[n])) for n in names if n in keys], 4).alias(f"_group_{group}") for group, keys in FACTOR_GROUPS.items()],
    )
    # the best support factor behind the first five
    support = [entry(n, impact[n] >= 2.5, impact[n]) for n in names if n in SUPPORT_KEYS]
    behind = F.array_max(F.array(*[F.when(s < F.col("_positive")[4], s) for s in support]))
    found = rows.select(
        *scored.columns, F.array_compact(F.concat("_positive", F.array(behind))).alias("positive_factors"),
        F.slice(F.array_compact(F.concat("_negative", "_limiting")), 1, 5).alias("negative_factors"),
        *[F.array_compact(F.col(f"_group_{group}")).alias(f"group_{group}") for group in FACTOR_GROUPS],
    )
    return found


def explanation_keys(explained: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The explanation as comma-separated factor keys."""
    names = ["positive_factors", "negative_factors", *[f"group_{name}" for name in FACTOR_GROUPS]]
    return explained.select(*keys, "final_score", *[F.array_join(F.col(name)["key"], ",").alias(name) for name in names])


def serp_relative_factors(rows: DataFrame, keys: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One row per page and group: gap to the best peer, percentile and direction."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f"relative_{g}").alias("factor"),
                rnd(F.col(f"relative_gap_to_top_{g}"), 4).alias("gap_to_top"),
                rnd(F.col(f"relative_percentile_{g}"), 4).alias("percentile"),
            )
            for g in groups
        ]
    )
    return (
        rows.filter(F.col("serp_relative_context_count") > 0)
        .select(*keys, F.explode(entries).alias("e"))
        .select(*keys, "e.*")
        .filter(F.col("gap_to_top").isNotNull() & F.col("percentile").isNotNull())
        .withColumn("direction", F.when(F.col("gap_to_top") >= 0, "leading").otherwise("below_top"))
    )


def query_core_cap(rows: DataFrame, prediction: str, cap: float = 35.0, core_threshold: float = 0.75, semantic_threshold: float = 0.55) -> DataFrame:
    """Caps the prediction of pages that miss the query core and are semantically far."""
    literal = F.greatest(num("exact_query_count"), num("query_in_text"), num("query_in_title")) > 0
    far = num("semantic_similarity") < semantic_threshold
    long_page = (num("query_core_phrase_count") <= 1) & (num("word_count") >= 8000)
    capped = ~literal & far & (long_page | (num("query_core_keyword_coverage_ratio") <= core_threshold))
    return rows.withColumn("core_capped", flag(capped)).withColumn(
        "capped_prediction", F.when(capped, F.least(F.col(prediction), F.lit(cap))).otherwise(F.col(prediction))
    )


def second_pass_score(rows: DataFrame, primary: str, candidate: str | None, min_competitors: int = 2) -> DataFrame:
    """Report-only second score for rows with enough peers; the primary score stays in effect."""
    ready = (num("serp_relative_context_available") >= 1) & (num("serp_relative_context_count") >= min_competitors)
    second = F.lit(None).cast("double") if candidate is None else rnd(clip(F.col(candidate), 0.0, 100.0), 4)
    missing = F.lit("candidate_model_not_configured" if candidate is None else "candidate_model_unavailable")
    available = ready & second.isNotNull()
    return rows.select(
        "*",
        F.when(available, "available").otherwise("skipped").alias("second_pass_status"),
        F.when(~ready, F.lit("insufficient_competitor_context")).when(~available, missing).alias("second_pass_reason"),
        F.when(available, second).alias("second_pass_score"),
        rnd(clip(F.col(primary), 0.0, 100.0), 4).alias("effective_score"),
    )

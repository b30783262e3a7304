"""Weighted rubric labels per page row and their report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.numeric import clip, num, rnd
from rankloom.operators.datasets import score_stats
from rankloom.operators.relevance import with_missing

# --- fixed values -----------------------------------------------------------
# group: weight of the group; signal: weight inside the group
GROUP_WEIGHTS = {"critical": 0.55, "important": 0.30, "supporting": 0.10, "rank_prior": 0.05}
SIGNAL_WEIGHTS = {
    "critical": {
        "crawl_indexability": 0.18, "canonical_consistency": 0.12, "title_query_fit": 0.19, "heading_query_fit": 0.10,
        "semantic_query_fit": 0.25, "intent_alignment": 0.16,
    },
    "important": {
        "technical_metadata": 0.22, "page_structure": 0.16, "commercial_trust": 0.24, "offer_and_conversion": 0.20,
        "mobile_render_performance": 0.18,
    },
    "supporting": {
        "text_sufficiency": 0.25, "media_and_internal_navigation": 0.20, "secondary_commercial_details": 0.35, "structured_support": 0.20,
    },
}
# signal: (weight, kind, feature or features, argument)
#   unit: clamp to 0..1    flag: 1 if above 0 (argument = value of an absent feature)    any: 1 if one of them is above 0
#   share: value / argument within 0..1    least: 1 if at least argument    inverse: 1 - unit    semantic: (v + 0.05) / 0.95
#   clean: 1 - the largest unit    cta: flag or share of two
COMPONENTS = {
    "crawl_indexability": (
        (0.35, "flag", "http_status_ok", 1.0), (0.35, "flag", "page_indexable", 1.0),
        (0.15, "clean", ("robots_noindex", "robots_nofollow"), None), (0.08, "flag", "viewport_present", 1.0), (0.07, "flag", "lang_present", 1.0),
    ),
    "canonical_consistency": (
        (0.25, "flag", "canonical_present", 0.0), (0.55, "flag", "canonical_matches_final_url", 0.0), (0.20, "unit", "canonical_signal_score", None),
    ),
    "title_query_fit": (
        (0.12, "flag", "title_present", 0.0), (0.30, "flag", "query_in_title", 0.0), (0.25, "unit", "title_keyword_coverage_ratio", None),
        (0.23, "unit", "title_semantic_alignment", None), (0.10, "unit", "title_length_quality", None),
    ),
    "heading_query_fit": (
        (0.20, "least", "h1_count", 1.0), (0.28, "unit", "heading_query_coverage_ratio", None), (0.17, "share", "query_terms_in_headings", 4.0),
        (0.22, "unit", "heading_semantic_alignment", None), (0.13, "unit", "title_heading_keyword_alignment", None),
    ),
    "semantic_query_fit": (
        (0.30, "semantic", "semantic_similarity", None), (0.22, "unit", "query_semantic_alignment", None), (0.22, "unit", "keyword_coverage_ratio", None),
        (0.12, "unit", "keyword_balance_score", None), (0.14, "unit", "query_prominence_score", None),
    ),
    "intent_fallback": (
        (0.35, "unit", "commercial_intent_alignment", None), (0.25, "unit", "local_intent_alignment", None),
        (0.25, "unit", "informational_intent_alignment", None), (0.15, "unit", "navigational_intent_alignment", None),
    ),
    "technical_metadata": (
        (0.32, "unit", "technical_metadata_score", None), (0.20, "unit", "url_hygiene_score", None), (0.16, "unit", "redirect_efficiency_score", None),
        (0.16, "flag", "meta_description_present", 0.0), (0.16, "unit", "meta_length_quality", None),
    ),
    "page_structure": (
        (0.22, "unit", "heading_paragraph_balance", None), (0.16, "unit", "content_link_ratio", None),
        (0.34, "unit", "content_depth_semantic_score", None), (0.28, "unit", "semantic_content_richness", None),
    ),
    "commercial_raw": (
        (0.24, "unit", "contact_options_score", None), (0.20, "unit", "commercial_signals_score", None), (0.20, "unit", "trust_signals_score", None),
        (0.26, "unit", "commercial_trust_score", None), (0.10, "any", ("company_identity_present", "legal_requisites_present"), None),
    ),
    "offer_and_conversion": (
        (0.28, "cta", ("cta_present", "cta_count"), 2.0), (0.24, "flag", "value_proposition_present", 0.0),
        (0.22, "any", ("phone_present", "email_present", "address_present"), None), (0.14, "flag", "structured_data_offer_schema_present", 0.0),
        (0.12, "flag", "price_present", 0.0),
    ),
    "mobile_render_performance": (
        (0.23, "unit", "mobile_readiness_score", None), (0.20, "unit", "rendering_score", None), (0.20, "unit", "performance_proxy_score", None),
        (0.12, "inverse", "performance_resource_complexity_score", None), (0.25, "unit", "heavy_analysis_overall_score", None),
    ),
    "media_and_internal_navigation": (
        (0.38, "share", "link_count", 80.0), (0.24, "share", "image_count", 20.0), (0.38, "share", "list_item_count", 40.0),
    ),
    "secondary_commercial_details": (
        (0.18, "flag", "price_present", 0.0), (0.12, "flag", "payment_info_present", 0.0), (0.12, "flag", "delivery_info_present", 0.0),
        (0.12, "any", ("warranty_info_present", "returns_info_present"), None), (0.18, "any", ("reviews_present", "rating_present"), None),
        (0.10, "flag", "messenger_present", 0.0), (0.18, "flag", "faq_present", 0.0),
    ),
    "structured_support": (
        (0.42, "unit", "structured_data_score", None), (0.20, "share", "structured_data_valid_json_ld_count", 3.0),
        (0.18, "flag", "structured_data_breadcrumb_schema_present", 0.0), (0.20, "flag", "structured_data_faq_schema_present", 0.0),
    ),
}
WORD_STEPS = ((80.0, 0.12), (250.0, 0.35), (600.0, 0.62), (1400.0, 0.85))
PAGE_TYPE_SHIFT = {
    "commercial": {"product": 3.0, "category": 3.0, "homepage": 1.5, "content": -2.0, "article": -8.0},
    "informational": {"article": 3.0, "content": 2.0, "homepage": 0.5, "category": 0.0, "product": -3.0},
}
CAPS = {
    "critical_http_status_not_ok": 35.0, "critical_page_not_indexable": 45.0, "critical_title_missing": 72.0,
    "critical_query_title_fit_weak": 78.0, "critical_semantic_query_fit_weak": 62.0, "critical_intent_alignment_weak": 70.0,
    "important_canonical_points_elsewhere": 82.0, "important_commercial_trust_weak": 76.0, "critical_no_extracted_text": 35.0,
    "important_extremely_thin_content": 55.0, "supporting_text_insufficient": 70.0,
}
# --- end of fixed values ----------------------------------------------------

SIGNALS = tuple((group, name) for group, weights in SIGNAL_WEIGHTS.items() for name in weights)


def _unit(name: str) -> Column:
    return clip(num(name), 0.0, 1.0)


def _raised(name: str, default: float = 0.0) -> Column:
    return F.when(num(name, default) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def _component(kind: str, feature, argument) -> Column:
    if kind == "unit":
        return _unit(feature)
    if kind == "flag":
        return _raised(feature, argument)
    if kind == "any":
        return F.greatest(*[_raised(name) for name in feature])
    if kind == "share":
        return clip(num(feature) / F.lit(argument), 0.0, 1.0)
    if kind == "least":
        return F.when(num(feature) >= argument, F.lit(1.0)).otherwise(F.lit(0.0))
    if kind == "inverse":
        return F.lit(1.0) - _unit(feature)
    if kind == "semantic":
        return clip((num(feature) + F.lit(0.05)) / F.lit(0.95), 0.0, 1.0)
    if kind == "clean":
        return F.lit(1.0) - F.greatest(*[_unit(name) for name in feature])
    if kind == "cta":
        return F.greatest(_raised(feature[0]), clip(num(feature[1]) / F.lit(argument), 0.0, 1.0))
    raise ValueError(f"unknown component kind {kind}")


def _blend(parts: list[tuple[float, Column]]) -> Column:
    total = sum(weight for weight, _ in parts)
    return clip(reduce(lambda a, b: a + b, [value * F.lit(weight) for weight, value in parts]) / F.lit(total), 0.0, 1.0)


def _features() -> list[str]:
    names: list[str] = []
    for parts in COMPONENTS.values():
        for _, _, feature, _ in parts:
            names.extend([feature] if isinstance(feature, str) else feature)
    return [*dict.fromkeys(names), "word_count", "intent_alignment_score", "intent_is_commercial", "intent_is_local_commercial", "intent_is_informational"]


def rubric_labels(rows: DataFrame) -> DataFrame:
    """Rubric score, group scores, caps, band and strongest factors per row; one projection chain, no shuffle."""
    base = with_missing(rows, _features())
    blended = {name: _blend([(w, _component(kind, f, a)) for w, kind, f, a in parts]) for name, parts in COMPONENTS.items()}
    commercial_intent = F.greatest(_unit("intent_is_commercial"), _unit("intent_is_local_commercial"))
    words = num("word_count")
    text = reduce(lambda rest, step: F.when(words < step[0], F.lit(step[1])).otherwise(rest), reversed(WORD_STEPS), F.lit(1.0))
    staged = base.select("*", *[column.alias(f"_s_{name}") for name, column in blended.items()])
    staged = staged.select(
        "*",
        F.when(_unit("intent_alignment_score") > 0, _unit("intent_alignment_score")).otherwise(F.col("_s_intent_fallback")).alias("_s_intent_alignment"),
        F.when(commercial_intent >= 0.5, F.col("_s_commercial_raw")).otherwise(F.greatest(F.col("_s_commercial_raw"), F.lit(0.72))).alias("_s_commercial_trust"),
        F.when(words <= 0, F.lit(0.0)).otherwise(text).alias("_s_text_sufficiency"),
        clip(F.coalesce(F.col("weak_target_score").cast("double"), num("target_score")) / 100.0, 0.0, 1.0).alias("_rank_prior"),
    )
    groups = {g: _blend([(w, F.col(f"_s_{name}")) for name, w in weights.items()]) for g, weights in SIGNAL_WEIGHTS.items()}
    staged = staged.select("*", *[column.alias(f"_g_{g}") for g, column in groups.items()])
    shift_of = lambda table: reduce(lambda rest, kv: F.when(F.lower("page_type") == kv[0], F.lit(kv[1])).otherwise(rest), table.items(), F.lit(0.0))
    shift = F.when(commercial_intent >= _unit("intent_is_informational"), shift_of(PAGE_TYPE_SHIFT["commercial"])).otherwise(shift_of(PAGE_TYPE_SHIFT["informational"]))
    raw = F.lit(100.0) * (
        F.lit(GROUP_WEIGHTS["critical"]) * F.col("_g_critical") + F.lit(GROUP_WEIGHTS["important"]) * F.col("_g_important")
        + F.lit(GROUP_WEIGHTS["supporting"]) * F.col("_g_supporting") + F.lit(GROUP_WEIGHTS["rank_prior"]) * F.col("_rank_prior")
    ) + shift
    conditions = {
        "critical_http_status_not_ok": _raised("http_status_ok", 1.0) < 1,
        "critical_page_not_indexable": (_raised("page_indexable", 1.0) < 1) | (_unit("robots_noindex") > 0),
        "critical_title_missing": _raised("title_present") < 1,
        "critical_query_title_fit_weak": F.col("_s_title_query_fit") < 0.35,
        "critical_semantic_query_fit_weak": (F.col("_s_semantic_query_fit") < 0.30) & (_unit("keyword_coverage_ratio") < 0.35),
        "critical_intent_alignment_weak": F.col("_s_intent_alignment") < 0.30,
        "important_canonical_points_elsewhere": (_raised("canonical_present") > 0) & (_raised("canonical_matches_final_url") < 1),
        "important_commercial_trust_weak": (F.col("_s_commercial_trust") < 0.28) & (commercial_intent >= 0.5),
        "critical_no_extracted_text": words <= 0,
        "important_extremely_thin_content": (words > 0) & (words < 80),
        "supporting_text_insufficient": (words >= 80) & (words < 250),
    }
    staged = staged.select(
        "*", raw.alias("_raw"), *[condition.alias(f"_cap_{name}") for name, condition in conditions.items()], *[rnd(F.col(f"_s_{name}"), 9).alias(f"_r_{name}") for _, name in SIGNALS]
    )
    # candidates are columns, so ranking is compiled; nulls sort last, and of equal scores the first signal is the greatest entry
    scored = [(name, F.col(f"_r_{name}"), F.lit(-i).alias("place")) for i, (_, name) in enumerate(SIGNALS)]
    listed = lambda order, keep=None: F.slice(
        F.sort_array(
            F.array(*[
                entry if keep is None else F.when(keep(score), entry)
                for entry, score in ((F.struct(order(score).alias("order"), place, F.lit(name).alias("name")), score) for name, score, place in scored)
            ]),
            asc=False,
        ),
        1, 3 if keep is None else 4,
    )
    strong, weak = lambda score: score >= 0.78, lambda score: score <= 0.45
    staged = staged.select(
        "*", listed(lambda s: s, strong).alias("_strong"), listed(lambda s: s).alias("_best"), listed(lambda s: -s, weak).alias("_weak"), listed(lambda s: -s).alias("_worst"),
    )
    names = lambda chosen, others: F.concat_ws("|", F.when(F.col(chosen)[0].isNotNull(), F.col(chosen)["name"]).otherwise(F.col(others)["name"]))
    raised = lambda value: [F.when(F.col(f"_cap_{name}"), value(name)) for name in sorted(conditions)]
    cap = F.coalesce(F.least(*raised(lambda name: F.lit(CAPS[name]))), F.lit(100.0))
    staged = staged.withColumn("cap_applied", cap).withColumn("expert_target_score", rnd(clip(F.least(F.col("_raw"), F.col("cap_applied")), 0.0, 100.0), 1))
    score = F.col("expert_target_score")
    return staged.select(
        *rows.columns, "expert_target_score",
        rnd(F.col("_g_critical"), 6).alias("critical_score"), rnd(F.col("_g_important"), 6).alias("important_score"),
        rnd(F.col("_g_supporting"), 6).alias("supporting_score"), rnd(F.col("_rank_prior"), 6).alias("rank_prior_score"), "cap_applied",
        F.concat_ws("|", *raised(F.lit)).alias("cap_reasons"),
        F.when(score >= 85, "high").when(score >= 65, "medium").when(score >= 40, "low").otherwise("blocked").alias("quality_band"),
        names("_strong", "_best").alias("top_positive_factors"),
        names("_weak", "_worst").alias("top_negative_factors"),
    )


def rubric_histograms(labels: DataFrame) -> DataFrame:
    """Counts per band, cap reason and page type; reasons are exploded, then counted map-side."""
    kinds = F.concat(
        F.array(
            F.struct(F.lit("quality_band").alias("kind"), F.col("quality_band").alias("value")),
            F.struct(F.lit("page_type").alias("kind"), F.coalesce("page_type", F.lit("unknown")).alias("value")),
        ),
        F.transform(
            F.filter(F.split("cap_reasons", "\\|"), lambda r: r != ""),
            lambda r: F.struct(F.lit("cap_reason").alias("kind"), r.alias("value")),
        ),
    )
    return labels.select(F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))


def rubric_distribution(labels: DataFrame) -> DataFrame:
    return score_stats(labels.withColumn("scope", F.lit("all")), ["scope"], "expert_target_score", nullable=False).drop("p90")


def rubric_examples(labels: DataFrame, k: int = 3) -> DataFrame:
    """Up to k example rows per band, each band in its own order; the group limit keeps k rows per task."""
    score = F.col("expert_target_score")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("quality_band") == "high", F.struct(F.lit("high").alias("band"), (-score).alias("a"), F.lit(0.0).alias("b"))),
            F.when(F.col("quality_band") == "medium", F.struct(F.lit("medium").alias("band"), F.abs(score - 72.0).alias("a"), F.lit(0.0).alias("b"))),
            F.when(F.col("quality_band").isin("low", "blocked"), F.struct(F.lit("low").alias("band"), score.alias("a"), F.lit(0.0).alias("b"))),
            F.when(F.col("cap_reasons") != "", F.struct(F.lit("capped").alias("band"), F.col("cap_applied").alias("a"), (-score).alias("b"))),
        )
    )
    listed = labels.select("query", "url", "expert_target_score", "quality_band", "cap_reasons", F.explode(kinds).alias("e")).select("*", "e.band", "e.a", "e.b")
    place = F.row_number().over(Window.partitionBy("band").orderBy("a", "b", "query", "url"))
    return listed.withColumn("place", place).filter(F.col("place") <= k).select("band", "place", "query", "url", "expert_target_score", "quality_band", "cap_reasons")

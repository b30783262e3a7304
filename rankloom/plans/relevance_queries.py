"""Relevance, guardrail and scoring queries over page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import peers, relevance
from rankloom.plans.oracle_text import big, clip, mean, rnd
from rankloom.plans.peer_queries import _ALL_ORACLE
from rankloom.plans.registry import Catalog
from rankloom.sources.views import load_view, view_cte

CATALOG = Catalog()


def _n(name: str) -> str:
    return f"coalesce(CAST({name} AS DOUBLE), 0e0)"


def _u(name: str) -> str:
    return clip(_n(name), "0e0", "1e0")


# A fixed linear score stands in for the model, so the oracle can compute it too.
ML_SCORE = "100e0 * (45e-2 * keyword_coverage_ratio + 35e-2 * semantic_similarity + 2e-1 * technical_seo_score)"

TM_SQL = f"""
t0 AS (SELECT *, {rnd(clip(ML_SCORE, '0e0', '100e0'), 4)} AS ml,
  CASE WHEN semantic_provider_code = 2 THEN 1 ELSE 0 END AS ros,
  CASE WHEN query_core_keyword_coverage_ratio IS NOT NULL THEN {_u('query_core_keyword_coverage_ratio')} ELSE {_u('keyword_coverage_ratio')} END AS core0,
  CASE WHEN word_count > 0 AND query_core_term_count IS NOT NULL THEN greatest(0e0, query_core_term_count) / word_count ELSE greatest(0e0, query_density) END AS cden0,
  greatest({_u('query_in_title')}, {_u('title_semantic_alignment')}, {_u('heading_semantic_alignment')}) AS th0,
  greatest({_u('exact_query_count')}, {_u('query_in_title')}, {_u('query_in_text')}, {_u('title_semantic_alignment')}, {_u('heading_semantic_alignment')}) AS st0
  FROM v_rows),
t1 AS (SELECT *,
  {rnd(clip(f"core0 * 38e-2 + {_u('semantic_similarity')} * CASE WHEN ros = 1 THEN 26e-2 ELSE 22e-2 END + {_u('keyword_coverage_ratio')} * 1e-1 + {clip('cden0 / 8e-3', '0e0', '1e0')} * 15e-2 + greatest(st0, {_u('query_prominence_score')}) * 15e-2", '0e0', '1e0'), 4)} AS rel,
  {rnd(_u('semantic_similarity'), 4)} AS sem, {rnd('core0', 4)} AS core, {rnd('cden0', 6)} AS cden, {rnd('st0', 4)} AS st, {rnd('th0', 4)} AS th,
  {rnd(clip('cden0 / 8e-3', '0e0', '1e0'), 4)} AS cds, {rnd(_u('query_prominence_score'), 4)} AS prom, {rnd(_u('keyword_coverage_ratio'), 4)} AS kw,
  {rnd(_u('semantic_similarity') + ' * core0', 4)} AS csa FROM t0),
t2 AS (SELECT *, (rel >= 58e-2 AND core >= 75e-2 AND (cds >= 5e-1 OR prom >= 45e-2 OR st >= 65e-2)) AS fit,
  (http_status_ok >= 5e-1) AND (word_count >= 80 OR text_length_chars >= 500) AS evaluable,
  concat_ws(',', CASE WHEN http_status_code >= 100 AND http_status_ok < 5e-1 THEN 'http_status_not_ok' END,
    CASE WHEN page_indexable < 5e-1 THEN 'page_not_indexable' END, CASE WHEN robots_noindex > 5e-1 THEN 'robots_noindex' END,
    CASE WHEN word_count < 20 AND text_length_chars < 200 THEN 'empty_or_too_thin_content' END) AS reasons FROM t1),
t3 AS (SELECT *, (fit AND rel >= 8e-1 AND core >= 9e-1) AS high,
  (evaluable AND reasons = '' AND NOT fit AND rel <= 15e-2 AND sem <= CASE WHEN ros = 1 THEN 18e-2 ELSE 22e-2 END AND core <= 5e-2
   AND cden <= 8e-4 AND exact_query_count <= 0 AND th <= 5e-2 AND prom <= 8e-2) AS stop FROM t2)"""

GUARD_SQL = """
  CASE WHEN reasons <> '' THEN 0 WHEN stop THEN 1
    WHEN NOT fit AND core <= 5e-2 AND kw <= 4e-1 AND query_intent_modifier_coverage_ratio >= 75e-2 AND cden < 8e-4 AND st < 25e-2 AND prom < 35e-2 THEN 2
    WHEN NOT fit AND evaluable AND modifier_or_geo_only_match >= 1 AND core_missing_but_geo_present >= 1 AND query_primary_core_term_present < 5e-1
      AND greatest(query_primary_core_term_in_title, query_primary_core_term_in_headings) < 5e-1 AND core < 75e-2 AND st < 45e-2 AND (sem < 62e-2 OR csa < 35e-2) THEN 3
    WHEN NOT fit AND rel < 35e-2 AND core < 34e-2 AND sem < CASE WHEN ros = 1 THEN 3e-1 ELSE 38e-2 END AND cden < 2e-3 THEN 4
    WHEN NOT fit AND rel < 48e-2 AND core < 5e-1 AND sem < CASE WHEN ros = 1 THEN 4e-1 ELSE 45e-2 END AND cden < 4e-3 THEN 5
    WHEN NOT fit AND rel < 58e-2 AND core < 75e-2 AND st < 35e-2 AND prom < 35e-2 THEN 6 END AS b"""

BAND_SQL = """(VALUES (0, 'unusable', 'page_unusable', 10e0, 1e-1), (1, 'full_mismatch', 'confident_full_query_mismatch', 5e0, 5e-2),
  (2, 'core_mismatch', 'commercial_modifier_only_core_mismatch', 8e0, 15e-2), (3, 'probable_mismatch', 'local_service_core_mismatch', 25e0, 25e-2),
  (4, 'probable_mismatch', 'probable_query_topic_mismatch', 25e0, 25e-2), (5, 'weak_match', 'weak_query_topic_match', 55e0, 55e-2),
  (6, 'partial_match', 'partial_query_topic_match', 80e0, 8e-1)) AS bands(bid, band, band_reason, bmax, mult)"""


def adjusted(score: str) -> str:
    return rnd(clip(f"least({rnd(clip(f'{score} * coalesce(mult, 1e0)', '0e0', '100e0'), 4)}, coalesce(bmax, 100e0))", "0e0", "100e0"), 4)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_rows").withColumn("ml", peers.rnd(peers.clip(F.expr(ML_SCORE), 0.0, 100.0), 4))


_METRIC_SQL = {
    "relevance_score": "rel", "semantic_similarity": "sem", "query_core_keyword_coverage_ratio": "core", "query_core_density": "cden",
    "exact_or_structural_signal": "st", "title_heading_signal": "th", "core_density_signal": "cds", "query_prominence_score": "prom",
    "keyword_coverage_ratio": "kw", "query_core_semantic_alignment": "csa",
    "density_signal": rnd(clip("query_density / 1e-2", "0e0", "1e0"), 4),
    "query_density": rnd("query_density", 6),
    "exact_query_count": rnd("exact_query_count", 4),
    "query_geo_modifier_coverage_ratio": rnd(_u("query_geo_modifier_coverage_ratio"), 4),
    "query_primary_core_term_in_title_heading": "CAST(greatest(query_primary_core_term_in_title, query_primary_core_term_in_headings) AS DOUBLE)",
    "modifier_or_geo_only_match": "CAST(modifier_or_geo_only_match AS DOUBLE)",
    "semantic_embedding_failure": "CAST(semantic_embedding_failure AS DOUBLE)",
}


@CATALOG.query("topic_metrics", view_cte("v_rows") + "," + TM_SQL + " SELECT query, url, " + ", ".join(f"{sql} AS {name}" for name, sql in _METRIC_SQL.items()) + " FROM t1")
def topic_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.topic_metrics(_rows(spark, folder))
    return rows.select("query", "url", *[F.col(f"tm_{name}").alias(name) for name in _METRIC_SQL])


@CATALOG.query("strong_topic_fit", view_cte("v_rows") + "," + TM_SQL + f" SELECT category, {big('count(*)')} AS pages, {big('count(*) FILTER (fit)')} AS strong, {big('count(*) FILTER (high)')} AS high_confidence FROM t3 GROUP BY category")
def strong_topic_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.preflight(relevance.topic_metrics(_rows(spark, folder)))
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("strong_fit").alias("strong"), F.count_if("high_confidence").alias("high_confidence")
    )


@CATALOG.query("unusable_reasons", view_cte("v_rows") + "," + TM_SQL + " SELECT query, url, reasons FROM t2 WHERE reasons <> ''")
def unusable_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").withColumn("r", relevance.unusable_reasons())
    return rows.filter(F.size("r") > 0).select("query", "url", F.concat_ws(",", "r").alias("reasons"))


@CATALOG.query("preflight_stop", view_cte("v_rows") + "," + TM_SQL + """ SELECT query, url, stop AS should_stop,
  CASE WHEN stop THEN 'confident_full_query_mismatch' ELSE 'not_confident_enough_for_early_stop' END AS preflight_reason,
  CASE WHEN stop THEN 'high' WHEN evaluable THEN 'low' ELSE 'insufficient_content' END AS preflight_confidence,
  CASE WHEN stop THEN 5e0 END AS score_ceiling FROM t3""")
def preflight_stop(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.preflight(relevance.topic_metrics(_rows(spark, folder)))
    return rows.select("query", "url", "should_stop", "preflight_reason", "preflight_confidence", "score_ceiling")


_GUARDED = view_cte("v_rows") + "," + TM_SQL + f", t4 AS (SELECT *, {GUARD_SQL} FROM t3)"


@CATALOG.query("relevance_guardrail", _GUARDED + f""" SELECT query, url, band, band_reason, bmax AS band_max, coalesce(mult, 1e0) AS relevance_multiplier,
  {adjusted('ml')} AS adjusted_score, {rnd(adjusted('ml') + ' - ml', 4)} AS guardrail_delta FROM t4 LEFT JOIN {BAND_SQL} ON b = bid""")
def relevance_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    judged = relevance.preflight(relevance.topic_metrics(_rows(spark, folder)))
    return relevance.guardrail(judged, "ml").select(
        "query", "url", "band", "band_reason", "band_max", "relevance_multiplier", "adjusted_score", "guardrail_delta"
    )


_PAGE_LEVEL = f"({' + '.join(_u(c) for c in ('phone_present', 'address_present', 'business_hours_present', 'cta_present', 'value_proposition_present'))}) / 5e0"


def _f(key: str, impact: str, condition: str = "TRUE") -> str:
    return f"CASE WHEN {condition} THEN {{'key': '{key}', 'impact': {rnd(impact, 4)}}} END"


_FACTOR_LIST = ", ".join(
    [
        _f("content_depth", "least(word_count / 7e2, 1e0) * 4e0"),
        _f("semantic_relevance", "semantic_similarity * 2e1"),
        _f("keyword_coverage", "keyword_coverage_ratio * 1e1"),
        _f("title_signal", "(title_present * 5e-1 + title_length_quality * 5e-1) * 8e0"),
        _f("meta_signal", "(meta_description_present * 5e-1 + meta_length_quality * 5e-1) * 5e0"),
        _f("heading_structure", "least(heading_count / 6e0, 1e0) * 6e0"),
        _f("title_semantic_alignment", "title_semantic_alignment * 6e0"),
        _f("heading_semantic_alignment", "heading_semantic_alignment * 5e0"),
        _f("content_depth_semantic_score", "content_depth_semantic_score * 8e0"),
        _f("semantic_content_richness", "semantic_content_richness * 8e0"),
        _f("keyword_balance", "keyword_balance_score * 7e0"),
        _f("conversion_signal", "conversion_signal_score * 4e0"),
        _f("query_prominence", "query_prominence_score * 8e0"),
        _f("text_to_html_ratio", "least(text_to_html_ratio / 25e-2, 1e0) * 4e0"),
        _f("uniqueness", "unique_word_ratio * 5e0"),
        _f("technical_indexability", "CASE WHEN page_indexable >= 1 THEN 6e0 ELSE -12e0 END"),
        _f("technical_canonical", "CASE WHEN canonical_present < 1 THEN 0e0 WHEN canonical_matches_final_url >= 1 THEN 4e0 ELSE -6e0 END"),
        _f("technical_redirects", "redirect_efficiency_score * 4e0 - least(redirect_count, 3e0)"),
        _f("technical_url_hygiene", "(url_hygiene_score - 5e-1) * 6e0"),
        _f("technical_metadata", "(technical_metadata_score - 5e-1) * 4e0"),
        _f("commercial_completeness", f"(greatest(commercial_signals_score, {_PAGE_LEVEL}) - 35e-2) * 1e1"),
        _f("trust_signals", "(trust_signals_score - 35e-2) * 9e0"),
        _f("contact_accessibility", "(contact_options_score - 4e-1) * 6e0"),
        _f("intent_alignment", "(intent_alignment_score - 5e-1) * 1e1"),
        _f("local_intent_fit", "(local_intent_alignment - 55e-2) * 8e0", "intent_is_local_commercial >= 1"),
        _f("commercial_intent_fit", "(commercial_intent_alignment - 55e-2) * 7e0", "intent_is_commercial >= 1"),
        _f("informational_intent_fit", "(informational_intent_alignment - 55e-2) * 6e0", "intent_is_informational >= 1"),
    ]
)
_RULE_SQL = f"""
f0 AS (SELECT *, list_filter([{_FACTOR_LIST}], lambda f: f IS NOT NULL) AS factors FROM t4),
f1 AS (SELECT *, {rnd(clip("list_sum(list_transform(factors, lambda f: round_even(f.impact * 1e4, 0))) / 1e4 / 150e0 * 100e0", '0e0', '100e0'), 4)} AS rule FROM f0)"""

_SCORED_SQL = _GUARDED + "," + _RULE_SQL + f""",
s0 AS (SELECT *, CASE WHEN high THEN 4e-1 ELSE 25e-2 END AS w FROM f1 LEFT JOIN {BAND_SQL} ON b = bid),
s1 AS (SELECT *, {rnd(clip(f"least(ml + 8e0, {rnd(clip('rule * w + ml * (1e0 - w)', '0e0', '100e0'), 4)})", '0e0', '100e0'), 4)} AS raised FROM s0),
s2 AS (SELECT *, CASE WHEN rule <= ml THEN 'rule_score_not_higher' WHEN NOT fit THEN 'weak_or_partial_query_fit' WHEN {rnd('raised - ml', 4)} <= 0 THEN 'uplift_not_positive'
  WHEN high THEN 'high_confidence_query_fit' ELSE 'strong_query_fit' END AS why FROM s1),
s3 AS (SELECT *, why IN ('high_confidence_query_fit', 'strong_query_fit') AS act FROM s2),
s4 AS (SELECT *, CASE WHEN act THEN raised ELSE ml END AS raw FROM s3),
s5 AS (SELECT *, {adjusted('raw')} AS final FROM s4)"""


@CATALOG.query("rule_score", _GUARDED + "," + _RULE_SQL + """ SELECT query, url, rule AS rule_score, CAST(len(factors) AS INT) AS factor_count,
  list_max(list_transform(factors, lambda f: f.impact)) AS best_impact, list_min(list_transform(factors, lambda f: f.impact)) AS worst_impact FROM f1""")
def rule_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = relevance.rule_factors(load_view(spark, folder, "v_rows"))
    impacts = F.transform("factors", lambda f: f["impact"])
    return rows.select(
        "query", "url", "rule_score", F.size("factors").alias("factor_count"),
        F.array_max(impacts).alias("best_impact"), F.array_min(impacts).alias("worst_impact"),
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.score_pages(load_view(spark, folder, "v_rows").withColumn("model_output", F.expr(ML_SCORE)), "model_output")


@CATALOG.query("score_rebalance", _SCORED_SQL + f""" SELECT query, url, ml AS ml_score, rule AS rule_score, why AS rebalance_reason,
  CASE WHEN act THEN w ELSE 0e0 END AS rule_weight, CASE WHEN act THEN {rnd('raised - ml', 4)} ELSE 0e0 END AS uplift, raw AS raw_score FROM s5""")
def score_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("query", "url", "ml_score", "rule_score", "rebalance_reason", "rule_weight", "uplift", "raw_score")


@CATALOG.query("score_pages", _SCORED_SQL + " SELECT query, url, raw AS raw_score, band, final AS final_score FROM s5")
def score_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("query", "url", "raw_score", "band", "final_score")


_MAX_SQL = "MAP {" + ", ".join(f"'{k}': CAST({v!r} AS DOUBLE)" for k, v in relevance.FACTOR_MAX_IMPACTS.items()) + "}"


def _in(keys: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{k}'" for k in keys) + ")"


_EXPLAIN_SQL = _SCORED_SQL + f""",
e0 AS (SELECT query, url, final, high, fit, list_concat(factors, CASE WHEN final < raw THEN [{{'key': 'query_relevance_guardrail', 'impact': {rnd('final - raw', 4)}}}]
  WHEN fit THEN [{{'key': 'query_topic_fit', 'impact': {rnd('rel * 8e0', 4)}}}] ELSE [] END) AS fs FROM s5),
e1 AS (SELECT query, url, final, high, fit, unnest(fs) AS f, generate_subscripts(fs, 1) AS pos FROM e0),
e2 AS (SELECT query, url, final, high, fit, pos, f.key AS k, f.impact AS i,
  CASE WHEN high AND f.key = 'query_prominence' THEN least({rnd(f"{_MAX_SQL}[f.key] - f.impact", 4)}, 2e0) ELSE {rnd(f"{_MAX_SQL}[f.key] - f.impact", 4)} END AS gap FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY i DESC, pos) AS up FROM e2),
e4 AS (SELECT *, CASE WHEN i > 0 AND up > 5 AND k IN {_in(relevance.SUPPORT_KEYS)} AND i >= 25e-1
  THEN row_number() OVER (PARTITION BY query, url, (i > 0 AND up > 5 AND k IN {_in(relevance.SUPPORT_KEYS)} AND i >= 25e-1) ORDER BY up) END AS sup,
  CASE WHEN i <= 0 AND NOT (high AND k IN {_in(relevance.LITERAL_ALIGNMENT_KEYS)}) THEN 0
    WHEN i > 0 AND gap >= 125e-2 AND NOT (fit AND k IN {_in(relevance.SEMANTIC_LIMITING_KEYS)}) AND NOT (high AND k IN {_in(relevance.LITERAL_ALIGNMENT_KEYS)}) THEN 1 END AS neg FROM e3),
e5 AS (SELECT *, CASE WHEN neg IS NOT NULL THEN row_number() OVER (PARTITION BY query, url, neg IS NULL ORDER BY neg, CASE WHEN neg = 0 THEN i ELSE -gap END, pos) END AS down,
  CASE k {' '.join(f"WHEN '{k}' THEN '{g}'" for g, ks in relevance.FACTOR_GROUPS.items() for k in ks)} END AS grp FROM e4),
e6 AS (SELECT *, row_number() OVER (PARTITION BY query, url, grp ORDER BY abs(i) DESC, pos) AS g FROM e5)
SELECT query, url, any_value(final) AS final_score,
  coalesce(string_agg(k, ',' ORDER BY up) FILTER (i > 0 AND (up <= 5 OR sup = 1)), '') AS positive_factors,
  coalesce(string_agg(k, ',' ORDER BY down) FILTER (down <= 5), '') AS negative_factors,
  {', '.join(f"coalesce(string_agg(k, ',' ORDER BY g) FILTER (grp = '{g}' AND g <= 4 AND abs(i) >= 1), '') AS group_{g}" for g in relevance.FACTOR_GROUPS)}
FROM e6 GROUP BY query, url"""


@CATALOG.query("score_explanation", _EXPLAIN_SQL)
def score_explanation(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.explanation_keys(relevance.explain(_scored(spark, folder)), ["query", "url"])


_GROUPS = tuple(peers.SERP_RELATIVE_GROUPS)


@CATALOG.query("serp_relative_factors", _ALL_ORACLE.replace("\nSELECT query, url, CAST(max(peers)", ",\no_all AS (SELECT query, url, CAST(max(peers)").rstrip() + "),\n"
    + "o_f AS (" + " UNION ALL ".join(
        f"SELECT query, url, 'relative_{g}' AS factor, {rnd(f'relative_gap_to_top_{g}', 4)} AS gap_to_top, {rnd(f'relative_percentile_{g}', 4)} AS percentile FROM o_all" for g in _GROUPS)
    + f""") SELECT query, factor, CASE WHEN gap_to_top >= 0 THEN 'leading' ELSE 'below_top' END AS direction, {big('count(*)')} AS pages,
    {rnd(mean('gap_to_top', 4), 4)} AS mean_gap, {rnd(mean('percentile', 4), 4)} AS mean_percentile FROM o_f GROUP BY ALL""")
def serp_relative_factors(spark: SparkSession, folder: str) -> DataFrame:
    rows = peers.serp_relative_all(load_view(spark, folder, "v_rows"))
    factors = relevance.serp_relative_factors(rows, ["query", "url"], _GROUPS)
    return factors.groupBy("query", "factor", "direction").agg(
        F.count(F.lit(1)).alias("pages"),
        peers.rnd(peers.stable_mean(F.col("gap_to_top"), 4), 4).alias("mean_gap"),
        peers.rnd(peers.stable_mean(F.col("percentile"), 4), 4).alias("mean_percentile"),
    )


_CAP_SQL = "greatest(exact_query_count, query_in_text, query_in_title) <= 0 AND semantic_similarity < 55e-2 AND ((query_core_phrase_count <= 1 AND word_count >= 8000) OR coalesce(query_core_keyword_coverage_ratio, 0e0) <= 75e-2)"


@CATALOG.query("query_core_cap", view_cte("v_rows") + f" SELECT query, url, CASE WHEN {_CAP_SQL} THEN 1 ELSE 0 END AS core_capped, CASE WHEN {_CAP_SQL} THEN least(target_score, 35e0) ELSE target_score END AS capped_prediction FROM v_rows")
def query_core_cap(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.query_core_cap(load_view(spark, folder, "v_rows"), "target_score").select("query", "url", "core_capped", "capped_prediction")


@CATALOG.query("second_pass_score", view_cte("v_rows") + f""", o AS (SELECT query, count(*) - 1 AS others FROM v_rows GROUP BY query)
SELECT r.query, r.url, CASE WHEN others >= 2 AND rank % 5 > 0 THEN 'available' ELSE 'skipped' END AS second_pass_status,
  CASE WHEN others < 2 THEN 'insufficient_competitor_context' WHEN rank % 5 = 0 THEN 'candidate_model_unavailable' END AS second_pass_reason,
  CASE WHEN others >= 2 AND rank % 5 > 0 THEN {rnd(clip('120e0 * semantic_similarity - 5e0', '0e0', '100e0'), 4)} END AS second_pass_score,
  {rnd(clip('target_score', '0e0', '100e0'), 4)} AS effective_score FROM v_rows r JOIN o ON r.query = o.query""")
def second_pass_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows")
    context = rows.groupBy("query").agg((F.count(F.lit(1)) - 1).alias("serp_relative_context_count"))
    prepared = rows.join(context, "query").select(
        "*",
        F.when(F.col("serp_relative_context_count") > 0, 1).otherwise(0).alias("serp_relative_context_available"),
        F.when(F.col("rank") % 5 > 0, F.lit(120.0) * F.col("semantic_similarity") - 5.0).alias("candidate"),
    )
    return relevance.second_pass_score(prepared, "target_score", "candidate").select(
        "query", "url", "second_pass_status", "second_pass_reason", "second_pass_score", "effective_score"
    )


@CATALOG.query("compare_sites", _SCORED_SQL + f""", o AS (SELECT CASE WHEN rank = 1 THEN 'user' ELSE 'competitor' END AS side, final FROM s5),
o2 AS (SELECT {rnd(mean('final', 4, "side = 'user'"), 4)} AS u, {rnd(mean('final', 4, "side = 'competitor'"), 4)} AS c FROM o)
SELECT u AS user_average_score, c AS competitor_average_score, {rnd(clip('u - c', '0e0', '100e0'), 4)} AS score_difference FROM o2""")
def compare_sites(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scored(spark, folder).select(F.when(F.col("rank") == 1, "user").otherwise("competitor").alias("side"), F.col("final_score").alias("score"))
    return peers.compare_sites(scored)

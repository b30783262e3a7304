"""Recommendation queries: the best-ranked page of a query is audited against its other pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import peers, recommend, run_views
from rankloom.plans import history_queries as hq
from rankloom.plans import relevance_queries as rq
from rankloom.plans.oracle_text import big, rnd
from rankloom.plans.peer_queries import _TARGET_ORACLE, _CHAIN, _QUALITY
from rankloom.plans.peer_queries import context_quality as quality_query
from rankloom.plans.registry import Catalog
from rankloom.session import stored
from rankloom.sources.views import FEATURES, load_dealt, load_view

CATALOG = Catalog()

_KNOWN = set(FEATURES)
_HAVE = [m for m, spec in recommend.METRICS.items() if spec[3] is None and m in _KNOWN]
_RELATIVE = [m for m, spec in recommend.METRICS.items() if spec[3] is not None]


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Every query's best-ranked page with the benchmark of its other pages, from rows that are dealt by query before they are measured."""
    rows = load_dealt(spark, folder, "v_rows", "query")
    dealt = rows is not None
    rows = (rows if dealt else load_view(spark, folder, "v_rows")).withColumn("audit_id", F.col("query"))
    if dealt:
        joined = rows.withColumn("own_url", F.min(F.struct("rank", "url")).over(Window.partitionBy("audit_id"))["url"])
    else:
        lead = rows.groupBy("audit_id").agg(F.min_by("url", F.struct("rank", "url")).alias("own_url"))
        joined = stored(rows.join(lead, "audit_id"))  # the view is read once, what follows reads some of its columns
    own, others = joined.filter(F.col("url") == F.col("own_url")), joined.filter(F.col("url") != F.col("own_url"))
    relative = peers.serp_relative_target(own, others, dealt).select("audit_id", "serp_relative_context_available", *_RELATIVE)
    pages = own.join(relative, "audit_id").withColumn("page_score", F.col("target_score"))
    return recommend.prepare(pages, recommend.benchmark_columns(others, "audit_id", "target_score", dealt), "audit_id")


_HEAD, _TAIL = _TARGET_ORACLE.split("\nSELECT query AS audit_id", 1)
_BASE = _HEAD + ",\nrel AS (SELECT query AS audit_id" + _TAIL + ")," + rq.TM_SQL + f""",
ow AS (SELECT t3.*, target_score AS page_score, high AND kw >= 99e-2 AS sure, rel.* EXCLUDE (audit_id) FROM t3 JOIN o_own o ON t3.query = o.query AND t3.url = o.own_url JOIN rel ON rel.audit_id = t3.query),
bn AS (SELECT v.query, count(*) AS pc, CASE WHEN count(*) >= 2 THEN avg(target_score) END AS ca, {', '.join(f"CASE WHEN count(*) >= 2 THEN quantile_cont(CAST({m} AS DOUBLE), {'75e-2' if recommend.METRICS[m][0] == 'up' else '25e-2'}) END AS b_{m}" for m in _HAVE)}
  FROM v_rows v JOIN o_own o ON v.query = o.query AND v.url <> o.own_url GROUP BY v.query),
pp AS (SELECT ow.*, coalesce(pc, 0) AS pc, ca, {', '.join(f'b_{m}' for m in _HAVE)} FROM ow LEFT JOIN bn ON ow.query = bn.query)"""

_B = lambda m: f"coalesce(b_{m}, 0e0)"
_SOFT = "CASE WHEN sure THEN 'medium' ELSE 'high' END"
_REL = "serp_relative_context_available = 1"
_RULES = {
    "LOW_PAGE_SCORE": ("page_score < 45", "'high'"), "BELOW_COMPETITORS": ("page_score >= 45 AND ca > 0 AND page_score < ca - 7", "'high'"),
    "SLIGHTLY_BELOW_COMPETITORS": ("page_score >= 45 AND ca > 0 AND page_score >= ca - 7 AND page_score < ca", "'medium'"), "MISSING_TITLE": ("title_present = 0", "'high'"),
    "QUERY_NOT_IN_TITLE": ("title_present <> 0 AND query_in_title = 0", _SOFT), "MISSING_META_DESCRIPTION": ("meta_description_present = 0", "'medium'"), "MISSING_H1": ("h1_count = 0", "'high'"), "MULTIPLE_H1": ("h1_count > 1", "'medium'"),
    "QUERY_NOT_IN_TEXT": ("query_in_text = 0", _SOFT), "LOW_KEYWORD_COVERAGE": ("query_in_text <> 0 AND keyword_coverage_ratio < 5e-1", "'medium'"), "LOW_SEMANTIC_RELEVANCE": ("semantic_similarity < 45e-2 AND NOT fit", "'high'"),
    "THIN_CONTENT": ("text_length_chars < 1200", "'medium'"), "CONTENT_SHORTER_THAN_COMPETITORS": (f"text_length_chars >= 1200 AND {_B('text_length_chars')} > 0 AND text_length_chars < {_B('text_length_chars')} * 75e-2", "'medium'"),
    "LOW_TEXT_TO_HTML_RATIO": ("text_to_html_ratio < 12e-2", "'medium'"), "FEW_LINKS": (f"{_B('link_count')} > 0 AND link_count < {_B('link_count')} * 6e-1", "'low'"), "NO_IMAGES": (f"image_count = 0 AND {_B('image_count')} >= 1", "'low'"),
    "TECHNICAL_INDEXING_BLOCK": ("page_indexable = 0", "'high'"), "TECHNICAL_CANONICAL_MISMATCH": ("canonical_present = 1 AND canonical_matches_final_url = 0", "'high'"),
    "TECHNICAL_MISSING_CANONICAL": (f"canonical_present = 0 AND {_B('canonical_present')} >= 7e-1", "'medium'"), "TECHNICAL_REDIRECT_CHAIN": ("redirect_count >= 2", "'high'"), "TECHNICAL_REDIRECTED_TARGET": ("redirect_count = 1", "'medium'"),
    "TECHNICAL_MISSING_VIEWPORT": ("viewport_present = 0", "'medium'"), "TECHNICAL_MISSING_LANG": ("lang_present = 0", "'medium'"),
    "COMMERCIAL_MISSING_PHONE": ("phone_present = 0 AND (pc >= 2 OR contact_options_score < 4e-1)", f"CASE WHEN {_B('phone_present')} >= 4e-1 THEN 'high' ELSE 'medium' END"),
    "COMMERCIAL_MISSING_ADDRESS": (f"address_present = 0 AND ({_B('address_present')} >= 3e-1 OR trust_signals_score < 45e-2)", "'medium'"), "COMMERCIAL_MISSING_BUSINESS_HOURS": (f"business_hours_present = 0 AND {_B('business_hours_present')} >= 3e-1", "'medium'"),
    "COMMERCIAL_MISSING_PRICE_SIGNAL": (f"price_present = 0 AND {_B('price_present')} >= 4e-1", "'medium'"), "COMMERCIAL_MISSING_DELIVERY_INFO": (f"delivery_info_present = 0 AND {_B('delivery_info_present')} >= 4e-1", "'medium'"),
    "COMMERCIAL_MISSING_PAYMENT_INFO": (f"payment_info_present = 0 AND {_B('payment_info_present')} >= 4e-1", "'medium'"), "COMMERCIAL_WEAK_CTA": ("cta_present = 0", "'medium'"),
    "COMMERCIAL_WEAK_VALUE_PROPOSITION": (f"value_proposition_present = 0 AND {_B('value_proposition_present')} >= 4e-1", "'medium'"), "TRUST_WEAK_CONTACT_BLOCK": ("contact_options_score < 4e-1", "'high'"),
    "TRUST_MISSING_BUSINESS_ID": (f"legal_requisites_present = 0 AND (company_identity_present = 0 OR {_B('legal_requisites_present')} >= 3e-1)", "'medium'"),
    "TRUST_MISSING_SOCIAL_PROOF": (f"reviews_present = 0 AND rating_present = 0 AND ({_B('reviews_present')} >= 4e-1 OR {_B('rating_present')} >= 4e-1)", "'medium'"),
    "INTENT_WEAK_LOCAL_ALIGNMENT": ("intent_is_local_commercial = 1 AND local_intent_alignment < 55e-2", "'high'"), "INTENT_WEAK_COMMERCIAL_ALIGNMENT": ("intent_is_commercial = 1 AND commercial_intent_alignment < 55e-2", "'high'"),
    "INTENT_WEAK_INFORMATIONAL_ALIGNMENT": ("intent_is_informational = 1 AND informational_intent_alignment < 55e-2", "'medium'"),
    "RELATIVE_SERP_GAP": (f"{_REL} AND (serp_relative_percentile < 35e-2 OR serp_relative_gap_score < 55e-2)", "'high'"), "RELATIVE_SEMANTIC_GAP": (f"{_REL} AND relative_gap_to_top_semantic_relevance < -12e-2 AND NOT fit", "'high'"),
    "RELATIVE_TECHNICAL_GAP": (f"{_REL} AND relative_gap_to_top_technical_seo < -12e-2", "'medium'"), "RELATIVE_COMMERCIAL_TRUST_GAP": (f"{_REL} AND relative_gap_to_top_commercial_trust < -12e-2", "'high'"),
    "RELATIVE_INTENT_ALIGNMENT_GAP": (f"{_REL} AND relative_gap_to_top_intent_alignment < -12e-2", "CASE WHEN sure AND relative_gap_to_top_intent_alignment >= -22e-2 THEN 'medium' ELSE 'high' END"),
}
_DRAFTS = _BASE + ", dr0 AS (" + " UNION ALL ".join(f"SELECT query AS audit_id, '{c}' AS code, {p} AS base_priority FROM pp WHERE {w}" for c, (w, p) in _RULES.items()) + """),
dr AS (SELECT * FROM dr0 UNION ALL SELECT query, 'NO_CRITICAL_ISSUES', 'low' FROM pp WHERE query NOT IN (SELECT audit_id FROM dr0))"""


@CATALOG.query("recommendation_rules", _DRAFTS + " SELECT * FROM dr")
def recommendation_rules(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendation_rules(prepared(spark, folder), "audit_id")


def _gap_row(metric: str) -> str:
    if metric == "page_score":
        return "SELECT query AS audit_id, 'page_score' AS metric, page_score AS cur, ca AS bench, ca - page_score AS gap, 5e-2 AS tol, 1e0 AS sc FROM pp"
    direction, tolerance, smallest, target = recommend.METRICS[metric]
    bench = f"CAST({target} AS DOUBLE)" if target is not None else f"b_{metric}"
    gap = f"{bench} - {metric}" if direction == "up" else f"{metric} - {bench}"
    return f"SELECT query, '{metric}', CAST({metric} AS DOUBLE), {bench}, {gap}, CAST({tolerance} AS DOUBLE), CAST({smallest} AS DOUBLE) FROM pp"


_WEIGHTS = ", ".join(f"('{m}', CAST({recommend.IMPORTANCE.get(m, 0.5)} AS DOUBLE), CAST({recommend.CONTROLLABILITY.get(m, 0.65)} AS DOUBLE))" for m in (*recommend.METRICS, "page_score", "competitors_average_score"))
_TEMPLATE_ROWS = ", ".join(f"('{c}', '{g}', '{m}')" for c, (g, ms) in recommend.TEMPLATES.items() for m in ms)
_ASSESSED = _DRAFTS + f""",
wt AS (SELECT * FROM (VALUES {_WEIGHTS}) w(metric, imp, ctl)), tp AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) t(code, grp, metric)),
g0 AS ({' UNION ALL '.join(_gap_row(m) for m in ('page_score', *_HAVE, *_RELATIVE))}),
g00 AS (SELECT * REPLACE ({rnd('gap', 9)} AS gap) FROM g0),
g1 AS (SELECT g00.*, imp, ctl, greatest(gap / greatest(abs(bench), sc), 0e0) AS ratio FROM g00 JOIN wt USING (metric) WHERE gap > tol),
g2 AS (SELECT *, {rnd('least(1e2, least(ratio, 1e0) * (imp * 72e-2 + ctl * 28e-2) * 1e2)', 4)} AS score FROM g1),
g3 AS (SELECT *, CASE WHEN score >= 42 OR (imp >= 85e-2 AND ctl >= 65e-2 AND ratio >= 35e-2) THEN 0 WHEN score >= 18 OR (imp >= 7e-1 AND ctl >= 55e-2 AND ratio >= 18e-2) THEN 1 ELSE 2 END AS r0 FROM g2),
g4 AS (SELECT *, CASE WHEN r0 = 0 AND imp < 55e-2 THEN 1 WHEN r0 = 1 AND imp < 4e-1 THEN 2 ELSE r0 END AS rk FROM g3)"""
_CRITICAL = ", ".join(f"'{c}'" for c in recommend.CRITICAL_CODES)
_ITEMS = _ASSESSED + f""",
ti AS (SELECT code, any_value(grp) AS grp, max(imp) AS imp FROM tp JOIN wt USING (metric) GROUP BY code),
d1 AS (SELECT dr.*, grp, imp, CASE WHEN sure AND (code IN ('QUERY_NOT_IN_TITLE', 'QUERY_NOT_IN_TEXT') OR (code = 'RELATIVE_INTENT_ALIGNMENT_GAP' AND relative_gap_to_top_intent_alignment >= -22e-2)) THEN 1 ELSE 0 END AS held FROM dr JOIN ti USING (code) JOIN pp ON pp.query = dr.audit_id),
d2 AS (SELECT *, CASE CASE WHEN code IN ({_CRITICAL}) AND held = 0 THEN 'high' ELSE base_priority END WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS r0 FROM d1),
d3 AS (SELECT *, CASE WHEN r0 = 0 AND imp < 55e-2 THEN 1 WHEN r0 = 1 AND imp < 4e-1 THEN 2 ELSE r0 END AS br FROM d2),
d4 AS (SELECT *, {rnd(f"least(1e2, greatest(CASE br WHEN 0 THEN 78e0 WHEN 1 THEN 46e0 ELSE 18e0 END, CASE WHEN code IN ({_CRITICAL}) THEN 86e0 ELSE 0e0 END) * (imp * 7e-1 + 3e-1))", 4)} AS bs FROM d3),
gm AS (SELECT audit_id, code, min(rk) AS rk, arg_min(score, (rk, -score)) AS gs, arg_min(ratio, (rk, -score)) AS gr FROM g4 JOIN tp USING (metric) GROUP BY audit_id, code),
d5 AS (SELECT d4.*, coalesce(gm.rk < br OR (gm.rk = br AND gs >= bs), FALSE) AS byg, gm.rk, gs, gr FROM d4 LEFT JOIN gm USING (audit_id, code)),
d6 AS (SELECT audit_id, code, grp, held, CASE WHEN byg THEN rk ELSE br END AS rank, CASE WHEN byg THEN gs ELSE bs END AS score, CASE WHEN byg THEN {rnd('gr', 4)} END AS gap_ratio FROM d5),
im AS (SELECT audit_id, code, grp, CASE CASE WHEN held = 1 AND rank <= 1 THEN 1 ELSE rank END WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN held = 1 AND rank <= 1 THEN {rnd('least(score, 419999e-4)', 4)} ELSE score END AS priority_score, gap_ratio FROM d6)"""


def items(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendation_priority(prepared(spark, folder), "audit_id")


@CATALOG.query("recommendation_priority", _ITEMS + " SELECT * FROM im")
def recommendation_priority(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder)


_DEV_ROWS = ", ".join(f"('{g}', '{m}')" for g, ms in recommend.DEVIATION_METRICS.items() for m in ms)


@CATALOG.query("metric_deviations", _ASSESSED + f""", dm AS (SELECT * FROM (VALUES {_DEV_ROWS}) d(grp, metric)), dv AS (SELECT audit_id, grp, metric, {rnd('cur', 4)} AS current_value, {rnd('bench', 4)} AS benchmark_value, {rnd('gap', 4)} AS gap, rk, score AS priority_score,
  row_number() OVER (PARTITION BY audit_id, grp ORDER BY rk, score DESC, {rnd('gap', 4)} DESC, metric) AS place FROM g4 JOIN dm USING (metric))
SELECT audit_id, grp, CAST(place AS INT) AS place, metric, current_value, benchmark_value, gap, CASE rk WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, priority_score FROM dv WHERE place <= 8""")
def metric_deviations(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.metric_deviations(prepared(spark, folder), "audit_id")


_COUNTS = f"{big('count(*)')} AS total, " + ", ".join(f"{big(f'''count(*) FILTER (priority = '{p}')''')} AS {p}_count" for p in recommend.PRIORITIES)
_STATUS = "CASE min(CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'attention' ELSE 'monitor' END AS status"


@CATALOG.query("recommendation_groups", _ITEMS + f" SELECT audit_id, grp, {_COUNTS}, 1 AS groups_with_issues, {_STATUS} FROM im GROUP BY audit_id, grp UNION ALL SELECT audit_id, 'all', {_COUNTS}, CAST(count(DISTINCT grp) AS INT), {_STATUS} FROM im GROUP BY audit_id")
def recommendation_groups(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.recommendation_groups(items(spark, folder), "audit_id")


_ORDER = "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CASE grp WHEN 'technical_seo' THEN 0 WHEN 'commercial_trust' THEN 1 WHEN 'semantic_intent' THEN 2 ELSE 3 END, code"


@CATALOG.query("top_recommendations", _ITEMS + f", r AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY {_ORDER}) AS place FROM im) SELECT audit_id, CAST(place AS INT) AS place, code, grp, priority FROM r WHERE place <= 3")
def top_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return recommend.top_recommendations(items(spark, folder), "audit_id").select("audit_id", "place", "code", "grp", "priority")


_ACTION = "CASE (CAST(audit_id AS INT) + length(code)) % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'ignored' WHEN 2 THEN 'in_progress' ELSE '' END"


@CATALOG.query("action_progress", _ITEMS + f""", s AS (SELECT audit_id, grp, CASE WHEN {_ACTION} = '' THEN 'not_started' ELSE {_ACTION} END AS st FROM im),
t AS (SELECT audit_id, grp, st FROM s UNION ALL SELECT audit_id, 'all', st FROM s) SELECT audit_id, grp, {big('count(*)')} AS total, {', '.join(big(f"count(*) FILTER (st = '{x}')") + f' AS {x}' for x in ('not_started', 'in_progress', 'fixed', 'ignored'))},
  {big("count(*) FILTER (st IN ('fixed', 'ignored'))")} AS closed, {big("floor(count(*) FILTER (st IN ('fixed', 'ignored')) * 1e0 / count(*) * 100 + 5e-1)")} AS progress_percent FROM t GROUP BY audit_id, grp""")
def action_progress(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(items(spark, folder))  # read as actions and as their states
    states = rows.select("audit_id", "grp", "code", F.expr(_ACTION).alias("status")).filter(F.col("status") != "")
    return recommend.action_progress(rows, states, "audit_id")


@CATALOG.query("completion_warnings", _CHAIN + "," + _QUALITY + """ SELECT q.audit_id, CASE WHEN competitors_found > 0 AND competitors_failed > 0 AND NOT (status = 'ready' OR coalesce(competitors_analyzed >= requested_top_n, FALSE)) THEN 'competitor_pages_restricted_access' ELSE '' END
  || CASE WHEN competitors_found > 0 AND competitors_failed > 0 AND NOT (status = 'ready' OR coalesce(competitors_analyzed >= requested_top_n, FALSE)) AND competitors_analyzed < 2 THEN ',' ELSE '' END
  || CASE WHEN competitors_analyzed < 2 THEN 'not_enough_competitors_processed' ELSE '' END AS warnings, CAST(coalesce(requested_top_n, competitors_found) AS INT) AS expected_count FROM o_quality q JOIN v_targets t ON q.audit_id = t.audit_id""")
def completion_warnings(spark: SparkSession, folder: str) -> DataFrame:
    wanted = load_view(spark, folder, "v_targets").select("audit_id", "requested_top_n")
    summary = quality_query(spark, folder).withColumnRenamed("status", "competitor_context_status").join(wanted, "audit_id")
    return recommend.completion_warnings(summary).select("audit_id", F.concat_ws(",", "warnings").alias("warnings"), "expected_count")


# --- run views ----------------------------------------------------------------
_JSON_B = (
    "CONCAT('{\"final_score\":', CAST(id % 100 AS STRING), ',\"relevance_guardrail\":{\"early_stop\":', CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END, "
    "CASE WHEN id % 4 = 0 THEN ',\"reason\":\"guard\"' ELSE '' END, CASE WHEN id % 5 = 0 THEN ',\"band_max\":7.5' ELSE '' END, CASE WHEN id % 7 = 0 THEN ',\"band_min\":1.5' ELSE '' END, "
    "CASE WHEN id % 2 = 0 THEN ',\"early_stop_decision\":{\"reason\":\"decided\",\"score_ceiling\":4.5,\"safe_to_skip_competitors\":true}' ELSE '' END, '}}')"
)
_JSON_C = "CASE WHEN id % 6 = 0 THEN '{\"score_basis\":\"primary\",\"final_score\":3.25,\"relevance_guardrail\":{\"status\":\"stopped\",\"score_ceiling\":6.5}}' ELSE CAST(NULL AS STRING) END"


@CATALOG.query("early_stop_summary", hq._AUD + f""" SELECT id, CASE WHEN id % 2 = 0 THEN 'decided' WHEN id % 4 = 0 THEN 'guard' ELSE 'query_relevance_early_stop' END AS reason, CASE WHEN id % 6 = 0 THEN 'stopped' ELSE 'completed' END AS stop_status,
  {rnd('coalesce(score, id % 100)', 4)} AS score, CASE WHEN id % 7 = 0 THEN 15e-1 ELSE 0e0 END AS score_floor, CASE WHEN id % 2 = 0 THEN 45e-1 WHEN id % 5 = 0 THEN 75e-1 WHEN id % 6 = 0 THEN 65e-1 ELSE 5e0 END AS score_ceiling,
  CASE WHEN id % 6 = 0 THEN 'primary' ELSE 'query_relevance_early_stop' END AS score_basis, id % 2 = 0 AS safe_to_skip_competitors, 6 AS skipped_stages FROM au WHERE id % 3 = 0""")
def early_stop_summary(spark: SparkSession, folder: str) -> DataFrame:
    audits = hq._audits(spark, folder).select("id", "score", F.expr(_JSON_B).alias("score_breakdown"), F.expr(_JSON_C).alias("comparison_summary"))
    return run_views.early_stop_summary(audits)


_RUN = {
    "id": "id", "status": "CASE WHEN id % 41 = 0 THEN CAST(NULL AS STRING) ELSE status END", "final_score": "score", "score_gap": "CASE WHEN id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(id % 23 AS DOUBLE) - 12 END",
    "http_status": "CASE id % 13 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN CAST(NULL AS INT) ELSE 200 END", "target_fetch_status": "CASE id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN CAST(NULL AS STRING) ELSE 'success' END",
    "target_fetch_method": "CASE id % 4 WHEN 0 THEN 'browser' WHEN 1 THEN 'http_retry' ELSE 'http' END", "failure_stage": "CASE WHEN id % 37 = 0 THEN 'fetch' ELSE CAST(NULL AS STRING) END", "http_status_ok": "CASE WHEN id % 29 = 0 THEN 0 ELSE 1 END",
    "page_indexable": "CASE WHEN id % 17 = 0 THEN 0 ELSE 1 END", "robots_noindex": "CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END", "guardrail_reason": "CASE id % 14 WHEN 0 THEN 'page_unusable' WHEN 1 THEN 'probable_query_topic_mismatch' ELSE CAST(NULL AS STRING) END",
    "guardrail_band": "CASE id % 15 WHEN 0 THEN 'full_mismatch' WHEN 1 THEN 'weak_match' ELSE CAST(NULL AS STRING) END", "early_stop": "id % 31 = 0", "word_count": "id % 200", "text_length_chars": "(id % 200) * 6", "recommendation_count": "id % 4",
    "groups_with_issues": "id % 2", "negative_factors": "CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END", "feature_schema": "CASE WHEN id % 12 = 0 THEN CAST(NULL AS STRING) ELSE 'v3' END", "has_heavy_analysis": "id % 9 > 0", "has_model_info": "id % 8 > 0",
    "has_breakdown": "id % 16 > 0", "competitors_analyzed": "analyzed_summary", "competitors_failed": "failed_summary", "coverage_ratio": "CASE WHEN found_summary > 0 THEN analyzed_summary * 1e0 / found_summary END",
    "warning_messages": "warning_messages", "has_failure": "status = 'failed' AND id % 2 = 0",
}
_RUN_SQL = hq._AUD + ", ru AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RUN.items()) + " FROM au)"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return hq._audits(spark, folder).select(*[F.expr(e).alias(n) for n, e in _RUN.items()])


@CATALOG.query("low_score_reason", _RUN_SQL + """, k AS (SELECT id, CASE WHEN http_status = 404 THEN 'http_404' WHEN http_status >= 400 OR target_fetch_status = 'failed' OR failure_stage = 'fetch' OR http_status_ok = 0 THEN 'http_error' WHEN page_indexable = 0 OR robots_noindex = 1 THEN 'noindex'
  WHEN guardrail_reason = 'page_unusable' OR (word_count < 20 AND text_length_chars < 200) THEN 'unusable' WHEN final_score >= 80 THEN 'unknown' WHEN early_stop OR guardrail_reason = 'probable_query_topic_mismatch' OR guardrail_band = 'full_mismatch' THEN 'query_mismatch'
  WHEN final_score < 80 AND score_gap <= -5 THEN 'competitor_gap' WHEN final_score < 80 AND (recommendation_count > 0 OR groups_with_issues > 0 OR negative_factors > 0) THEN 'seo_gaps' ELSE 'unknown' END AS kind FROM ru)
SELECT id, kind, CASE WHEN kind IN ('http_404', 'http_error', 'noindex', 'unusable') THEN 'page_unavailable' ELSE kind END AS category, CASE WHEN kind IN ('http_404', 'http_error', 'noindex', 'unusable') THEN 'error' WHEN kind = 'query_mismatch' THEN 'warning' WHEN kind = 'unknown' THEN 'neutral' ELSE 'info' END AS tone FROM k""")
def low_score_reason(spark: SparkSession, folder: str) -> DataFrame:
    return run_views.low_score_reason(_runs(spark, folder)).select("id", "kind", "category", "tone")


_DONE = "coalesce(status IN ('completed', 'completed_with_warnings'), FALSE)"
_COVERED = f"({_DONE} AND coalesce(competitors_analyzed, 0) >= 1)"
_ERRORS = ["status = 'failed'", "target_fetch_status = 'failed'", f"final_score IS NULL AND ({_DONE} OR status = 'failed')", "has_failure"]
_WARNS = [
    "status = 'completed_with_warnings'", "target_fetch_status = 'success' AND target_fetch_method IN ('browser', 'http_retry')", f"target_fetch_status IS NULL AND {_DONE}", f"feature_schema IS NULL AND {_DONE}", f"NOT has_heavy_analysis AND {_DONE}",
    "final_score IS NOT NULL AND NOT has_model_info", f"{_DONE} AND NOT {_COVERED}", f"{_COVERED} AND coverage_ratio < 5e-1", f"{_COVERED} AND competitors_failed > 0", f"recommendation_count = 0 AND {_DONE}",
]
_OKS = ["status = 'completed'", "target_fetch_status = 'success' AND target_fetch_method = 'http'", "feature_schema IS NOT NULL", "has_heavy_analysis", "final_score IS NOT NULL", "final_score IS NOT NULL AND has_model_info", _COVERED, "recommendation_count > 0"]
_TALLY = lambda conditions: " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)


@CATALOG.query("score_confidence", _RUN_SQL + f""", t AS (SELECT *, {_TALLY(_ERRORS)} AS e, {_TALLY(_WARNS)} + CAST(warning_messages AS INT) AS w, {_TALLY(_OKS)} AS o FROM ru)
SELECT id, CASE WHEN status IS NULL OR status IN ('queued', 'processing') THEN 'unknown' WHEN e > 0 THEN 'low' WHEN final_score IS NULL THEN 'unknown' WHEN w > 0 THEN 'medium' ELSE 'high' END AS level, CAST(e AS INT) AS error_count, CAST(w AS INT) AS warning_count, CAST(o AS INT) AS passed_count FROM t""")
def score_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return run_views.score_confidence(_runs(spark, folder)).select("id", "level", "error_count", "warning_count", "passed_count")

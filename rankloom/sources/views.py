"""Views that give the test tables the shapes the operators work on.

Each view is one SELECT that Spark and the oracle engine both understand, so
the two sides start from the same rows. Only projections and equi joins are
used here; every computation under test lives in the operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.order import OWN, large_keys
from rankloom.sources.tables import read_table, spread

_TABLE = re.compile(r"\{(\w+)\}")


def _mix(a: int, b: int, c: int, modulus: int) -> str:
    return f"((l_orderkey * {a} + l_linenumber * {b} + l_suppkey * {c} + l_partkey * 3) % {modulus})"


def _unit(a: int, b: int, c: int) -> str:
    return f"{_mix(a, b, c, 101)} / 1e2"


def _bit(a: int, b: int, c: int, modulus: int = 2) -> str:
    return f"CASE WHEN {_mix(a, b, c, modulus)} = 0 THEN 0 ELSE 1 END"


_LINE_JOIN = (
    "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey "
    "JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"
)

_ROW_BASE = {
    "query": "CAST(l_partkey AS STRING)",
    "category": "p_brand",
    "city": "n_name",
    "intent": "lower(p_type)",
    "url": "CONCAT('https://s', CAST(l_suppkey AS STRING), '.example.com/', CAST(l_orderkey AS STRING), '/', "
    "CAST(l_linenumber AS STRING), '-', CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS STRING))",
    "domain": "CONCAT('s', CAST(l_suppkey AS STRING), '.example.com')",
    "title": "CONCAT(p_name, CASE WHEN l_linenumber = 3 THEN ' market' ELSE '' END)",
    "snippet": "CONCAT(p_name, ' ', p_type)",
    "rank": f"CAST(1 + {_mix(7, 1, 0, 40)} AS INT)",
    "serp_page": f"CAST(floor({_mix(7, 1, 0, 40)} / 1e1) AS INT)",
    "fetch_status": "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END",
    "fetch_error_code": "CASE WHEN l_returnflag <> 'R' THEN CAST(NULL AS STRING) "
    "WHEN l_linenumber = 1 THEN 'http_403' WHEN l_linenumber = 2 THEN 'browser_timeout' "
    "WHEN l_linenumber = 3 THEN 'empty_content' WHEN l_linenumber = 4 THEN '' ELSE 'network_error' END",
    "target_score": "l_quantity + (l_discount + 0e0) * 5e2",
}

_ROW_FEATURES = {
    "keyword_coverage_ratio": "l_quantity / 5e1",
    "semantic_similarity": "(l_discount + 0e0) * 1e1",
    "technical_seo_score": "(l_tax + 0e0) * 12.5e0",
    "query_prominence_score": f"{_mix(3, 5, 1, 101)} / 1e2 * (1e0 - (l_linenumber % 3) * 4e-1)",
    "title_heading_keyword_alignment": _unit(5, 7, 2),
    "early_query_coverage_ratio": _unit(11, 3, 1),
    "query_semantic_alignment": _unit(2, 9, 3),
    "title_semantic_alignment": f"{_mix(13, 1, 2, 101)} / 1e2 * (1e0 - (l_orderkey % 3) * 48e-2)",
    "heading_semantic_alignment": f"{_mix(6, 11, 1, 101)} / 1e2 * (1e0 - (l_orderkey % 3) * 48e-2)",
    "content_depth_semantic_score": _unit(9, 4, 5),
    "semantic_content_richness": _unit(4, 13, 7),
    "conversion_signal_score": f"{_mix(1, 3, 1, 5)} / 4e0",
    "technical_metadata_score": f"{_mix(2, 1, 1, 3)} / 2e0",
    "canonical_signal_score": "CASE WHEN l_linenumber % 4 = 0 THEN 0e0 WHEN l_linenumber % 4 = 1 THEN 35e-2 "
    "WHEN l_linenumber % 4 = 2 THEN 75e-2 ELSE 1e0 END",
    "url_hygiene_score": _unit(8, 3, 9),
    "commercial_trust_score": _unit(10, 9, 1),
    "commercial_signals_score": f"{_mix(5, 2, 3, 10)} / 9e0",
    "trust_signals_score": f"{_mix(7, 4, 1, 10)} / 9e0",
    "contact_options_score": f"{_mix(3, 8, 5, 6)} / 5e0",
    "intent_alignment_score": _unit(12, 5, 7),
    "commercial_intent_alignment": _unit(14, 3, 1),
    "local_intent_alignment": _unit(15, 1, 4),
    "informational_intent_alignment": _unit(16, 9, 2),
    "navigational_intent_alignment": _unit(17, 2, 8),
    "title_keyword_coverage_ratio": _unit(18, 7, 3),
    "meta_keyword_coverage_ratio": _unit(19, 4, 1),
    "heading_query_coverage_ratio": _unit(20, 1, 6),
    "query_density": f"{_mix(21, 3, 2, 90)} / 1e4",
    "unique_word_ratio": _unit(22, 5, 3),
    "text_to_html_ratio": f"{_mix(23, 2, 1, 70)} / 1e2",
    "keyword_balance_score": _unit(24, 6, 1),
    "cta_semantic_score": _unit(25, 1, 9),
    "title_length_quality": _unit(26, 3, 4),
    "meta_length_quality": _unit(27, 8, 2),
    "query_core_keyword_coverage_ratio": f"CASE WHEN l_linenumber = 5 THEN CAST(NULL AS DOUBLE) ELSE {_mix(28, 5, 1, 5)} / 4e0 END",
    "query_intent_modifier_coverage_ratio": f"{_mix(29, 1, 2, 3)} / 2e0",
    "query_geo_modifier_coverage_ratio": f"{_mix(30, 2, 7, 3)} / 2e0",
    "mobile_optimization_score": _unit(31, 1, 3),
    "structured_data_quality_score": _unit(32, 4, 5),
    "rendering_quality_score": _unit(33, 2, 6),
    "performance_resource_complexity_score": _unit(34, 6, 3),
    "heavy_analysis_composite_score": _unit(35, 3, 2),
    "redirect_efficiency_score": f"{_mix(36, 1, 1, 4)} / 3e0",
    "word_count": "l_quantity * 4e1",
    "text_length_chars": "l_quantity * 2.5e2",
    "sentence_count": f"CAST({_mix(37, 2, 3, 80)} AS DOUBLE)",
    "paragraph_count": f"CAST({_mix(38, 5, 1, 40)} AS DOUBLE)",
    "value_proposition_present": _bit(61, 3, 1, 3),
    "intent_is_commercial": "CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END",
    "intent_is_local_commercial": "CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END",
    "intent_is_informational": "CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END",
    "redirect_count": f"CAST({_mix(36, 1, 1, 4)} AS DOUBLE)",
    "heading_count": f"CAST({_mix(39, 1, 4, 12)} AS DOUBLE)",
    "h1_count": f"CAST({_mix(40, 3, 1, 3)} AS DOUBLE)",
    "link_count": f"CAST({_mix(41, 7, 2, 120)} AS DOUBLE)",
    "image_count": f"CAST({_mix(42, 4, 3, 15)} AS DOUBLE)",
    "exact_query_count": f"CASE WHEN {_mix(43, 5, 1, 9)} < 6 THEN 0e0 ELSE CAST({_mix(43, 5, 1, 9)} AS DOUBLE) END",
    "query_term_count": f"CAST({_mix(44, 1, 2, 60)} AS DOUBLE)",
    "query_terms_in_headings": f"CAST({_mix(45, 2, 1, 7)} AS DOUBLE)",
    "first_200_words_query_term_count": f"CAST({_mix(46, 9, 4, 12)} AS DOUBLE)",
    "title_query_term_count": f"CAST({_mix(47, 3, 8, 5)} AS DOUBLE)",
    "meta_query_term_count": f"CAST({_mix(48, 6, 1, 5)} AS DOUBLE)",
    "query_core_phrase_count": f"CAST({_mix(49, 1, 5, 4)} AS DOUBLE)",
    "query_core_term_count": f"CASE WHEN l_linenumber = 2 THEN CAST(NULL AS DOUBLE) ELSE CAST({_mix(50, 4, 1, 6)} AS DOUBLE) END",
    "title_length": f"CAST({_mix(51, 3, 2, 110)} AS DOUBLE)",
    "meta_description_length": f"CAST({_mix(52, 5, 4, 240)} AS DOUBLE)",
    "http_status_code": "CASE WHEN l_linenumber = 7 AND l_suppkey % 3 = 0 THEN 404 WHEN l_linenumber = 6 AND l_suppkey % 5 = 0 THEN 503 ELSE 200 END",
    "http_status_ok": "CASE WHEN (l_linenumber = 7 AND l_suppkey % 3 = 0) OR (l_linenumber = 6 AND l_suppkey % 5 = 0) THEN 0 ELSE 1 END",
    "robots_noindex": f"CASE WHEN {_mix(1, 5, 3, 17)} = 0 THEN 1 ELSE 0 END",
    "page_indexable": f"CASE WHEN {_mix(1, 5, 3, 17)} = 0 THEN 0 ELSE 1 END",
    "title_present": _bit(3, 1, 5, 9),
    "meta_description_present": _bit(5, 2, 1, 4),
    "query_in_title": f"CASE WHEN {_mix(7, 3, 1, 5)} = 0 THEN 1 ELSE 0 END",
    "query_in_text": f"CASE WHEN {_mix(9, 1, 3, 4)} = 0 THEN 1 ELSE 0 END",
    "viewport_present": _bit(11, 4, 1, 5),
    "lang_present": _bit(13, 1, 7, 6),
    "canonical_present": _bit(15, 2, 3, 3),
    "canonical_matches_final_url": _bit(17, 1, 1, 4),
    "phone_present": _bit(19, 5, 2),
    "email_present": _bit(21, 1, 3, 3),
    "address_present": _bit(23, 2, 5),
    "business_hours_present": _bit(25, 3, 1, 3),
    "price_present": _bit(27, 1, 2),
    "faq_present": _bit(29, 4, 3, 3),
    "cta_present": _bit(31, 2, 1, 4),
    "reviews_present": _bit(33, 1, 5),
    "rating_present": _bit(35, 3, 2, 3),
    "delivery_info_present": _bit(37, 1, 1),
    "payment_info_present": _bit(39, 2, 3, 3),
    "company_identity_present": _bit(41, 5, 1),
    "legal_requisites_present": _bit(43, 1, 2, 3),
    "query_core_phrase_present": _bit(45, 2, 7, 3),
    "query_primary_core_term_present": _bit(47, 1, 3, 4),
    "query_primary_core_term_in_title": _bit(49, 3, 1, 3),
    "query_primary_core_term_in_headings": _bit(51, 1, 2),
    "modifier_or_geo_only_match": f"CASE WHEN {_mix(53, 2, 1, 8)} < 4 THEN 1 ELSE 0 END",
    "core_missing_but_geo_present": f"CASE WHEN {_mix(55, 1, 5, 11)} < 6 THEN 1 ELSE 0 END",
    "semantic_provider_code": f"CAST({_mix(57, 1, 1, 3)} AS DOUBLE)",
    "semantic_embedding_failure": f"CASE WHEN {_mix(59, 3, 1, 23)} = 0 THEN 1 ELSE 0 END",
}

ROW_KEY = ("query", "url")
FEATURES = tuple(_ROW_FEATURES)

VIEWS: dict[str, tuple[dict[str, str], str]] = {
    "v_rows": ({**_ROW_BASE, **_ROW_FEATURES}, _LINE_JOIN),
    "v_targets": (
        {
            "audit_id": "CAST(p_partkey AS STRING)",
            "query": "CAST(p_partkey AS STRING)",
            "category": "p_brand",
            "target_url": "CONCAT('https://www.S', CAST(p_partkey % 97 AS STRING), '.example.com/home')",
            "target_domain": "CONCAT('s', CAST(p_partkey % 97 AS STRING), '.example.com')",
            "requested_top_n": "CASE WHEN p_size % 13 = 0 THEN CAST(NULL AS INT) ELSE 1 + p_size % 12 END",
            "user_score": "CAST(p_partkey * 37 % 1001 AS DOUBLE) / 1e1",
        },
        "FROM {part}",
    ),
    "v_raw_serp": (
        {
            "query": "CAST(l_partkey AS STRING)",
            "serp_page": "CAST(l_linenumber % 4 AS INT)",
            "position": "l_orderkey",
            "url": "CASE WHEN l_suppkey % 13 = 0 THEN CONCAT('https://www.youtube.com/watch/', CAST(l_orderkey AS STRING)) "
            "WHEN l_suppkey % 13 = 1 THEN CONCAT('https://files.example.org/', CAST(l_suppkey AS STRING), '.PDF') "
            "WHEN l_suppkey % 13 = 2 THEN CONCAT('https://forum.example.org/', CAST(l_suppkey AS STRING)) "
            "WHEN l_suppkey % 13 = 3 THEN CONCAT('ftp://s', CAST(l_suppkey AS STRING), '.example.com/x') "
            "WHEN l_suppkey % 13 = 4 THEN CONCAT('https://www.s', CAST(l_suppkey AS STRING), '.example.com/videos/1') "
            "WHEN l_suppkey % 13 = 5 THEN CONCAT('https://www.S', CAST(l_suppkey AS STRING), '.example.com/a-b?page=2&ref=') "
            "ELSE CONCAT('https://s', CAST(l_suppkey AS STRING), '.example.com/p/', CAST(l_suppkey % 3 AS STRING)) END",
            "title": "CONCAT(' ', p_name, ' ')",
            "snippet": "p_type",
            "fetch_status": "CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END",
            "fetch_error_code": "CASE WHEN l_returnflag <> 'R' THEN CAST(NULL AS STRING) "
            "WHEN l_orderkey % 5 = 1 THEN 'http_403' WHEN l_orderkey % 5 = 2 THEN 'browser_timeout' "
            "WHEN l_orderkey % 5 = 3 THEN 'empty_content' WHEN l_orderkey % 5 = 4 THEN '' ELSE 'network_error' END",
            "score": "CASE WHEN l_returnflag = 'R' OR l_orderkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_quantity + (l_discount + 0e0) * 5e2 END",
            "features_present": "CASE WHEN l_returnflag = 'R' OR l_orderkey % 19 = 0 THEN 0 ELSE 1 END",
            "word_count": "l_quantity * 4e0",
            "text_length_chars": "l_quantity * 2.5e1",
        },
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    ),
    "v_events": (
        {
            "id": "event_id",
            "audit_id": "user_id",
            "created_at": "ts",
            "duration_ms": "CASE WHEN event_id % 29 = 0 THEN CAST(NULL AS DOUBLE) ELSE value END",
            "event": "CASE event_type WHEN 'view' THEN 'dispatched' WHEN 'click' THEN 'started' "
            "WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'aborted' END",
            "stage": "CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 11 "
            "WHEN 0 THEN 'pipeline' WHEN 1 THEN 'app.process_audit_fetch_target' WHEN 2 THEN 'heavy_analysis' WHEN 3 THEN 'features' "
            "WHEN 4 THEN 'scoring' WHEN 5 THEN 'competitors' WHEN 6 THEN 'competitor_page' WHEN 7 THEN 'competitor_analysis' "
            "WHEN 8 THEN 'competitor_aggregation' WHEN 9 THEN 'recommendations' ELSE 'finalize' END",
            "processing_version": "CASE WHEN event_id % 37 = 0 THEN CAST(NULL AS INT) ELSE 1 + CAST(floor(day(ts) / 15e0) AS INT) END",
            "final_status": "CASE WHEN event_id % 3 = 0 THEN 'completed_with_warnings' WHEN event_id % 3 = 1 THEN 'completed' ELSE CAST(NULL AS STRING) END",
        },
        "FROM {events}",
    ),
    "v_audits": (
        {
            "id": "o_orderkey",
            "query": "CONCAT('query ', CAST(o_custkey AS STRING))",
            "target_url": "CONCAT('https://', lower(c_mktsegment), '.example.com/', CAST(o_orderkey AS STRING))",
            "domain": "CONCAT(lower(c_mktsegment), '.example.com')",
            "status": "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'completed_with_warnings' ELSE 'completed' END "
            "WHEN 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'queued' ELSE 'processing' END ELSE 'failed' END",
            "orchestration_stage": "CASE o_orderkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'fetch' WHEN 2 THEN 'features' "
            "WHEN 3 THEN 'scoring' WHEN 4 THEN 'competitors' WHEN 5 THEN 'recommendations' ELSE 'finalize' END",
            "created_at": "o_orderdate",
            "updated_minutes": "o_orderkey % 50",
            "score": "CASE WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice / 5e3 END",
            "model_key": "CASE WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS STRING) ELSE o_orderpriority END",
            "warning_messages": "CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 3 ELSE 0 END",
            "found_summary": "CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 12 END",
            "analyzed_summary": "CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 10 END",
            "failed_summary": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 4 END",
            "detail_found": "o_orderkey % 11",
            "detail_analyzed": "o_orderkey % 6",
            "requested_top_n": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(NULL AS BIGINT) ELSE 1 + o_orderkey % 8 END",
        },
        "FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    ),
    "v_doc_rows": (
        {
            "query": "lang",
            "url": "CONCAT('doc-', CAST(doc_id AS STRING))",
            "domain": "source",
            "category": "source",
            "doc_id": "doc_id",
            "weak_target_score": "CAST(100 - (doc_id * 13) % 101 AS DOUBLE)",
        },
        "FROM {documents}",
    ),
    "v_doc_labels": (
        {
            "query": "CASE WHEN l.doc_id % 40 = 7 THEN 'zz' ELSE d.lang END",
            "url": "CONCAT('doc-', CAST(l.doc_id AS STRING))",
            "line_no": "l.doc_id",
            "expert_target_score": "CAST(quality * 60 + toxic * 15 + l.doc_id % 20 AS DOUBLE)",
        },
        "FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id",
    ),
}


_DRIVING = {"v_rows": "lineitem", "v_raw_serp": "lineitem", "v_events": "events"}


def _select(name: str) -> str:
    columns, source = VIEWS[name]
    body = ",\n  ".join(f"{expression} AS {alias}" for alias, expression in columns.items())
    return f"SELECT {body}\n{source}"


def _tables(spark: SparkSession, folder: str, name: str, text: str) -> dict[str, DataFrame]:
    # only the table the rows come from is worth dealing out
    return {t: spread(read_table(spark, folder, t)) if t == _DRIVING.get(name) else read_table(spark, folder, t) for t in sorted(set(_TABLE.findall(text)))}


def load_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    text = _select(name)
    return spark.sql(text, **_tables(spark, folder, name, text))


def load_dealt(spark: SparkSession, folder: str, name: str, key: str, own: int = OWN, by: Callable[[Column], Column] = lambda value: value) -> DataFrame | None:
    """``load_view`` with the rows dealt by a column before the others are computed.

    A view of a hundred columns is made from a dozen: what crosses the network
    are those that the plan needs, and windows and groups by the column (by what
    ``by`` makes of it) find their rows together. None if a key has more rows
    than one task should hold (``order.large_keys``): such views are read by
    ``load_view``.
    """
    columns, source = VIEWS[name]
    text = f"SELECT *\n{source}"
    base = spark.sql(text, **_tables(spark, folder, name, text))
    dealt_by = by(F.expr(columns[key]))
    if large_keys(base.select(dealt_by.alias(key)), [key], own) is not None:
        return None
    return base.repartition(dealt_by).select(*[F.expr(expression).alias(alias) for alias, expression in columns.items()])


def view_cte(*names: str) -> str:
    """The same views as a WITH clause for the oracle."""
    parts = [f"{name} AS ({_TABLE.sub(lambda m: m.group(1), _select(name))})" for name in names]
    return "WITH " + ",\n".join(parts)

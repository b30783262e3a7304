"""Peer-set queries over search results and page rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import peers
from rankloom.plans.oracle_text import big, clip, host, mean, rnd
from rankloom.plans.registry import Catalog
from rankloom.session import kept
from rankloom.sources.views import load_view, view_cte

CATALOG = Catalog()

_TOP_N = 6
_PAYLOAD = ("fetch_status", "fetch_error_code", "score", "features_present", "word_count", "text_length_chars")


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return peers.serp_normalize(load_view(spark, folder, "v_raw_serp"), _TOP_N, _PAYLOAD)


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_targets").withColumn("candidate_limit", peers.candidate_limit(F.col("requested_top_n")))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return peers.competitor_candidates(_results(spark, folder), _targets(spark, folder), _PAYLOAD)


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    wanted = load_view(spark, folder, "v_targets").select("audit_id", "requested_top_n")
    return peers.competitor_selection(_candidates(spark, folder).join(wanted, "audit_id"))


# --- oracle pieces ----------------------------------------------------------
_NORMALIZED = f"""
o_clean AS (
  SELECT *, lower({host('url')}) AS h,
    lower(CASE WHEN strpos(url, '://') > 0 AND strpos(split_part(url, '://', 2), '/') > 0
      THEN split_part(substr(split_part(url, '://', 2), strpos(split_part(url, '://', 2), '/')), '?', 1) ELSE '' END) AS p
  FROM v_raw_serp),
o_ok AS (
  SELECT * FROM o_clean
  WHERE (url LIKE 'http://%' OR url LIKE 'https://%') AND h NOT LIKE '%youtube.%' AND h NOT LIKE '%x.com%' AND h NOT LIKE '%t.me%'
    AND p NOT LIKE '%/video%' AND p NOT LIKE '%/search%' AND p NOT LIKE '%/map%' AND p NOT LIKE '%/forum%' AND p NOT LIKE '%.pdf'
    AND h NOT LIKE 'forum.%' AND h NOT LIKE '%.forum.%'),
o_first AS (
  SELECT *, row_number() OVER (PARTITION BY query, serp_page, url
    ORDER BY position, fetch_status, fetch_error_code NULLS FIRST, score NULLS FIRST, features_present, word_count, text_length_chars) AS k FROM o_ok),
o_norm AS (
  SELECT query, serp_page, url, trim(title) AS title, trim(snippet) AS snippet, fetch_status, fetch_error_code, score,
    features_present, word_count, text_length_chars,
    serp_page * {_TOP_N} + row_number() OVER (PARTITION BY query, serp_page ORDER BY position, url) AS rank
  FROM o_first WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY query, serp_page ORDER BY position, url) <= {_TOP_N})"""

_LIMITED = """
o_want AS (SELECT *, CASE WHEN requested_top_n > 0 THEN least(requested_top_n, 100) ELSE 10 END AS w FROM v_targets),
o_targets AS (SELECT *, w + least(greatest(3, (w + 1) // 2), 10, greatest(0, 100 - w)) AS lim FROM o_want)"""

_CANDIDATES = f"""
o_page AS (SELECT DISTINCT query, serp_page FROM o_norm WHERE serp_page < 3),
o_reach AS (SELECT a.query, a.serp_page FROM o_page a WHERE
  (SELECT count(*) FROM o_page b WHERE b.query = a.query AND b.serp_page < a.serp_page) = a.serp_page),
o_join AS (
  SELECT t.audit_id, t.lim, n.*, {host('n.url')} AS domain FROM o_norm n JOIN o_reach r ON n.query = r.query AND n.serp_page = r.serp_page
  JOIN o_targets t ON t.query = n.query WHERE {host('n.url')} <> '' AND {host('n.url')} <> t.target_domain),
o_dom AS (SELECT * FROM o_join QUALIFY row_number() OVER (PARTITION BY audit_id, domain ORDER BY rank, url) = 1),
o_cand AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY rank, url) AS candidate_index FROM o_dom
  QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY rank, url) <= lim)"""

_REASON = """CASE WHEN coalesce(fetch_error_code, '') = 'http_403' THEN 'bot_block_suspected'
  WHEN coalesce(fetch_error_code, '') = 'browser_timeout' THEN 'render_limited'
  WHEN coalesce(fetch_error_code, '') = 'empty_content' THEN 'thin_content'
  WHEN fetch_status <> 'success' AND (features_present = 0 OR score IS NULL) THEN 'fetch_failed'
  WHEN features_present = 0 OR score IS NULL THEN 'not_analyzed'
  WHEN score < 10 THEN 'score_below_minimum'
  WHEN word_count < 20 AND text_length_chars < 200 THEN 'thin_content' END"""

_SELECTED = f"""
o_reason AS (SELECT c.*, t.requested_top_n, {_REASON} AS discard_reason FROM o_cand c JOIN v_targets t ON c.audit_id = t.audit_id),
o_run AS (SELECT *, coalesce(sum(CASE WHEN discard_reason IS NULL THEN 1 ELSE 0 END) OVER
  (PARTITION BY audit_id ORDER BY candidate_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM o_reason),
o_sel AS (SELECT *, CASE WHEN discard_reason IS NOT NULL THEN 'discarded'
    WHEN requested_top_n IS NULL OR taken < requested_top_n THEN 'accepted' ELSE 'unused' END AS context_status,
  CASE WHEN discard_reason IS NOT NULL AND requested_top_n IS NOT NULL AND taken < requested_top_n THEN 1 ELSE 0 END AS attempt
  FROM o_run)"""

_CHAIN = view_cte("v_raw_serp", "v_targets") + "," + ",".join([_NORMALIZED, _LIMITED, _CANDIDATES, _SELECTED])

_QUALITY = f"""
o_cnt AS (SELECT audit_id, count(*) AS found, count(*) FILTER (context_status = 'accepted') AS analyzed,
  count(*) FILTER (context_status = 'discarded') AS failed, count(*) FILTER (context_status = 'unused') AS unused_candidates,
  sum(attempt) AS replacement_attempts,
  count(*) FILTER (context_status = 'accepted' AND requested_top_n IS NOT NULL AND candidate_index > requested_top_n) AS replacements_used
  FROM o_sel GROUP BY audit_id),
o_r AS (SELECT audit_id, string_agg(lab, ',' ORDER BY lab) AS discard_reasons FROM
  (SELECT audit_id, discard_reason || ':' || count(*) AS lab FROM o_sel WHERE discard_reason IS NOT NULL GROUP BY audit_id, discard_reason) GROUP BY audit_id),
o_e AS (SELECT audit_id, string_agg(lab, ',' ORDER BY lab) AS fetch_error_codes FROM
  (SELECT audit_id, code || ':' || count(*) AS lab FROM (SELECT audit_id, CASE WHEN coalesce(fetch_error_code, '') <> '' THEN fetch_error_code
     WHEN fetch_status = 'success' THEN discard_reason ELSE fetch_status END AS code FROM o_sel WHERE discard_reason IS NOT NULL)
   GROUP BY audit_id, code) GROUP BY audit_id),
o_quality AS (SELECT t.audit_id,
  CASE WHEN coalesce(found, 0) = 0 THEN 'no_serp_results' WHEN analyzed < 2 THEN 'insufficient_processed_competitors'
    WHEN requested_top_n IS NOT NULL AND analyzed >= requested_top_n THEN 'ready' WHEN failed > 0 THEN 'partial_but_usable' ELSE 'ready' END AS status,
  CASE WHEN coalesce(analyzed, 0) >= 2 THEN 1 ELSE 0 END AS context_available,
  {big('coalesce(found, 0)')} AS competitors_found, {big('coalesce(analyzed, 0)')} AS competitors_analyzed,
  {big('coalesce(failed, 0)')} AS competitors_failed, {big('coalesce(unused_candidates, 0)')} AS unused_candidates,
  {big('coalesce(replacement_attempts, 0)')} AS replacement_attempts, {big('coalesce(replacements_used, 0)')} AS replacements_used,
  {rnd("CAST(coalesce(analyzed, 0) AS DOUBLE) / coalesce(requested_top_n, greatest(coalesce(found, 0), 2))", 4)} AS coverage_ratio,
  coalesce(discard_reasons, '') AS discard_reasons, coalesce(fetch_error_codes, '') AS fetch_error_codes
  FROM v_targets t LEFT JOIN o_cnt USING (audit_id) LEFT JOIN o_r USING (audit_id) LEFT JOIN o_e USING (audit_id))"""

_COMP = f"""
o_peer AS (SELECT s.audit_id, {rnd(clip('s.score', '0', '100'), 4)} AS peer, {rnd(clip('t.user_score', '0', '100'), 4)} AS own
  FROM o_sel s JOIN v_targets t ON s.audit_id = t.audit_id WHERE context_status = 'accepted'),
o_st AS (SELECT audit_id, count(*) AS n, avg(peer) AS a, max(peer) AS b, median(peer) AS m,
  count(*) FILTER (peer < own) AS lo, count(*) FILTER (peer = own) AS eq FROM o_peer GROUP BY audit_id),
o_g AS (SELECT t.audit_id, {rnd(clip('t.user_score', '0', '100'), 4)} AS own, coalesce(n, 0) AS n, a, b, m, lo, eq,
  {rnd(clip('t.user_score', '0', '100'), 4)} - a AS ag, {rnd(clip('t.user_score', '0', '100'), 4)} - b AS bg
  FROM v_targets t LEFT JOIN o_st USING (audit_id)),
o_m AS (SELECT *,
  CASE WHEN ag >= 0 THEN 100e0 ELSE {clip('100e0 + ag / 25e0 * 100e0', '0e0', '100e0')} END * 62e-2
  + CASE WHEN bg >= 0 THEN 100e0 ELSE {clip('100e0 + bg / 30e0 * 100e0', '0e0', '100e0')} END * 38e-2 AS strength,
  {clip('ag * 12e-2 + bg * 8e-2', '-6e0', '4e0')} AS adj FROM o_g),
o_comp AS (SELECT audit_id, own AS primary_page_score, {big('n')} AS competitors_scored,
  CASE WHEN n >= 2 THEN 'competitiveness_score' ELSE 'primary_page_score' END AS score_basis,
  CASE WHEN n >= 2 THEN {rnd(clip('own * 72e-2 + strength * 28e-2 + adj', '0e0', '100e0'), 4)} ELSE own END AS competitiveness_score,
  CASE WHEN n >= 2 THEN {rnd('a', 4)} END AS competitor_average_score, CASE WHEN n >= 2 THEN b END AS competitor_best_score,
  CASE WHEN n >= 2 THEN {rnd('m', 4)} END AS competitor_median_score, CASE WHEN n >= 2 THEN {rnd('ag', 4)} END AS average_score_gap,
  CASE WHEN n >= 2 THEN {rnd('bg', 4)} END AS best_score_gap,
  CASE WHEN n >= 2 THEN {rnd('(lo + 5e-1 * eq) / n * 100e0', 4)} END AS score_percentile,
  CASE WHEN n < 2 THEN 'not_enough_data' WHEN ag >= 5 AND bg >= 0 THEN 'leading' WHEN ag >= -3 AND bg >= -8 THEN 'competitive'
    WHEN ag >= -8 AND bg >= -15 THEN 'close_gap' WHEN ag >= -16 THEN 'behind' ELSE 'far_behind' END AS position_band FROM o_m),
o_competitive AS (SELECT *, {rnd('competitiveness_score - primary_page_score', 4)} AS score_delta FROM o_comp)"""


@CATALOG.query("serp_normalize", view_cte("v_raw_serp") + "," + _NORMALIZED + " SELECT query, serp_page, url, title, snippet, CAST(rank AS INT) AS rank FROM o_norm")
def serp_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("query", "serp_page", "url", "title", "snippet", "rank")


@CATALOG.query("candidate_limit", view_cte("v_targets") + "," + _LIMITED + " SELECT audit_id, requested_top_n, CAST(lim AS INT) AS candidate_limit FROM o_targets")
def candidate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _targets(spark, folder).select("audit_id", "requested_top_n", "candidate_limit")


@CATALOG.query("competitor_candidates", view_cte("v_raw_serp", "v_targets") + "," + ",".join([_NORMALIZED, _LIMITED, _CANDIDATES])
    + " SELECT audit_id, domain, url, CAST(rank AS INT) AS rank, serp_page, CAST(candidate_index AS INT) AS candidate_index FROM o_cand")
def competitor_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select("audit_id", "domain", "url", "rank", "serp_page", "candidate_index")


@CATALOG.query("discard_reason", view_cte("v_raw_serp") + f" SELECT coalesce({_REASON}, 'accepted') AS reason, {big('count(*)')} AS n, {rnd('avg(score)', 4)} AS average_score FROM v_raw_serp GROUP BY 1")
def discard_reason(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.coalesce(peers.discard_reason(), F.lit("accepted"))
    return (
        load_view(spark, folder, "v_raw_serp").groupBy(reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"), peers.rnd(F.avg("score"), 4).alias("average_score"))
    )


@CATALOG.query("competitor_selection", _CHAIN + """ SELECT audit_id, url, CAST(candidate_index AS INT) AS candidate_index, context_status, discard_reason,
  CASE WHEN context_status = 'accepted' AND requested_top_n IS NOT NULL AND candidate_index > requested_top_n THEN 1 ELSE 0 END AS replacement_candidate,
  attempt AS replacement_attempt FROM o_sel""")
def competitor_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _selected(spark, folder).select(
        "audit_id", "url", "candidate_index", "context_status", "discard_reason", "replacement_candidate", "replacement_attempt"
    )


@CATALOG.query("context_quality", _CHAIN + "," + _QUALITY + " SELECT * FROM o_quality")
def context_quality(spark: SparkSession, folder: str) -> DataFrame:
    return peers.context_quality(load_view(spark, folder, "v_targets"), _selected(spark, folder))


def _competitive(spark: SparkSession, folder: str, selected: DataFrame) -> DataFrame:
    accepted = selected.filter(F.col("context_status") == "accepted")
    return peers.competitiveness(load_view(spark, folder, "v_targets"), accepted.select("audit_id", "score"))


@CATALOG.query("competitiveness", _CHAIN + "," + _COMP + " SELECT * FROM o_competitive")
def competitiveness(spark: SparkSession, folder: str) -> DataFrame:
    return _competitive(spark, folder, _selected(spark, folder))


@CATALOG.query("comparison_summary", _CHAIN + "," + _QUALITY + "," + _COMP + f""" SELECT audit_id, competitiveness_score AS user_score, primary_page_score, score_basis,
  competitor_average_score AS competitors_average_score, {rnd('competitiveness_score - competitor_average_score', 4)} AS score_difference,
  {rnd('primary_page_score - competitor_average_score', 4)} AS primary_score_difference, competitors_found, competitors_analyzed, competitors_failed,
  replacement_attempts, status AS competitor_context_status, position_band, score_percentile FROM o_quality JOIN o_competitive USING (audit_id)""")
def comparison_summary(spark: SparkSession, folder: str) -> DataFrame:
    # one selection for both sides
    columns = ("audit_id", "context_status", "discard_reason", "fetch_error_code", "fetch_status", "replacement_attempt", "replacement_candidate", "score")
    selected = kept(_selected(spark, folder).select(*columns))
    return peers.comparison_summary(peers.context_quality(load_view(spark, folder, "v_targets"), selected), _competitive(spark, folder, selected))


_GROUP_SQL = ", ".join(
    rnd("(" + " + ".join(cols) + f") / {len(cols)}e0", 6) + f" AS {name}" for name, cols in peers.SERP_RELATIVE_GROUPS.items()
)
_GROUP_NAMES = list(peers.SERP_RELATIVE_GROUPS)
_LONG = f"""
o_wide AS (SELECT query, url, rank, fetch_status, target_score, {_GROUP_SQL} FROM v_rows),
o_long AS (UNPIVOT o_wide ON {', '.join(_GROUP_NAMES)} INTO NAME grp VALUE value)"""


def _relative_sql(name: str) -> str:
    pick = lambda col: f"max({col}) FILTER (grp = '{name}') AS"
    return (
        f"{pick('gap_to_top')} relative_gap_to_top_{name}, {pick('gap_to_median')} relative_gap_to_median_{name}, "
        f"{pick('percentile')} relative_percentile_{name}, {pick('z_score')} relative_z_score_{name}"
    )


_STATS_SQL = f"""
  {rnd('own - top_value', 6)} AS gap_to_top, {rnd('own - median_value', 6)} AS gap_to_median,
  {rnd('(below + 5e-1 * equal) / peers', 6)} AS percentile,
  {rnd("CASE WHEN variance < 1e-12 THEN 0e0 ELSE (own - mean_value) / sqrt(variance) END", 5)} AS z_score,
  1e0 - least(greatest(top_value - own, 0e0), 1e0) AS gap_score"""

_ALL_ORACLE = view_cte("v_rows") + "," + _LONG + f""",
o_peer AS (SELECT a.query, a.url, a.grp, any_value(a.value) AS own, count(*) AS peers, max(b.value) AS top_value, median(b.value) AS median_value,
  avg(b.value) AS mean_value, var_pop(b.value) AS variance, count(*) FILTER (b.value < a.value) AS below, count(*) FILTER (b.value = a.value) AS equal
  FROM o_long a JOIN o_long b ON a.query = b.query AND a.grp = b.grp AND a.url <> b.url GROUP BY a.query, a.url, a.grp),
o_s AS (SELECT query, url, grp, peers, {_STATS_SQL} FROM o_peer)
SELECT query, url, {big('max(peers)')} AS serp_relative_context_count, {big('count(*)')} AS serp_relative_group_count,
  {rnd(mean('percentile', 6), 6)} AS serp_relative_percentile, {rnd(mean('gap_score', 6), 6)} AS serp_relative_gap_score,
  {', '.join(_relative_sql(n) for n in _GROUP_NAMES)} FROM o_s GROUP BY query, url"""


@CATALOG.query("serp_relative_all", _ALL_ORACLE)
def serp_relative_all(spark: SparkSession, folder: str) -> DataFrame:
    return peers.serp_relative_all(load_view(spark, folder, "v_rows"))


def _target_and_peers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All rows of a query with the best-ranked page of each query as the audited page."""
    # a row's six means travel instead of the features they are taken of
    rows = peers.with_group_means(load_view(spark, folder, "v_rows")).select(F.col("query").alias("audit_id"), "url", "rank", "_groups")
    own_url = rows.groupBy("audit_id").agg(F.min_by("url", F.struct("rank", "url")).alias("own_url"))
    joined = rows.join(own_url, "audit_id").select("audit_id", "url", "own_url", "_groups")
    return joined.filter(F.col("url") == F.col("own_url")), joined.filter(F.col("url") != F.col("own_url"))


_TARGET_ORACLE = view_cte("v_rows") + "," + _LONG + f""",
o_own AS (SELECT query, arg_min(url, (rank, url)) AS own_url FROM v_rows GROUP BY query),
o_peer AS (SELECT a.query, a.grp, any_value(a.value) AS own, count(b.url) AS peers, max(b.value) AS top_value, median(b.value) AS median_value,
  avg(b.value) AS mean_value, var_pop(b.value) AS variance, count(*) FILTER (b.value < a.value) AS below, count(*) FILTER (b.value = a.value) AS equal
  FROM o_long a JOIN o_own o ON a.query = o.query AND a.url = o.own_url
  LEFT JOIN o_long b ON a.query = b.query AND a.grp = b.grp AND a.url <> b.url GROUP BY a.query, a.grp),
o_s AS (SELECT query, grp, peers, {_STATS_SQL} FROM o_peer)
SELECT query AS audit_id, CASE WHEN max(peers) > 0 THEN 1 ELSE 0 END AS serp_relative_context_available,
  {big('max(peers)')} AS serp_relative_context_count, {big('count(*) FILTER (peers > 0)')} AS serp_relative_group_count,
  coalesce({rnd(mean('percentile', 6, 'peers > 0'), 6)}, 0e0) AS serp_relative_percentile,
  coalesce({rnd(mean('gap_score', 6, 'peers > 0'), 6)}, 0e0) AS serp_relative_gap_score,
  {', '.join(_relative_sql(n) for n in _GROUP_NAMES).replace("FILTER (grp", "FILTER (peers > 0 AND grp")} FROM o_s GROUP BY query"""


@CATALOG.query("serp_relative_target", _TARGET_ORACLE)
def serp_relative_target(spark: SparkSession, folder: str) -> DataFrame:
    own, others = _target_and_peers(spark, folder)
    return peers.serp_relative_target(own, others)


_HIGHER = ("keyword_coverage_ratio", "word_count", "technical_seo_score")
_LOWER = ("performance_resource_complexity_score", "link_count")
_NEUTRAL = ("title_length",)

_BENCH_ORACLE = view_cte("v_rows") + f""",
o_w AS (SELECT query, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in (*_HIGHER, *_LOWER, *_NEUTRAL))} FROM v_rows WHERE fetch_status = 'success'),
o_l AS (UNPIVOT o_w ON {', '.join((*_HIGHER, *_LOWER, *_NEUTRAL))} INTO NAME metric VALUE value)
SELECT query, metric, {rnd(f"CASE WHEN metric IN {_HIGHER!r} THEN quantile_cont(value, 75e-2) WHEN metric IN {_LOWER!r} THEN quantile_cont(value, 25e-2) ELSE avg(value) END", 4)} AS benchmark,
  {big('count(*)')} AS n FROM o_l GROUP BY query, metric"""


@CATALOG.query("peer_benchmark", _BENCH_ORACLE)
def peer_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").filter(F.col("fetch_status") == "success")
    return peers.peer_benchmark(rows, _LOWER, _HIGHER, _NEUTRAL)


@CATALOG.query("peer_average", view_cte("v_rows") + f""" SELECT query, {big('count(*)')} AS peers,
  {', '.join(rnd("sum(CASE WHEN fetch_status = 'failed' THEN 0 ELSE round_even(CAST(" + m + " AS DOUBLE) * 1e6, 0) END) / 1e6 / count(*)", 4) + f" AS avg_{m}" for m in (*_HIGHER, *_LOWER))},
  {rnd(mean('target_score', 6, "fetch_status <> 'failed'"), 4)} AS average_peer_score FROM v_rows GROUP BY query""")
def peer_average(spark: SparkSession, folder: str) -> DataFrame:
    ok = F.col("fetch_status") != "failed"
    rows = load_view(spark, folder, "v_rows").select(
        "query", *[F.when(ok, F.col(m)).alias(m) for m in (*_HIGHER, *_LOWER)], F.when(ok, F.col("target_score")).alias("score")
    )
    return peers.peer_average(rows, (*_HIGHER, *_LOWER), "score")


_OPEN = ("pending", "processing", "analysis_pending", "analyzing")
_STATUS_SQL = "CASE WHEN fetch_status = 'failed' THEN 'failed' WHEN rank % 13 = 0 THEN 'pending' WHEN rank % 17 = 0 THEN 'analyzing' ELSE 'analyzed' END"


@CATALOG.query("fan_in_ready", view_cte("v_rows", "v_targets") + f""",
o AS (SELECT query AS audit_id, {_STATUS_SQL} AS status FROM v_rows)
SELECT t.audit_id, {big('(SELECT count(*) FROM o WHERE o.audit_id = t.audit_id)')} AS competitor_rows FROM v_targets t
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.audit_id = t.audit_id AND status IN {_OPEN!r})""")
def fan_in_ready(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").select(F.col("query").alias("audit_id"), F.expr(_STATUS_SQL).alias("status"))
    return peers.fan_in_ready(load_view(spark, folder, "v_targets").select("audit_id"), rows, _OPEN)

"""Training-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import datasets, preferences, rubric
from rankloom.operators import final_labels as labelling
from rankloom.operators import hard_negatives as negatives
from rankloom.operators import page_features as pf
from rankloom.plans import evaluation_queries as eq
from rankloom.plans import page_queries as pq
from rankloom.plans import relevance_queries as rq
from rankloom.plans.oracle_text import big, clip, mean, rnd
from rankloom.plans.registry import Catalog
from rankloom.session import stored
from rankloom.sources.views import load_view, view_cte

CATALOG = Catalog()

_SCHEMA_VERSION = "query-competitiveness-rubric-v1"
_HARD = "CASE WHEN rank % 9 = 0 THEN 1 ELSE 0 END"
_V = view_cte("v_rows")
_LINE_NO = "CONCAT(CAST(100 + rank AS STRING), url)"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_rows").withColumn("hard_negative", F.expr(_HARD)).withColumn("line_no", F.expr(_LINE_NO))


# --- seeds and collection ---------------------------------------------------
def _catalog_sql() -> str:
    parts = []
    for template, intent, uses_city in datasets.SEED_PATTERNS:
        for city, region in datasets.SEED_CITIES if uses_city else (("", None),):
            text = template.replace("{city}", city)
            parts.append(
                f"SELECT replace('{text}', '{{category}}', category) AS query, category, '{intent}' AS intent, '{city}' AS city, "
                f"CAST({'NULL' if region is None else region} AS INT) AS region_code, 10 AS top_n, 2 AS pages_to_scan FROM c"
            )
    return "WITH c AS (SELECT DISTINCT p_name AS category FROM part) " + " UNION ALL ".join(parts)


@CATALOG.query("seed_catalog", _catalog_sql())
def seed_catalog(spark: SparkSession, folder: str) -> DataFrame:
    from rankloom.sources.tables import read_table

    categories = read_table(spark, folder, "part").select(F.col("p_name").alias("category")).distinct()
    return datasets.seed_catalog(categories)


@CATALOG.query("domain_cap", _V + """, stored AS (SELECT domain, count(*) AS s FROM v_rows WHERE fetch_status = 'failed' AND rank <= 2 GROUP BY domain),
n AS (SELECT r.*, coalesce(s, 0) AS s, row_number() OVER (PARTITION BY r.domain ORDER BY query, serp_page, rank, url) AS k FROM v_rows r LEFT JOIN stored USING (domain) WHERE fetch_status <> 'failed')
SELECT query, url, domain FROM n WHERE s + k <= 12""")
def domain_cap(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows")
    stored = rows.filter((F.col("fetch_status") == "failed") & (F.col("rank") <= 2))
    fresh = rows.filter(F.col("fetch_status") != "failed").select("query", "url", "domain", "serp_page", "rank", F.col("query").alias("seed_no"))
    return datasets.domain_cap(fresh, stored).select("query", "url", "domain")


@CATALOG.query("weak_label", _V + f""" SELECT query, url, CASE WHEN rank <= 1 THEN 100e0 ELSE {rnd('(20 - least(greatest(rank, 1), 20)) / 19e0 * 1e2', 4)} END AS weak_target_score FROM v_rows""")
def weak_label(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_rows").select("query", "url", datasets.weak_label(F.col("rank"), F.lit(20)).alias("weak_target_score"))


_DOCS = view_cte("v_doc_rows", "v_doc_labels")
_LAST = "lab AS (SELECT * FROM v_doc_labels QUALIFY row_number() OVER (PARTITION BY query, url ORDER BY line_no DESC) = 1)"


def _doc_labels(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.last_label(load_view(spark, folder, "v_doc_labels"), "line_no")


@CATALOG.query("label_blend", _DOCS + "," + _LAST + f""" SELECT r.query, r.url, expert_target_score, CASE WHEN expert_target_score IS NULL THEN 'weak_serp' ELSE 'hybrid' END AS label_source,
  CASE WHEN expert_target_score IS NULL THEN weak_target_score ELSE {rnd('expert_target_score * 7e-1 + weak_target_score * 3e-1', 4)} END AS target_score
  FROM v_doc_rows r LEFT JOIN lab ON r.query = lab.query AND r.url = lab.url""")
def label_blend(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_doc_rows").select("query", "url", "weak_target_score")
    return datasets.label_blend(rows, _doc_labels(spark, folder)).select("query", "url", "expert_target_score", "label_source", "target_score")


@CATALOG.query("label_blend_unmatched", _DOCS + "," + _LAST + " SELECT query, url FROM lab WHERE NOT EXISTS (SELECT 1 FROM v_doc_rows r WHERE r.query = lab.query AND r.url = lab.url)")
def label_blend_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.unmatched_labels(load_view(spark, folder, "v_doc_rows"), _doc_labels(spark, folder)).select("query", "url")


def _pick(q: float) -> str:
    return f"max(v) FILTER (pos = CAST(round_even((n - 1) * CAST({q} AS DOUBLE), 0) AS BIGINT))"


def _stats_sql(source: str, key: str, rule: str = "nearest") -> str:
    at = _pick if rule == "nearest" else (lambda q: f"max(v) FILTER (pos = least(n - 1, CAST(floor(n * CAST({q} AS DOUBLE)) AS BIGINT)))")
    return f"""(SELECT {key}, {big('any_value(n)')} AS n, min(v) AS min, {at(0.25)} AS p25, {rnd(mean('v', 4), 4)} AS mean, {at(0.5)} AS p50, {at(0.75)} AS p75, {at(0.9)} AS p90, max(v) AS max
  FROM (SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM {source}) GROUP BY {key})"""


@CATALOG.query("label_apply", _DOCS + "," + _LAST + f""", j AS (SELECT weak_target_score AS o, expert_target_score AS e FROM v_doc_rows r JOIN lab ON r.query = lab.query AND r.url = lab.url),
m AS (SELECT 'old' AS measure, o AS v FROM j UNION ALL SELECT 'new', e FROM j UNION ALL SELECT 'delta', e - o FROM j) SELECT * FROM {_stats_sql('m', 'measure')}""")
def label_apply(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_doc_rows").withColumn("target_score", F.col("weak_target_score"))
    applied = datasets.label_apply(rows, _doc_labels(spark, folder), strict=False)
    measures = F.array(
        F.struct(F.lit("old").alias("measure"), F.col("old_target_score").alias("v")), F.struct(F.lit("new").alias("measure"), F.col("target_score").alias("v")),
        F.struct(F.lit("delta").alias("measure"), (F.col("target_score") - F.col("old_target_score")).alias("v")),
    )
    return datasets.score_stats(applied.select(F.explode(measures).alias("m")).select("m.measure", "m.v"), ["measure"], "v")


@CATALOG.query("label_apply_coverage", _DOCS + "," + _LAST + f""" SELECT {big('count(r.url)')} AS source_rows, {big('count(*) FILTER (r.url IS NOT NULL AND lab.url IS NOT NULL)')} AS labels_applied,
  {big('count(*) FILTER (lab.url IS NULL)')} AS missing_labels, {big('count(*) FILTER (r.url IS NULL)')} AS unmatched_labels FROM v_doc_rows r FULL JOIN lab ON r.query = lab.query AND r.url = lab.url""")
def label_apply_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.label_coverage(load_view(spark, folder, "v_doc_rows"), _doc_labels(spark, folder))


_OK, _BAD = "fetch_status <> 'failed'", "fetch_status = 'failed'"


def _ok_bad(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, folder)
    return rows.filter(F.expr(_OK)), rows.filter(F.expr(_BAD))


@CATALOG.query("collection_stats", _V + f""", c AS (SELECT count(*) FILTER ({_OK}) AS r, count(*) FILTER ({_BAD}) AS f, count(DISTINCT query) FILTER ({_OK}) AS q, count(DISTINCT domain) FILTER ({_OK}) AS d,
  count(*) FILTER ({_OK} AND text_length_chars <= 300) AS e FROM v_rows)
SELECT {big('r')} AS rows_count, {big('f')} AS failures_count, {big('q')} AS unique_queries, {big('d')} AS unique_domains, {rnd('f * 1e0 / (r + f)', 6)} AS failure_rate, {rnd('e * 1e0 / r', 6)} AS empty_text_rate FROM c""")
def collection_stats(spark: SparkSession, folder: str) -> DataFrame:
    ok, bad = _ok_bad(spark, folder)
    return datasets.collection_stats(ok.withColumn("text_length_chars", F.greatest(F.lit(0.0), F.col("text_length_chars") - 300)), bad)


def _first_sql(where: str, col: str, name: str) -> str:
    return f"(SELECT value, count(*) AS {name} FROM (SELECT query, arg_min({col}, {_LINE_NO.replace('STRING', 'VARCHAR')}) AS value FROM v_rows WHERE {where} GROUP BY query) GROUP BY value)"


@CATALOG.query("dimension_coverage", _V + " " + " UNION ALL ".join(
    f"""SELECT '{d}' AS dimension, value, {big('coalesce(seed_queries, 0)')} AS seed_queries, {big('coalesce(success_queries, 0)')} AS success_queries,
  coalesce({rnd('coalesce(success_queries, 0) * 1e0 / nullif(seed_queries, 0)', 6)}, 0e0) AS coverage_ratio FROM {_first_sql('TRUE', d, 'seed_queries')} FULL JOIN {_first_sql("fetch_status <> 'failed' AND rank <= 4", d, 'success_queries')} USING (value)"""
    for d in ("category", "city")))
def dimension_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    good = rows.filter(F.expr(_OK) & (F.col("rank") <= 4))
    parts = [datasets.dimension_coverage(rows, good, d).withColumn("dimension", F.lit(d)) for d in ("category", "city")]
    return parts[0].unionByName(parts[1])


_PREP = {
    "expert_target_score": "CASE WHEN rank <= 10 THEN target_score END",
    "label_source": "CASE WHEN rank <= 7 THEN 'hybrid' ELSE 'weak_serp' END",
    "artifact_path": "CASE WHEN rank % 4 = 0 THEN '' ELSE url END",
    "fetch_error": "CASE WHEN fetch_error_code = '' THEN ' ' ELSE fetch_error_code END",
}
_MAN_SQL = _V + f""", pr AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _PREP.items())} FROM v_rows), ok AS (SELECT * FROM pr WHERE {_OK}), bad AS (SELECT * FROM pr WHERE {_BAD}),
man AS (SELECT {big('count(*)')} AS rows_count, {big('(SELECT count(*) FROM bad)')} AS failures_count, {big('count(DISTINCT query)')} AS unique_queries, {big('(SELECT count(DISTINCT query) FROM pr)')} AS attempted_queries,
  {big('(SELECT count(*) FROM part)')} AS seed_queries_count, {big('count(DISTINCT domain)')} AS unique_domains, {big('count(DISTINCT category)')} AS unique_categories, {big('count(DISTINCT city)')} AS unique_cities,
  {rnd('avg(rank)', 6)} AS average_rank, min(rank) AS best_rank, max(rank) AS worst_rank, {big('count(expert_target_score)')} AS expert_rows_count, {big('count(*) - count(expert_target_score)')} AS weak_only_rows_count,
  {big("count(*) FILTER (label_source = 'hybrid')")} AS hybrid_rows_count, {big("count(*) FILTER (artifact_path <> '')")} AS rows_with_artifact_paths FROM ok),
manifest AS (SELECT *, rows_count + failures_count AS attempts_count, {rnd('unique_queries * 1e0 / seed_queries_count', 6)} AS query_coverage_ratio, {rnd('attempted_queries * 1e0 / seed_queries_count', 6)} AS attempted_query_coverage_ratio,
  {rnd('rows_count * 1e0 / unique_queries', 6)} AS average_rows_per_query, {rnd('failures_count * 1e0 / (rows_count + failures_count)', 6)} AS failure_rate FROM man)"""


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").withColumns({n: F.expr(e) for n, e in _PREP.items()})
    seeds = load_view(spark, folder, "v_targets").select("query")
    return datasets.dataset_manifest(rows.filter(F.expr(_OK)), rows.filter(F.expr(_BAD)), seeds)


@CATALOG.query("dataset_manifest", _MAN_SQL + " SELECT * FROM manifest")
def dataset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder)


@CATALOG.query("dataset_manifest_failures", _MAN_SQL + f" SELECT CASE WHEN trim(coalesce(fetch_error, '')) = '' THEN 'unknown_failure' ELSE trim(fetch_error) END AS message, {big('count(*)')} AS n FROM bad GROUP BY 1 ORDER BY n DESC, message LIMIT 5")
def dataset_manifest_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").withColumns({n: F.expr(e) for n, e in _PREP.items()})
    return datasets.top_failures(rows.filter(F.expr(_BAD)))


# --- splits -----------------------------------------------------------------
_SPLIT_SQL = """
q AS (SELECT DISTINCT query, md5('42:' || query) AS h FROM v_rows),
split AS (SELECT query, CASE WHEN row_number() OVER (ORDER BY h) <= ceil((SELECT count(*) FROM q) * 2e-1) THEN 'validation' ELSE 'train' END AS partition FROM q)"""
_STRAT_SQL = """
mc AS (SELECT query, category, count(*) AS n FROM v_rows GROUP BY query, category),
mj AS (SELECT query, category, md5('42:' || query) AS h FROM mc QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, category) = 1),
mn AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY h) AS k FROM mj),
mw AS (SELECT *, greatest(1, CAST(round_even(n * 2e-1, 0) AS BIGINT)) AS w FROM mn),
ssplit AS (SELECT query, category, CASE WHEN k <= CASE WHEN w >= n AND n > 1 THEN n - 1 ELSE w END THEN 'validation' ELSE 'train' END AS partition FROM mw)"""


@CATALOG.query("group_split", _V + "," + _SPLIT_SQL + " SELECT query, partition FROM split")
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.group_split(load_view(spark, folder, "v_rows")).select("query", "partition")


@CATALOG.query("stratified_split", _V + "," + _STRAT_SQL + " SELECT query, category, partition FROM ssplit")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.stratified_split(load_view(spark, folder, "v_rows")).select("query", "category", "partition")


@CATALOG.query("split_assignment", _V + f""" SELECT query, CASE WHEN count(*) FILTER (rank <= 30) = 0 THEN 'validation' WHEN count(*) FILTER (rank > 36) = 0 THEN 'train' ELSE 'both' END AS partition,
  {big('count(*)')} AS rows FROM v_rows WHERE rank <= 30 OR rank > 36 GROUP BY query""")
def split_assignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows")
    return datasets.split_assignment(rows.filter(F.col("rank") <= 30), rows.filter(F.col("rank") > 36))


_TAMPERED = "SELECT query, CASE WHEN length(query) = 2 THEN 'both' ELSE partition END AS partition FROM split WHERE query NOT LIKE '%7' UNION ALL SELECT 'extra-' || query, partition FROM split WHERE length(query) = 1"


def _tampered(spark: SparkSession, folder: str) -> DataFrame:
    split = datasets.group_split(load_view(spark, folder, "v_rows"))
    changed = split.filter(~F.col("query").endswith("7")).withColumn("partition", F.when(F.length("query") == 2, "both").otherwise(F.col("partition")))
    extra = split.filter(F.length("query") == 1).withColumn("query", F.concat(F.lit("extra-"), "query"))
    return changed.unionByName(extra)


@CATALOG.query("split_leakage", _V + "," + _SPLIT_SQL + f""", t AS ({_TAMPERED}), j AS (SELECT q.query AS r, t.query AS s, partition FROM q FULL JOIN t ON q.query = t.query),
c AS (SELECT count(r) AS a, count(*) FILTER (partition IN ('train', 'both')) AS b, count(*) FILTER (partition IN ('validation', 'both')) AS c, count(*) FILTER (partition = 'both') AS d,
  count(*) FILTER (s IS NULL) AS e, count(*) FILTER (r IS NULL) AS f FROM j)
SELECT {big('a')} AS label_queries, {big('b')} AS train_queries, {big('c')} AS validation_queries, {big('d')} AS query_overlap, {big('e')} AS uncovered_queries, {big('f')} AS extra_queries, d = 0 AND e = 0 AND a > 0 AS passed FROM c""")
def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.split_leakage(load_view(spark, folder, "v_rows"), _tampered(spark, folder))


@CATALOG.query("quality_gates", _MAN_SQL + "," + _SPLIT_SQL + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, {rnd(m, 6)} AS actual, CAST({x} AS DOUBLE) AS expected, '{c}' AS comparator, {m} {'>=' if c == 'min' else '<='} {x} AS passed FROM manifest" for n, m, x, c in datasets.QUALITY_THRESHOLDS)
    + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}', CASE WHEN {c} THEN 1e0 ELSE 0e0 END, 1e0, 'is', {c}" for n, c in (
        ("split_present", "(SELECT count(*) FROM split) > 0"), ("split_group_by_query", "TRUE"), ("split_train_queries_present", "(SELECT count(*) FROM split WHERE partition = 'train') > 0"),
        ("split_validation_queries_present", "(SELECT count(*) FROM split WHERE partition = 'validation') > 0"),
        ("split_query_partitions_disjoint", "(SELECT count(*) FROM split) = (SELECT count(DISTINCT query) FROM split)"),
        ("split_covers_dataset_queries", "(SELECT count(*) FROM split) = (SELECT unique_queries FROM manifest)"))))
def quality_gates(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.quality_gates(_manifest(spark, folder), datasets.group_split(load_view(spark, folder, "v_rows")))


_LABELLED = f"{_HARD} AS hard_negative, CASE WHEN rank = 13 THEN NULL ELSE target_score END AS ts, CASE WHEN rank = 40 THEN 'old' ELSE '{_SCHEMA_VERSION}' END AS label_schema_version"


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return rows.withColumn("target_score", F.when(F.col("rank") != 13, F.col("target_score"))).withColumn(
        "label_schema_version", F.when(F.col("rank") == 40, "old").otherwise(_SCHEMA_VERSION)
    )


_SV = {
    "split_exists": "TRUE", "split_mode_grouped": "TRUE", "query_overlap_absent": "TRUE", "all_labeled_queries_covered": "n = (SELECT count(*) FROM j WHERE partition IS NOT NULL)",
    "no_extra_split_queries": "TRUE", "train_rows_present": "nt > 0", "validation_rows_present": "nv >= least(40, greatest(1, floor(n * 2e-1)))", "validation_queries_present": "nv > 0",
    "categories_present_in_train": "(SELECT count(DISTINCT category) FROM j) = (SELECT count(DISTINCT category) FROM j WHERE partition = 'train')",
    "categories_present_in_validation": "(SELECT count(DISTINCT category) FROM j) = (SELECT count(DISTINCT category) FROM j WHERE partition = 'validation')",
    "cities_present_in_train": "(SELECT count(DISTINCT city) FROM j) = (SELECT count(DISTINCT city) FROM j WHERE partition = 'train')",
    "cities_present_in_validation": "(SELECT count(DISTINCT city) FROM j) = (SELECT count(DISTINCT city) FROM j WHERE partition = 'validation')",
    "hard_negatives_in_train": "ht > 0", "hard_negatives_in_validation": "hv > 0", "hard_negative_cap_respected": "ab = 0", "target_scores_present": "ms = 0", "label_schema_consistent": "sc = 0",
}


@CATALOG.query("split_validation", _V + "," + _STRAT_SQL + f""", j AS (SELECT r.query, r.category, city, {_LABELLED}, partition FROM v_rows r LEFT JOIN ssplit s ON r.query = s.query),
c AS (SELECT count(*) AS n, count(*) FILTER (partition = 'train') AS nt, count(*) FILTER (partition = 'validation') AS nv, count(*) FILTER (hard_negative = 1 AND partition = 'train') AS ht,
  count(*) FILTER (hard_negative = 1 AND partition = 'validation') AS hv, count(*) FILTER (hard_negative = 1 AND ts > 35) AS ab, count(*) FILTER (ts IS NULL) AS ms, count(*) FILTER (label_schema_version <> '{_SCHEMA_VERSION}') AS sc FROM j)
""" + " UNION ALL ".join(f"SELECT '{k}' AS check_name, {v} AS passed FROM c" for k, v in _SV.items()))
def split_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _labelled(spark, folder)
    return datasets.split_validation(rows, datasets.stratified_split(rows), _SCHEMA_VERSION)


@CATALOG.query("partition_stats", _V + "," + _STRAT_SQL + f""", j AS (SELECT r.query, r.category, city, domain, target_score, {_HARD} AS hard_negative, partition, {rnd('target_score', 4)} AS v FROM v_rows r JOIN ssplit s ON r.query = s.query)
SELECT a.*, b.min, b.p25, b.p50, b.p75, b.p90, b.max FROM (SELECT partition, {big('count(*)')} AS rows, {big('count(DISTINCT query)')} AS queries, {big('count(DISTINCT category)')} AS categories, {big('count(DISTINCT city)')} AS cities,
  {big('count(*) FILTER (hard_negative = 1)')} AS hard_negative_rows, {big('count(DISTINCT query) FILTER (hard_negative = 1)')} AS hard_negative_queries, {big('count(*) FILTER (hard_negative = 1 AND target_score > 35)')} AS hard_negative_above_cap,
  {big('count(DISTINCT domain)')} AS domains, {big('(SELECT max(n) FROM (SELECT count(*) AS n FROM j z WHERE z.partition = j.partition GROUP BY domain))')} AS max_domain_rows FROM j GROUP BY partition) a JOIN {_stats_sql('j', 'partition', 'floor')} b USING (partition)""")
def partition_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return datasets.partition_stats(datasets.with_partition(rows, datasets.stratified_split(rows)))


@CATALOG.query("partition_histograms", _V + "," + _STRAT_SQL + f""", j AS (SELECT r.*, partition FROM v_rows r JOIN ssplit s ON r.query = s.query)
SELECT partition, 'intent' AS kind, intent AS value, {big('count(*)')} AS n FROM j GROUP BY ALL UNION ALL SELECT partition, 'fetch_status', fetch_status, {big('count(*)')} FROM j GROUP BY ALL""")
def partition_histograms(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    placed = datasets.with_partition(rows, datasets.stratified_split(rows))
    return datasets.histogram(placed, ["partition"], F.col("intent"), "intent").unionByName(
        datasets.histogram(placed, ["partition"], F.col("fetch_status"), "fetch_status")
    )


# --- hard negatives and final labels ----------------------------------------
# Pages play the dataset: ten share a query, their group names the category; some have no snapshot, one category has none at all.
_PAGE_ROW = {
    "category": "CONCAT('c', CAST(CAST(floor(page_id / 1e1) AS BIGINT) % 7 AS STRING))", "intent": "CASE WHEN page_id % 2 = 0 THEN 'commercial' ELSE 'informational' END", "city": "''",
    "rank": "CAST(page_id % 10 + 1 AS INT)", "serp_page": "0", "label_source": "'weak'", "target_score": "CAST(page_id * 7 % 101 AS DOUBLE)",
    "artifact_id": "CASE WHEN page_id % 4 = 3 OR CAST(floor(page_id / 1e1) AS BIGINT) % 7 = 5 THEN CAST(NULL AS BIGINT) ELSE page_id END",
}
_NEG_FEATURES = tuple(pq._MATCH)


def page_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their features, and the snapshots by ``artifact_id``.

    Several steps read both, some of them only keys and titles, so pages are
    parsed once and written.
    """
    parsed = stored(pq.snapshots(spark, folder))
    pages = pq.page_query(spark, folder, parsed)
    rows = pf.query_match(pf.text_stats(pages)).select(
        "page_id", "query", F.col("requested_url").alias("url"), *[F.expr(e).alias(n) for n, e in _PAGE_ROW.items()], *[F.col(f).cast("double").alias(f) for f in _NEG_FEATURES]
    )
    kept = parsed.withColumnRenamed("page_id", "artifact_id").filter("artifact_id % 4 <> 3")
    return rows, kept.withColumn("semantic_similarity", (F.col("artifact_id") % 11) / 10.0)


_NEG_SQL = pq._PQ_SQL + ",\nrw AS (SELECT page_id, query, requested_url AS url, " + ", ".join(f"{e} AS {n}" for n, e in _PAGE_ROW.items()) + f""" FROM q1),
cat AS (SELECT category, count(*) AS n, count(artifact_id) AS u FROM rw GROUP BY category),
rn AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(query || '|' || url)) - 1 AS pos FROM rw),
sd AS (SELECT query, category, intent, city, row_number() OVER (ORDER BY md5(query)) - 1 AS i FROM (SELECT query, category, '' AS city, min(intent) AS intent FROM sq GROUP BY query, category QUALIFY row_number() OVER (PARTITION BY query ORDER BY category) = 1)),
oc AS (SELECT sd.query, sd.category AS own, sd.intent, sd.i, cat.category, cat.n, cat.u, row_number() OVER (PARTITION BY sd.query ORDER BY cat.category) - 1 AS j, count(*) OVER (PARTITION BY sd.query) AS m FROM sd JOIN cat ON cat.category <> sd.category),
od AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (j - i * 2 % m + m) % m) - 1 AS d FROM oc WHERE u > 0),
dw AS (SELECT od.query, od.own, od.intent AS si, od.d, rn.page_id, rn.query AS src, rn.category AS srccat, rn.url, rn.label_source FROM od JOIN rn ON rn.category = od.category AND rn.artifact_id IS NOT NULL WHERE od.d < 2
  QUALIFY row_number() OVER (PARTITION BY od.query, od.d ORDER BY (rn.pos - (od.i + od.d) % od.n + od.n) % od.n) = 1),
al AS (SELECT page_id, query, url, category, intent, rank, serp_page, label_source, target_score, 0 AS hard_negative, '' AS src, '' AS srccat, '' AS srcurl FROM rw
  UNION ALL SELECT page_id, query, url, own, si, 999, -1, 'hard_negative_v7', NULL, 1, src, srccat, url FROM dw),
q0n AS (SELECT ts.* EXCLUDE (lang), al.* EXCLUDE (page_id), lower(al.query) AS ph, {pq._STEMS('al.query')} AS q, {pq._STEMS('text')} AS b, {pq._STEMS('title')} AS ti, {pq._STEMS('descr')} AS me, {pq._STEMS("h1 || ' ' || h2 || ' ' || h3")} AS hd FROM ts JOIN al ON ts.page_id = al.page_id),
q1n AS ({pq._MATCHED.replace('FROM q0', 'FROM q0n')})"""
_NEG_SQL = _NEG_SQL.replace("\nrw AS", "\nsq AS (SELECT query, category, intent FROM (SELECT query, " + ", ".join(f"{_PAGE_ROW[n]} AS {n}" for n in ("category", "intent")) + ", page_id FROM q1) WHERE page_id % 10 < 3),\nrw AS")


def _with_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows, kept = page_dataset(spark, folder)
    seeds = rows.filter("page_id % 10 < 3").select("query", "category", "intent", F.lit("").alias("city"))
    return negatives.hard_negatives(rows, seeds, kept, _NEG_FEATURES)


@CATALOG.query("hard_negatives", _NEG_SQL + " SELECT page_id, query, url, category, intent, rank, serp_page, label_source, target_score, hard_negative, src AS hard_negative_source_query, srccat AS hard_negative_source_category, srcurl AS hard_negative_source_url, "
               + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in pq._MATCH.items()) + " FROM q1n")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset with two pages of other categories for each query, measured against it."""
    return _with_negatives(spark, folder).select(
        "page_id", "query", "url", "category", "intent", "rank", "serp_page", "label_source", "target_score", "hard_negative", "hard_negative_source_query",
        "hard_negative_source_category", "hard_negative_source_url", *_NEG_FEATURES,
    )


@CATALOG.query("hard_negative_report", _NEG_SQL + f""" SELECT CASE hard_negative WHEN 1 THEN 'hard_negative_rows' ELSE 'source_rows' END AS kind, '' AS category, {big('count(*)')} AS rows FROM al GROUP BY 1
UNION ALL SELECT 'source_category', srccat, {big('count(*)')} FROM al WHERE hard_negative = 1 GROUP BY ALL UNION ALL SELECT 'target_category', category, {big('count(*)')} FROM al WHERE hard_negative = 1 GROUP BY ALL""")
def hard_negative_report(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negative_report(_with_negatives(spark, folder))


def _wsum(parts: tuple[tuple[str, str], ...]) -> str:
    return clip(" + ".join(f"{n} * {w}" for n, w in parts), "0e0", "1e0")


_FINAL_SQL = rq._GUARDED + f""",
b0 AS (SELECT *, {_HARD} AS hard_negative, {rnd(clip(
    "rel * 38e0 + " + _wsum((('semantic_content_richness', '4e-1'), ('content_depth_semantic_score', '35e-2'), ('keyword_balance_score', '25e-2'))) + " * 2e1 + "
    + _wsum((('commercial_trust_score', '45e-2'), ('trust_signals_score', '3e-1'), ('commercial_signals_score', '25e-2'))) + " * 15e0 + "
    + _wsum((('technical_seo_score', '42e-2'), ('canonical_signal_score', '22e-2'), ('url_hygiene_score', '18e-2'), ('technical_metadata_score', '18e-2'))) + " * 12e0 + "
    + _wsum((('intent_alignment_score', '55e-2'), ('commercial_intent_alignment', '25e-2'), ('informational_intent_alignment', '2e-1'))) + " * 1e1 + "
    + clip('1e0 - (greatest(1e0, rank) - 1e0) / 9e0', '0e0', '1e0') + " * 5e0", '0e0', '100e0'), 4)} AS base FROM t4 LEFT JOIN {rq.BAND_SQL} ON b = bid),
b1 AS (SELECT *, {rq.adjusted('base')} AS adj FROM b0),
fl AS (SELECT query, url, hard_negative, base AS competitiveness_base_score, CASE WHEN hard_negative = 1 AND adj > 35 THEN 1 ELSE 0 END AS hard_negative_cap_applied,
  CASE WHEN hard_negative = 1 AND adj > 35 THEN 35e0 ELSE adj END AS final_target_score,
  CASE WHEN hard_negative = 1 AND adj > 35 THEN 'hard_negative_cap' ELSE coalesce(band, 'strong_match') END AS query_relevance_band,
  CASE WHEN hard_negative = 1 AND adj > 35 THEN 'cross_category_hard_negative_cap' ELSE coalesce(band_reason, 'strong_query_topic_fit') END AS query_relevance_reason FROM b1)"""


@CATALOG.query("final_labels", _FINAL_SQL + " SELECT * FROM fl")
def final_labels(spark: SparkSession, folder: str) -> DataFrame:
    return labelling.label_final_targets(_rows(spark, folder)).select(
        "query", "url", "hard_negative", "competitiveness_base_score", "hard_negative_cap_applied", "final_target_score", "query_relevance_band", "query_relevance_reason"
    )


@CATALOG.query("final_label_histograms", _FINAL_SQL + f""" SELECT CASE WHEN grouping(hard_negative) = 1 THEN 'all' WHEN hard_negative = 1 THEN 'hard' ELSE 'regular' END AS scope,
  CASE WHEN grouping(query_relevance_band) = 1 THEN 'all' ELSE query_relevance_band END AS band, {big('count(*)')} AS n, {big('sum(hard_negative_cap_applied)')} AS cap_applied FROM fl GROUP BY CUBE (hard_negative, query_relevance_band)""")
def final_label_histograms(spark: SparkSession, folder: str) -> DataFrame:
    cubed = labelling.label_final_targets(_rows(spark, folder)).cube("hard_negative", "query_relevance_band").agg(
        F.grouping("hard_negative").alias("gh"), F.grouping("query_relevance_band").alias("gb"), F.count(F.lit(1)).alias("n"),
        F.sum("hard_negative_cap_applied").alias("cap_applied"),
    )
    scope = F.when(F.col("gh") == 1, "all").when(F.col("hard_negative") == 1, "hard").otherwise("regular")
    return cubed.select(scope.alias("scope"), F.when(F.col("gb") == 1, "all").otherwise(F.col("query_relevance_band")).alias("band"), "n", "cap_applied")


# --- rubric -----------------------------------------------------------------
_TYPE = "CASE rank % 5 WHEN 0 THEN 'homepage' WHEN 1 THEN 'article' WHEN 2 THEN 'product' WHEN 3 THEN 'category' ELSE 'content' END"
_WEAK = "CAST(100 - rank AS DOUBLE)"


def _rubric_rows(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_rows").withColumn("page_type", F.expr(_TYPE)).withColumn("weak_target_score", F.expr(_WEAK))


def _rubric_sql() -> str:
    from rankloom.sources.views import FEATURES

    known = set(FEATURES)
    val = lambda n, d="0e0": f"coalesce(CAST({n} AS DOUBLE), {d})" if n in known else d
    unit = lambda n: clip(val(n), "0e0", "1e0")
    up = lambda n, d=0.0: f"CASE WHEN {val(n, f'{int(d)}e0')} > 0 THEN 1e0 ELSE 0e0 END"

    def part(kind, f, a):
        return {
            "unit": lambda: unit(f), "flag": lambda: up(f, a), "any": lambda: "greatest(" + ", ".join(up(n) for n in f) + ")",
            "share": lambda: clip(f"{val(f)} / {int(a)}e0", "0e0", "1e0"), "least": lambda: f"CASE WHEN {val(f)} >= {int(a)} THEN 1e0 ELSE 0e0 END",
            "inverse": lambda: f"(1e0 - {unit(f)})", "semantic": lambda: clip(f"({val(f)} + 5e-2) / 95e-2", "0e0", "1e0"),
            "clean": lambda: "(1e0 - greatest(" + ", ".join(unit(n) for n in f) + "))", "cta": lambda: f"greatest({up(f[0])}, {clip(f'{val(f[1])} / 2e0', '0e0', '1e0')})",
        }[kind]()

    def blend(parts):
        total = sum(w for w, _ in parts)
        return clip("(" + " + ".join(f"{sql} * CAST({w!r} AS DOUBLE)" for w, sql in parts) + f") / CAST({total!r} AS DOUBLE)", "0e0", "1e0")

    signals = ", ".join(f"{blend([(w, part(k, f, a)) for w, k, f, a in parts])} AS s_{name}" for name, parts in rubric.COMPONENTS.items())
    ci = f"greatest({unit('intent_is_commercial')}, {unit('intent_is_local_commercial')})"
    groups = ", ".join(f"{blend([(w, f's_{n}') for n, w in ws.items()])} AS g_{g}" for g, ws in rubric.SIGNAL_WEIGHTS.items())
    shift = lambda t: "CASE page_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 0 END"
    caps = {
        "critical_http_status_not_ok": "http_status_ok < 1", "critical_page_not_indexable": "page_indexable < 1 OR robots_noindex > 0", "critical_title_missing": "title_present < 1",
        "critical_query_title_fit_weak": "s_title_query_fit < 35e-2", "critical_semantic_query_fit_weak": "s_semantic_query_fit < 3e-1 AND keyword_coverage_ratio < 35e-2",
        "critical_intent_alignment_weak": "s_intent_alignment < 3e-1", "important_canonical_points_elsewhere": "canonical_present > 0 AND canonical_matches_final_url < 1",
        "important_commercial_trust_weak": f"s_commercial_trust < 28e-2 AND {ci} >= 5e-1", "critical_no_extracted_text": "word_count <= 0",
        "important_extremely_thin_content": "word_count > 0 AND word_count < 80", "supporting_text_insufficient": "word_count >= 80 AND word_count < 250",
    }
    cap_list = ", ".join(f"CASE WHEN {c} THEN CAST({rubric.CAPS[n]} AS DOUBLE) END" for n, c in caps.items())
    reasons = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(caps.items()))
    sig_list = ", ".join(f"{{'s': {rnd(f's_{n}', 9)}, 'p': {i}, 'n': '{n}'}}" for i, (_, n) in enumerate(rubric.SIGNALS))
    return _V + f""",
u0 AS (SELECT *, {_TYPE} AS page_type, {_WEAK} AS weak FROM v_rows),
u1 AS (SELECT *, {signals} FROM u0),
u2 AS (SELECT *, CASE WHEN {unit('intent_alignment_score')} > 0 THEN {unit('intent_alignment_score')} ELSE s_intent_fallback END AS s_intent_alignment,
  CASE WHEN {ci} >= 5e-1 THEN s_commercial_raw ELSE greatest(s_commercial_raw, 72e-2) END AS s_commercial_trust,
  CASE WHEN word_count <= 0 THEN 0e0 WHEN word_count < 80 THEN 12e-2 WHEN word_count < 250 THEN 35e-2 WHEN word_count < 600 THEN 62e-2 WHEN word_count < 1400 THEN 85e-2 ELSE 1e0 END AS s_text_sufficiency FROM u1),
u3 AS (SELECT *, {groups}, {clip('weak / 1e2', '0e0', '1e0')} AS prior FROM u2),
u4 AS (SELECT *, 1e2 * (55e-2 * g_critical + 3e-1 * g_important + 1e-1 * g_supporting + 5e-2 * prior) + CASE WHEN {ci} >= {unit('intent_is_informational')} THEN {shift(rubric.PAGE_TYPE_SHIFT['commercial'])} ELSE {shift(rubric.PAGE_TYPE_SHIFT['informational'])} END AS raw,
  coalesce(list_min([{cap_list}]), 1e2) AS cap, concat_ws('|', {reasons}) AS cap_reasons, [{sig_list}] AS sg FROM u3),
u5 AS (SELECT *, {rnd(clip('least(raw, cap)', '0e0', '100e0'), 1)} AS score FROM u4),
u6 AS (SELECT *, list_sort(list_transform(sg, lambda x: {{'o': -x.s, 'p': x.p, 'n': x.n}})) AS dn, list_sort(list_transform(sg, lambda x: {{'o': x.s, 'p': x.p, 'n': x.n}})) AS upl FROM u5),
lb AS (SELECT query, url, page_type, score AS expert_target_score, {rnd('g_critical', 6)} AS critical_score, {rnd('g_important', 6)} AS important_score, {rnd('g_supporting', 6)} AS supporting_score,
  {rnd('prior', 6)} AS rank_prior_score, cap AS cap_applied, cap_reasons,
  CASE WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'blocked' END AS quality_band,
  array_to_string(list_transform((CASE WHEN dn[1].o <= -78e-2 THEN list_filter(dn, lambda x: x.o <= -78e-2) ELSE dn[1:3] END)[1:4], lambda x: x.n), '|') AS top_positive_factors,
  array_to_string(list_transform((CASE WHEN upl[1].o <= 45e-2 THEN list_filter(upl, lambda x: x.o <= 45e-2) ELSE upl[1:3] END)[1:4], lambda x: x.n), '|') AS top_negative_factors FROM u6)"""


_RUBRIC_SQL = _rubric_sql()


@CATALOG.query("seo_rubric_labels", _RUBRIC_SQL + " SELECT * FROM lb")
def seo_rubric_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rubric.rubric_labels(_rubric_rows(spark, folder)).select(
        "query", "url", "page_type", "expert_target_score", "critical_score", "important_score", "supporting_score", "rank_prior_score", "cap_applied",
        "cap_reasons", "quality_band", "top_positive_factors", "top_negative_factors",
    )


@CATALOG.query("rubric_report", _RUBRIC_SQL + f""", h AS (SELECT 'quality_band' AS kind, quality_band AS value FROM lb UNION ALL SELECT 'page_type', page_type FROM lb
  UNION ALL SELECT 'cap_reason', unnest(string_split(cap_reasons, '|')) FROM lb WHERE cap_reasons <> '') SELECT kind, value, {big('count(*)')} AS n FROM h GROUP BY ALL""")
def rubric_report(spark: SparkSession, folder: str) -> DataFrame:
    return rubric.rubric_histograms(rubric.rubric_labels(_rubric_rows(spark, folder)))


@CATALOG.query("rubric_report_distribution", _RUBRIC_SQL + f", sc AS (SELECT 'all' AS scope, expert_target_score AS v FROM lb) SELECT scope, n, min, p25, mean, p50, p75, max FROM {_stats_sql('sc', 'scope')}")
def rubric_report_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rubric.rubric_distribution(rubric.rubric_labels(_rubric_rows(spark, folder)))


@CATALOG.query("rubric_report_examples", _RUBRIC_SQL + """, e AS (SELECT 'high' AS band, -expert_target_score AS a, 0e0 AS b, * FROM lb WHERE quality_band = 'high'
  UNION ALL SELECT 'medium', abs(expert_target_score - 72e0), 0e0, * FROM lb WHERE quality_band = 'medium' UNION ALL SELECT 'low', expert_target_score, 0e0, * FROM lb WHERE quality_band IN ('low', 'blocked')
  UNION ALL SELECT 'capped', cap_applied, -expert_target_score, * FROM lb WHERE cap_reasons <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY a, b, query, url) AS place FROM e) SELECT band, CAST(place AS INT) AS place, query, url, expert_target_score, quality_band, cap_reasons FROM f WHERE place <= 3""")
def rubric_report_examples(spark: SparkSession, folder: str) -> DataFrame:
    return rubric.rubric_examples(rubric.rubric_labels(_rubric_rows(spark, folder)))


_U = rq._u
_FIT = clip(f"25e-2 * {_U('title_keyword_coverage_ratio')} + 2e-1 * {_U('heading_query_coverage_ratio')} + 2e-1 * {_U('query_in_text')} + 15e-2 * {_U('query_in_title')} + 2e-1 * {_U('query_prominence_score')}", "0e0", "1e0")
_SEM = clip("(semantic_similarity + 5e-2) / 95e-2", "0e0", "1e0")
_EXT_SQL = _V + f""",
x0 AS (SELECT query, url, rank, {_TYPE} AS page_type, CASE WHEN rank % 3 = 0 THEN 'informational' ELSE 'commercial' END AS itn, * EXCLUDE (query, url, rank) FROM v_rows),
x1 AS (SELECT query, url, rank, {rnd(clip(f'''1e2 * (22e-2 * {_SEM} + 17e-2 * {_U('keyword_coverage_ratio')} + 18e-2 * {_U('commercial_trust_score')} + 13e-2 * {_U('technical_seo_score')} + 14e-2 * {clip('word_count / 18e2', '0e0', '1e0')} + 11e-2 * {_FIT} + 5e-2 * {clip('(100 - rank) / 1e2', '0e0', '1e0')})
  + CASE WHEN itn = 'commercial' THEN CASE page_type WHEN 'product' THEN 4e0 WHEN 'category' THEN 3e0 WHEN 'homepage' THEN 2e0 WHEN 'content' THEN -2e0 WHEN 'article' THEN -8e0 ELSE 0e0 END
    ELSE CASE page_type WHEN 'article' THEN 4e0 WHEN 'content' THEN 3e0 WHEN 'product' THEN -3e0 ELSE 0e0 END END
  - CASE WHEN word_count < 100 THEN 35e0 WHEN word_count < 250 THEN 22e0 WHEN word_count < 600 THEN 8e0 ELSE 0e0 END - CASE WHEN page_indexable < 1 THEN 15e0 ELSE 0e0 END - CASE WHEN http_status_ok < 1 THEN 20e0 ELSE 0e0 END
  - CASE WHEN {_U('commercial_trust_score')} < 25e-2 THEN 8e0 ELSE 0e0 END - CASE WHEN {_U('technical_seo_score')} < 5e-1 THEN 6e0 ELSE 0e0 END - CASE WHEN {_SEM} < 15e-2 AND {_U('keyword_coverage_ratio')} < 5e-1 THEN 12e0 ELSE 0e0 END
  - CASE WHEN title_present < 1 THEN 3e0 ELSE 0e0 END - CASE WHEN meta_description_present < 1 THEN 2e0 ELSE 0e0 END''', '0e0', '100e0'), 1)} AS score FROM x0),
x2 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank, url DESC) AS b, row_number() OVER (PARTITION BY query ORDER BY score, rank, url) AS w FROM x1)
SELECT query, 1 AS place, url, score FROM x2 WHERE b = 1 UNION ALL SELECT query, 2, url, score FROM x2 WHERE w = 1 AND b <> 1"""


@CATALOG.query("label_extremes", _EXT_SQL)
def label_extremes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rubric_rows(spark, folder).withColumn("intent", F.when(F.col("rank") % 3 == 0, "informational").otherwise("commercial"))
    return datasets.label_extremes(datasets.extreme_score(rows))


# --- preferences, feature policy, readiness ---------------------------------
@CATALOG.query("preference_split_check", _V + "," + eq.LABELS_SQL + "," + eq._COLLECTED + "," + eq.PAIRS_SQL + "," + _SPLIT_SQL + f""", t AS ({_TAMPERED}),
fo AS (SELECT DISTINCT query FROM v_rows WHERE category = 'Brand#1'), pq AS (SELECT query, count(*) AS n, count(*) FILTER (usable_for_training) AS u, count(*) FILTER (preference_strength = 'uncertain') AS z FROM o_pref GROUP BY query),
w AS (SELECT coalesce(n, 0) AS n, coalesce(u, 0) AS u, coalesce(z, 0) AS z, coalesce(partition IN ('train', 'both'), FALSE) AS t, coalesce(partition IN ('validation', 'both'), FALSE) AS v, pq.query IS NOT NULL AS hp, t.query IS NOT NULL AS s,
  (SELECT count(*) FROM fo WHERE fo.query = coalesce(pq.query, t.query)) > 0 AS f FROM pq FULL JOIN t ON pq.query = t.query),
c AS (SELECT count(*) FILTER (t) AS a, count(*) FILTER (v) AS b, count(*) FILTER (hp) AS c, count(*) FILTER (t AND v) AS d, count(*) FILTER (hp AND NOT s) AS e, count(*) FILTER (f AND u > 0) AS g, count(*) FILTER (f AND NOT hp) AS h0,
  sum(CASE WHEN t THEN n ELSE 0 END) AS i, sum(CASE WHEN v THEN n ELSE 0 END) AS j, sum(u) AS k, sum(z) AS l FROM w),
m AS (SELECT count(*) AS n FROM fo WHERE query NOT IN (SELECT query FROM pq))
SELECT {big('a')} AS train_queries, {big('b')} AS validation_queries, {big('c')} AS preference_queries, {big('d')} AS query_overlap, {big('e')} AS unknown_queries, {big('(SELECT count(*) FROM fo)')} AS focus_queries,
  {big('g')} AS focus_represented, {big('m.n')} AS focus_missing, {big('i')} AS train_preferences, {big('j')} AS validation_preferences, {big('k')} AS usable_preferences, {big('l')} AS uncertain_preferences, d = 0 AND e = 0 AND m.n = 0 AS passed FROM c, m""")
def preference_split_check(spark: SparkSession, folder: str) -> DataFrame:
    focus = load_view(spark, folder, "v_rows").filter(F.col("category") == "Brand#1").select("query")
    return preferences.preference_split_check(preferences.label_pair_counts(eq.labels(spark, folder)), _tampered(spark, folder), focus)


_POLICY = ("word_count", "text_length_chars", "sentence_count", "paragraph_count", "heading_count", "link_count", "image_count", "h1_count", "text_to_html_ratio", "title_present")


def _capped_sql(name: str) -> str:
    v = f"greatest(0e0, CAST({name} AS DOUBLE) * 15e-1)"
    return f"least({v}, {datasets.SHORTCUT_CAPS.get(name, 1.0)})"


@CATALOG.query("feature_caps", _V + " " + " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, '{'shortcut' if n in datasets.SHORTCUT_CAPS else 'bounded'}' AS kind, {big(f'count(*) FILTER (CAST({n} AS DOUBLE) * 15e-1 <> {_capped_sql(n)})')} AS affected_rows,
  CAST(max(CAST({n} AS DOUBLE) * 15e-1) AS DOUBLE) AS max_before, CAST(max({_capped_sql(n)}) AS DOUBLE) AS max_after FROM v_rows""" for n in _POLICY))
def feature_caps(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_rows").select(*[(F.col(n).cast("double") * F.lit(1.5)).alias(n) for n in _POLICY])
    return datasets.feature_caps_report(rows, _POLICY)


@CATALOG.query("dataset_readiness", _V + f""", c AS (SELECT count(DISTINCT query) AS q, count(DISTINCT category) AS c, count(DISTINCT city) AS t, count(*) FILTER (rank % 9 = 0) AS h, (SELECT max(n) FROM (SELECT count(*) AS n FROM v_rows GROUP BY domain)) AS d FROM v_rows)
SELECT 'hard_negatives_present' AS check_name, h > 0 AS passed FROM c UNION ALL SELECT 'min_queries', q >= 500 FROM c UNION ALL SELECT 'min_categories', c >= 50 FROM c UNION ALL SELECT 'min_cities', t >= 5 FROM c UNION ALL SELECT 'domain_cap', d <= 12 FROM c""")
def dataset_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return datasets.dataset_readiness(_rows(spark, folder))

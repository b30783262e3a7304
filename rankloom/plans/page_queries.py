"""Queries over raw pages: URLs, extraction, text, query-match, technical and commercial features.

The test pages carry no metadata, so known tags, links and JSON-LD blocks are
spliced into every page by page_id; the oracle derives the expected values
from the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import urls
from rankloom.functions.lexicons import DEFAULT_LEXICON, TOKEN_SUFFIXES
from rankloom.operators import datasets, extraction
from rankloom.operators import page_features as pf
from rankloom.plans.oracle_text import big, clip, host, rnd
from rankloom.plans.registry import Catalog
from rankloom.sources.tables import read_table, spread
from rankloom.sources.views import load_view, view_cte

CATALOG = Catalog()

_ROBOTS = "CASE page_id % 5 WHEN 0 THEN 'NoIndex; follow' WHEN 1 THEN 'googlebot: none' WHEN 2 THEN 'index,follow' ELSE '' END"
_CANONICAL = (
    "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '/other/place/' WHEN 2 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'HTTP:') "
    "WHEN 3 THEN CONCAT(regexp_replace(url, '[?#].*$', ''), '?zz=1') ELSE '' END"
)
_JSON = (
    "CASE page_id % 4 WHEN 0 THEN '{\"@context\":\"https://schema.org\",\"@graph\":[{\"@type\":\"Organization\",\"telephone\":\"+7\"},{\"@type\":[\"Product\",\"Thing\"],\"offers\":{\"price\":\"10\",\"priceCurrency\":\"EUR\"}}]}' "
    "WHEN 1 THEN '{broken' WHEN 2 THEN '[{\"@type\":\" FAQPage \"},{\"@type\":\"BreadcrumbList\"}]' ELSE '' END"
)
_HEAD = (
    f"CONCAT('<meta charset=\"utf-8\">', CASE WHEN {_ROBOTS} <> '' THEN CONCAT('<meta name=\"Robots\" content=\"', {_ROBOTS}, '\">') ELSE '' END, "
    "CASE WHEN page_id % 3 = 0 THEN '<meta name=\"viewport\" content=\"width=device-width\">' ELSE '' END, "
    "CASE WHEN page_id % 4 = 0 THEN '<meta name=\"description\" content=\"Good   things\">' ELSE '' END, "
    f"CASE WHEN {_CANONICAL} <> '' THEN CONCAT('<link rel=\"x canonical\" href=\"', {_CANONICAL}, '\">') ELSE '' END, "
    "CASE WHEN page_id % 7 = 0 THEN '<link rel=\"alternate\" hreflang=\"de\" href=\"/de\"><link hreflang=\"fr\" href=\"\">' ELSE '' END, "
    f"CASE WHEN {_JSON} <> '' THEN CONCAT('<script type=\"application/ld+json\">', {_JSON}, '</script>') ELSE '' END)"
)
_BLOCK = (
    "CASE page_id % 5 WHEN 0 THEN '<h2>Контакты</h2><a href=\"tel:+74951234567\">Позвонить нам</a> <button>Купить сейчас</button><form><input><input></form><p>Режим работы: пн-пт. Адрес: ул. Мира. sales@shop.example 1 500 руб. +7 (495) 123-45-67</p>' "
    "WHEN 1 THEN '<h3>Delivery</h3><img src=\"a.png\"><p>Shipping and refund, warranty 2 years. Rating 4.5 of 5</p><a href=\"https://t.me/shop\">chat</a>' "
    "WHEN 2 THEN '<form></form><strong>payment</strong>' ELSE '' END"
)
_COLUMNS = {
    "page_id": "page_id",
    "requested_url": "url",
    "final_url": "CASE WHEN page_id % 9 = 0 THEN '' ELSE url END",
    "status_code": "CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END",
    "hops": "page_id % 4",
    "x_robots": "CASE WHEN page_id % 8 = 0 THEN 'none' ELSE '' END",
    "response_time_ms": "page_id * 12.34567e0",
    "fetch_method": "CASE WHEN page_id % 3 = 1 THEN 'Browser' ELSE 'http' END",
    "html": f"replace(replace(replace(replace(html, '<meta charset=\"utf-8\">', {_HEAD}), '</article>', CONCAT({_BLOCK}, '</article>')), ' of ', ' Москвы '), ' and ', ' цены ')",
}


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    crawl = spread(read_table(spark, folder, "pages")).select(*[F.expr(e).alias(n) for n, e in _COLUMNS.items()])
    hops = F.transform(F.sequence(F.lit(0), F.col("hops")), lambda i: F.struct(F.concat(F.lit(" http://hop/"), i.cast("string")).alias("url"), F.lit(301).alias("status_code")))
    chain = F.slice(hops, 1, F.col("hops").cast("int"))
    headers = F.when(F.col("x_robots") != "", F.create_map(F.lit(" X-Robots-Tag "), F.col("x_robots"), F.lit(" "), F.lit("x")))
    parsed = extraction.extract_documents(crawl)
    return extraction.build_snapshots(
        parsed.withColumn("redirect_chain", chain).withColumn("response_headers", headers).withColumn("text", F.lit(None).cast("string")).drop("hops", "x_robots")
    )


def _unescaped(expression: str) -> str:
    return f"replace(replace(replace(regexp_replace({expression}, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"


def _squeezed(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '\\s+', ' ', 'g'))"


_TAGLESS = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
_INNER = lambda tag: _squeezed(_unescaped(f"regexp_replace(regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g')"))
_COUNT = lambda pattern: f"len(regexp_extract_all(html, '{pattern}'))"
SNAP_SQL = "WITH cr AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + f""" FROM pages),
pg AS (SELECT *, CASE WHEN final_url = '' THEN requested_url ELSE final_url END AS fin, {_squeezed(_unescaped(_TAGLESS))} AS text, {_INNER('title')} AS title, {_INNER('h1')} AS h1,
  CASE page_id % 5 WHEN 0 THEN 'Контакты' ELSE '' END AS h2, CASE page_id % 5 WHEN 1 THEN 'Delivery' ELSE '' END AS h3, CASE WHEN page_id % 4 = 0 THEN 'Good things' ELSE '' END AS descr,
  regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, {_COUNT('(?i)<p[ >]')} AS np, {_COUNT('(?i)<a[ >]')} AS na, {_COUNT('(?i)<li[ >]')} AS nl, {_COUNT('(?i)<(?:b|strong)>')} AS nb,
  CASE page_id % 5 WHEN 1 THEN 1 ELSE 0 END AS ni, CASE page_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS nf, CASE page_id % 5 WHEN 0 THEN 2 ELSE 0 END AS nin,
  CASE WHEN page_id % 4 = 3 THEN 0 ELSE 1 END AS njson FROM cr)"""


# --- URL expressions --------------------------------------------------------
_RAW = view_cte("v_raw_serp")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return load_view(spark, folder, "v_raw_serp").select("url").unionByName(read_table(spark, folder, "pages").select("url"))


_URLS = _RAW + ", u AS (SELECT url FROM v_raw_serp UNION ALL SELECT url FROM pages)"


@CATALOG.query("url_domain", _URLS + f" SELECT {host('url')} AS domain, {big('count(*)')} AS n FROM u GROUP BY 1")
def url_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


_PATH_SQL = "regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '^$', '')"
_QUERY_SQL = "CASE WHEN strpos(split_part(url, '#', 1), '?') > 0 THEN split_part(split_part(url, '#', 1), '?', 2) ELSE '' END"


@CATALOG.query("url_shape", _URLS + f" SELECT url, CAST(len(list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> '')) AS INT) AS depth, CAST(len(list_filter(string_split({_QUERY_SQL}, '&'), lambda x: x <> '')) AS INT) AS parameters, {big('count(*)')} AS n FROM u GROUP BY url")
def url_shape(spark: SparkSession, folder: str) -> DataFrame:
    counted = _links(spark, folder).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("url", urls.depth(F.col("url")).alias("depth"), F.size(urls.parameters(F.col("url"))).alias("parameters"), "n")


_ROUTE = "coalesce(nullif(rtrim({0}, '/'), ''), '/')"


@CATALOG.query("canonical_match", SNAP_SQL + f""", c AS (SELECT page_id, requested_url AS url, fin FROM pg)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 1 THEN rtrim({_PATH_SQL}, '/') = '/other/place' ELSE FALSE END AS matches FROM c""")
def canonical_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "pages").select("page_id", "url", F.expr(_CANONICAL).alias("canonical"))
    return rows.select("page_id", ((F.col("canonical") != "") & pf.canonical_matches(F.col("canonical"), F.col("url"))).alias("matches"))


_TYPED = "CASE page_id % 6 WHEN 0 THEN CONCAT(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/') WHEN 1 THEN CONCAT(url, '/Blog/x') WHEN 2 THEN CONCAT(split_part(url, '?', 1), '/Catalog') WHEN 3 THEN CONCAT(split_part(url, '?', 1), '/services') ELSE url END"


@CATALOG.query("page_type", f"""WITH t AS (SELECT page_id, {_TYPED} AS url FROM pages), p AS (SELECT page_id, lower({_PATH_SQL}) AS p FROM t)
SELECT page_id, CASE WHEN p IN ('', '/') THEN 'homepage' WHEN p LIKE '%blog%' OR p LIKE '%article%' OR p LIKE '%news%' OR p LIKE '%post%' THEN 'article' WHEN p LIKE '%product%' OR p LIKE '%catalog%' OR p LIKE '%shop%' OR p LIKE '%item%' THEN 'product'
  WHEN p LIKE '%service%' OR p LIKE '%solutions%' OR p LIKE '%category%' THEN 'category' ELSE 'content' END AS page_type FROM p""")
def page_type(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", datasets.page_type(F.expr(_TYPED)).alias("page_type"))


@CATALOG.query("url_exclusion", _URLS + f""", x AS (SELECT url, {host('url')} AS h, lower({_PATH_SQL}) AS p FROM u) SELECT url, {big('count(*)')} AS n FROM x
WHERE NOT (url LIKE 'http://%' OR url LIKE 'https://%') OR h LIKE '%youtube.%' OR h LIKE '%x.com%' OR h LIKE '%t.me%' OR p LIKE '%/video%' OR p LIKE '%/search%' OR p LIKE '%/map%' OR p LIKE '%/forum%' OR p LIKE '%/thread%' OR p LIKE '%/community%' OR p LIKE '%/wiki%' OR p LIKE '%.pdf' OR h LIKE 'forum.%' OR h LIKE '%.forum.%' GROUP BY url""")
def url_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).filter(urls.is_excluded(F.col("url"))).groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@CATALOG.query("aggregator_flag", view_cte("v_rows") + f""" SELECT domain, {big('count(*)')} AS n, {big("count(*) FILTER (regexp_matches(lower(concat_ws(' ', url, domain, title)), 'avito|market|ozon|wildberries|yandex|2gis|zoon|flamp|otzovik|irecommend|profi|youdo|tiu|pulscen|blizko|dzen'))")} AS flagged FROM v_rows GROUP BY domain""")
def aggregator_flag(spark: SparkSession, folder: str) -> DataFrame:
    flagged = urls.is_aggregator(F.col("url"), F.col("domain"), F.col("title"))
    return load_view(spark, folder, "v_rows").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"))


# --- extraction -------------------------------------------------------------
@CATALOG.query("extract_documents", SNAP_SQL + """ SELECT page_id, text, title, descr AS meta_description, lang, h1, h2, h3, CAST(np AS INT) AS paragraphs, CAST(na AS INT) AS links, CAST(nl AS INT) AS list_items,
  CAST(nb AS INT) AS strongs, ni AS images, nf AS forms, nin AS inputs FROM pg""")
def extract_documents(spark: SparkSession, folder: str) -> DataFrame:
    first = lambda name: F.coalesce(F.try_element_at(f"document.{name}", F.lit(1)), F.lit(""))
    count = lambda name, alias: F.col(f"document.counts.{name}").alias(alias)
    return snapshots(spark, folder).select(
        "page_id", "document.text", "document.title", "document.meta_description", "document.lang", first("h1_texts").alias("h1"), first("h2_texts").alias("h2"),
        first("h3_texts").alias("h3"), count("paragraph", "paragraphs"), count("link", "links"), count("list_item", "list_items"), count("strong", "strongs"),
        count("image", "images"), count("form", "forms"), count("input", "inputs"),
    )


@CATALOG.query("build_snapshots", SNAP_SQL + f""" SELECT page_id, requested_url, fin AS final_url, status_code, CAST(page_id % 4 AS INT) AS redirects, CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END AS headers,
  {rnd('response_time_ms', 4)} AS response_time_ms, fetch_method, length(text) AS text_length FROM pg""")
def build_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots(spark, folder).select(
        "page_id", "requested_url", "final_url", "status_code", F.size("redirect_chain").alias("redirects"), F.size("response_headers").alias("headers"),
        "response_time_ms", "fetch_method", F.length("text").cast("bigint").alias("text_length"),
    )


@CATALOG.query("snapshot_summary", SNAP_SQL + " SELECT page_id, title, lang, TRUE AS html_present, length(html) AS html_length_chars, length(text) AS text_length_chars, njson AS json_ld_count FROM pg")
def snapshot_summary(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.snapshot_summary(snapshots(spark, folder)).select(
        "page_id", "title", "lang", "html_present", F.col("html_length_chars").cast("bigint").alias("html_length_chars"),
        F.col("text_length_chars").cast("bigint").alias("text_length_chars"), "json_ld_count",
    )


@CATALOG.query("page_links", SNAP_SQL + f""", l AS (SELECT page_id, requested_url, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2)) AS t,
  unnest(generate_series(0, len(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1)) - 1)) AS position FROM pg)
SELECT page_id, CAST(position AS INT) AS position, href, {_squeezed(_unescaped('t'))} AS text, CASE WHEN href LIKE 'tel:%' THEN NULL WHEN href LIKE 'http%' THEN 't.me' ELSE {host('requested_url')} END AS host, CASE WHEN href LIKE 'tel:%' OR href LIKE 'http%' THEN 0 ELSE 1 END AS internal FROM l""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.page_links(snapshots(spark, folder), ["page_id"], "final_url").select("page_id", "position", "href", "text", "host", "internal")


@CATALOG.query("json_ld_objects", """SELECT page_id, position, types FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN [0, 1, 2] WHEN 2 THEN [0, 1] ELSE [] END AS ps FROM pages) z, unnest(ps) t(position),
  LATERAL (SELECT CASE WHEN page_id % 4 = 0 THEN CASE position WHEN 0 THEN '' WHEN 1 THEN 'organization' ELSE 'product,thing' END ELSE CASE position WHEN 0 THEN 'faqpage' ELSE 'breadcrumblist' END END AS types)""")
def json_ld_objects(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.json_ld_objects(snapshots(spark, folder), ["page_id"]).select("page_id", "position", F.concat_ws(",", "types").alias("types"))


@CATALOG.query("schema_types", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'organization,product,thing' WHEN 2 THEN 'breadcrumblist,faqpage' ELSE '' END AS types FROM pages")
def schema_types(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots(spark, folder).select("page_id", F.concat_ws(",", extraction.schema_types()).alias("types"))


@CATALOG.query("json_ld_key_presence", "SELECT page_id, page_id % 4 = 0 AS telephone, page_id % 4 = 0 AS price, FALSE AS review FROM pages")
def json_ld_key_presence(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"telephone": "telephone", "price": "price", "review": "review"}
    return snapshots(spark, folder).select("page_id", *[extraction.key_present(k).alias(n) for n, k in keys.items()])


_RES = {
    "dom_node_count": "(?i)<[a-zA-Z][^>]*", "script_count": "(?i)<script\\b", "stylesheet_count": "(?i)<style\\b", "noscript_count": "(?i)<noscript\\b",
}


@CATALOG.query("resource_counts", SNAP_SQL + " SELECT page_id, " + ", ".join(f"CAST({_COUNT(p)} AS INT) AS {n}" for n, p in _RES.items()) + " FROM pg")
def resource_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = extraction.resource_counts(F.expr(_COLUMNS["html"]))
    return read_table(spark, folder, "pages").select("page_id", *[c.alias(n) for n, c in counts.items()])


@CATALOG.query("render_required", "WITH g AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN html || '<div id=\"root\">' WHEN page_id % 6 = 1 THEN repeat('<script>x</script>', CAST(page_id % 8 AS INT)) ELSE html END AS h, CASE WHEN page_id % 6 = 1 THEN ' short ' ELSE html END AS t FROM pages) SELECT page_id, (page_id % 6 = 0) OR (page_id % 6 = 1 AND page_id % 8 >= 5) AS render_required FROM g")
def render_required(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit('<div id="root">'))).when(F.col("page_id") % 6 == 1, F.repeat(F.lit("<script>x</script>"), (F.col("page_id") % 8).cast("int"))).otherwise(F.col("html")).alias("h"),
        F.when(F.col("page_id") % 6 == 1, F.lit(" short ")).otherwise(F.col("html")).alias("t"),
    )
    return pages.select("page_id", extraction.render_required(F.col("h"), F.col("t")).alias("render_required"))


# --- crawl log: the events of a user on a day play the attempts at one URL ----
_ATTEMPTS = {
    "url": "CONCAT('u', CAST(user_id AS STRING), '-', CAST(day(ts) AS STRING))", "attempt": "event_id", "method": "CASE WHEN event_id % 5 = 0 THEN 'browser' ELSE 'http' END",
    "status": "CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END", "http_status": "CASE WHEN event_type = 'view' THEN 403 WHEN event_type = 'click' THEN 500 ELSE CAST(NULL AS INT) END",
    "error": "CASE event_id % 6 WHEN 0 THEN 'SSL Handshake timed out' WHEN 1 THEN 'Read timeout' WHEN 2 THEN 'Connect timeout' WHEN 3 THEN 'Captcha shown' WHEN 4 THEN '403 Forbidden' ELSE CAST(NULL AS STRING) END",
}


@CATALOG.query("fetch_outcome", "WITH a AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _ATTEMPTS.items()) + f""" FROM events), c AS (SELECT *, lower(coalesce(error, '')) AS e FROM a),
d AS (SELECT *, CASE WHEN status = 'success' THEN NULL WHEN method = 'browser' THEN CASE WHEN e LIKE '%captcha%' THEN 'captcha_detected' WHEN e LIKE '%forbidden%' THEN 'access_denied' WHEN e LIKE '%time%out%' OR e LIKE '%timed out%' THEN 'browser_timeout' ELSE 'browser_fetch_failed' END
  WHEN http_status = 403 THEN 'http_403' WHEN e LIKE '%handshake%' THEN 'tls_handshake_failed' WHEN e LIKE '%read timeout%' THEN 'read_timeout' WHEN e LIKE '%timeout%' OR e LIKE '%timed out%' THEN 'connect_timeout' ELSE 'unknown_fetch_error' END AS fetch_error_code FROM c)
SELECT url, {big('count(*) OVER (PARTITION BY url)')} AS attempts, attempt, method, status, http_status, fetch_error_code FROM d
QUALIFY row_number() OVER (PARTITION BY url ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, CASE WHEN status = 'success' THEN attempt ELSE -attempt END) = 1""")
def fetch_outcome(spark: SparkSession, folder: str) -> DataFrame:
    attempts = read_table(spark, folder, "events").select(*[F.expr(e).alias(n) for n, e in _ATTEMPTS.items()])
    return extraction.fetch_outcome(attempts)


# --- text -------------------------------------------------------------------
_TOKENS = lambda text: f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')"


@CATALOG.query("tokenize", SNAP_SQL + f", t AS (SELECT page_id, {_TOKENS('text')} AS w FROM pg) SELECT page_id, CAST(unnest(generate_series(0, len(w) - 1)) AS INT) AS pos, unnest(w) AS token FROM t")
def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots(spark, folder).select("page_id", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))


_CYRILLIC = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абсдефгхийклмнопярстуввуых')"
_STEM_SQL = lambda text: f"regexp_extract_all(regexp_replace({text}, '([\\p{{L}}\\p{{N}}_]{{4}}[\\p{{L}}\\p{{N}}_]*?)(?:{'|'.join(TOKEN_SUFFIXES)})([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g'), '[\\p{{L}}\\p{{N}}_]+')"


@CATALOG.query("stem_tokens", f"WITH s AS (SELECT doc_id, {_STEM_SQL(_CYRILLIC)} AS w FROM documents) SELECT doc_id, CAST(len(w) AS INT) AS tokens, CAST(len(list_distinct(w)) AS INT) AS stems, md5(array_to_string(w, ' ')) AS digest FROM s")
def stem_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("doc_id", tx.stemmed_tokens(F.expr(_CYRILLIC)).alias("w"))
    return rows.select("doc_id", F.size("w").alias("tokens"), F.size(F.array_distinct("w")).alias("stems"), F.md5(F.array_join("w", " ")).alias("digest"))


_STATS_SQL = SNAP_SQL + f""",
w AS (SELECT *, {_TOKENS('text')} AS w FROM pg),
ts AS (SELECT *, length(text) AS text_length_chars, length(html) AS html_length_chars, len(w) AS word_count, len(list_distinct(w)) AS unique_word_count, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS sentence_count, greatest(np, 1) AS paragraph_count,
  1 + CASE WHEN h2 <> '' THEN 1 ELSE 0 END + CASE WHEN h3 <> '' THEN 1 ELSE 0 END AS heading_count, length(array_to_string(w, '')) AS wc FROM w)"""
_STATS = {
    "text_length_chars": big("text_length_chars"), "html_length_chars": big("html_length_chars"), "word_count": big("word_count"), "unique_word_count": big("unique_word_count"),
    "sentence_count": big("sentence_count"), "paragraph_count": big("paragraph_count"), "heading_count": big("heading_count"), "unique_word_ratio": "unique_word_count * 1e0 / word_count",
    "avg_word_length": rnd("wc * 1e0 / word_count", 4), "avg_sentence_length": rnd("word_count * 1e0 / sentence_count", 4), "avg_paragraph_length": rnd("word_count * 1e0 / paragraph_count", 4),
    "inputs_per_form_ratio": "CASE WHEN nf > 0 THEN nin * 1e0 / nf ELSE 0e0 END", "link_density_per_1000_words": rnd("na * (1e3 / word_count)", 6),
    "text_to_html_ratio": rnd("text_length_chars * 1e0 / html_length_chars", 6), "title_length": big("length(title)"), "meta_description_length": big("length(descr)"),
}
_COUNTED = ("text_length_chars", "html_length_chars", "word_count", "unique_word_count", "sentence_count", "paragraph_count", "heading_count", "title_length", "meta_description_length")


@CATALOG.query("text_stats", _STATS_SQL + " SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in _STATS.items()) + " FROM ts")
def text_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = pf.text_stats(snapshots(spark, folder))
    return rows.select("page_id", *[F.col(n).cast("bigint").alias(n) if n in _COUNTED else n for n in _STATS])


# Ten pages share a query: the first three title words of the first one, plus an intent and a place term.
_QUERY_TAIL = "' the price Moscow'"


def page_query(spark: SparkSession, folder: str, parsed: DataFrame | None = None) -> DataFrame:
    """Snapshots with the query of their group of ten pages; every page is parsed once, the lead hands its title to the group."""
    rows = (snapshots(spark, folder) if parsed is None else parsed).withColumn("grp", F.floor(F.col("page_id") / 10))
    lead = F.max(F.when(F.col("page_id") % 10 == 0, F.col("document.title"))).over(Window.partitionBy("grp"))
    named = rows.withColumn("_lead", lead).filter(F.col("_lead").isNotNull())
    query = F.concat(F.array_join(F.slice(tx.tokens(F.col("_lead")), 1, 3), " "), F.lit(" the price Moscow"))
    return named.withColumn("query", query).drop("_lead").withColumn("semantic_similarity", (F.col("page_id") % 11) / 10.0)


_STEMS = lambda text: _STEM_SQL(f"lower({text})")
_MATCHED = """SELECT *, list_sum(list_transform(q, lambda t: len(list_filter(b, lambda x: x = t)))) AS tc, len(list_filter(q, lambda t: list_contains(b, t))) AS tm, list_sum(list_transform(q, lambda t: len(list_filter(ti, lambda x: x = t)))) AS tt,
  list_sum(list_transform(q, lambda t: len(list_filter(hd, lambda x: x = t)))) AS th, list_sum(list_transform(q, lambda t: len(list_filter(b[1:200], lambda x: x = t)))) AS te,
  len(list_filter(q, lambda t: list_contains(ti, t))) * 1e0 / len(q) AS tcov, len(list_filter(q, lambda t: list_contains(hd, t))) * 1e0 / len(q) AS hcov, len(q) AS ql FROM q0"""
_PQ_SQL = _STATS_SQL + f""",
ql AS (SELECT page_id // 10 AS grp, array_to_string({_TOKENS('title')}[1:3], ' ') || {_QUERY_TAIL} AS query FROM pg WHERE page_id % 10 = 0),
q0 AS (SELECT ts.*, ql.query, lower(ql.query) AS ph, {_STEMS('ql.query')} AS q, {_STEMS('text')} AS b, {_STEMS('title')} AS ti, {_STEMS('descr')} AS me, {_STEMS("h1 || ' ' || h2 || ' ' || h3")} AS hd, (page_id % 11) / 1e1 AS sim FROM ts JOIN ql ON ts.page_id // 10 = ql.grp),
q1 AS ({_MATCHED})"""
_MATCH = {
    "query_term_count": big("tc"), "query_term_matches": big("tm"), "title_query_term_count": big("tt"), "query_terms_in_headings": big("th"), "first_200_words_query_term_count": big("te"),
    "keyword_coverage_ratio": rnd("tm * 1e0 / ql", 6), "title_keyword_coverage_ratio": rnd("tcov", 6), "heading_query_coverage_ratio": rnd("hcov", 6), "query_density": rnd("tc * 1e0 / word_count", 6),
    "query_in_title": "CASE WHEN contains(lower(title), ph) THEN 1 ELSE 0 END", "exact_query_count": big("(length(text) - length(replace(lower(text), ph, ''))) // length(ph)"),
}
_MATCH_COUNTS = ("query_term_count", "query_term_matches", "title_query_term_count", "query_terms_in_headings", "first_200_words_query_term_count", "exact_query_count")


@CATALOG.query("query_match_features", _PQ_SQL + " SELECT page_id, query, " + ", ".join(f"{e} AS {n}" for n, e in _MATCH.items()) + " FROM q1")
def query_match_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = pf.query_match(pf.text_stats(page_query(spark, folder)))
    return rows.select("page_id", "query", *[F.col(n).cast("bigint").alias(n) if n in _MATCH_COUNTS else n for n in _MATCH])


def _words(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _alias_rows(aliases) -> str:
    return "MAP {" + ", ".join(f"'{t}': {_words(g)}" for t, g in aliases.items()) + "}"


_ALIASED = lambda terms, aliases: (
    f"list_transform({terms}, lambda t: CASE WHEN list_contains(b, t) THEN len(list_filter(b, lambda x: x = t)) "
    f"ELSE len(list_filter(b, lambda x: list_contains(coalesce({aliases}[t], [t]), x))) END)"
)
_CORE_SQL = _PQ_SQL + f""",
q2 AS (SELECT *, list_filter(q, lambda t: NOT list_contains({_words(DEFAULT_LEXICON.non_core_terms)}, t)) AS core, list_filter(q, lambda t: list_contains({_words(DEFAULT_LEXICON.intent_terms)}, t)) AS it,
  list_filter(q, lambda t: list_contains({_words(DEFAULT_LEXICON.geo_terms)}, t)) AS ge, {_alias_rows(DEFAULT_LEXICON.intent_aliases)} AS im, {_alias_rows(DEFAULT_LEXICON.geo_aliases)} AS gm FROM q1),
q2b AS (SELECT *, {_ALIASED('it', 'im')} AS il, {_ALIASED('ge', 'gm')} AS gl FROM q2),
q2c AS (SELECT *, coalesce(list_sum(il), 0) AS ic, coalesce(list_sum(gl), 0) AS gc, len(list_filter(il, lambda c: c > 0)) AS im_n, len(list_filter(gl, lambda c: c > 0)) AS gm_n FROM q2b),
q3 AS (SELECT *, CASE WHEN len(core) > 0 THEN core ELSE q END AS nd, core[len(core)] AS pr, len(list_filter(core, lambda t: list_contains(b, t))) AS cm, coalesce(list_sum(list_transform(core, lambda t: len(list_filter(b, lambda x: x = t)))), 0) AS cc FROM q2c),
q4 AS (SELECT *, len(list_filter(nd, lambda t: list_contains(b, t))) * 1e0 / len(nd) AS ccov,
  CASE WHEN len(nd) > len(b) THEN 0 ELSE len(list_filter(generate_series(1, len(b) - len(nd) + 1), lambda i: b[i:i + len(nd) - 1] = nd)) END AS pc,
  CASE WHEN list_contains(b, pr) THEN 1 ELSE 0 END AS pp, CASE WHEN list_contains(ti, pr) THEN 1 ELSE 0 END AS pt, CASE WHEN list_contains(hd, pr) THEN 1 ELSE 0 END AS phd FROM q3)"""
_CORE = {
    "query_core_term_count": big("cc"), "query_core_term_matches": big("cm"), "query_core_phrase_count": big("pc"), "query_intent_modifier_count": big("ic"), "query_geo_modifier_count": big("gc"),
    "query_core_keyword_coverage_ratio": rnd("ccov", 6), "query_intent_modifier_coverage_ratio": rnd("CASE WHEN len(it) > 0 THEN im_n * 1e0 / len(it) ELSE 0e0 END", 6),
    "query_geo_modifier_coverage_ratio": rnd("CASE WHEN len(ge) > 0 THEN gm_n * 1e0 / len(ge) ELSE 0e0 END", 6), "query_primary_core_term_present": "pp", "query_primary_core_term_in_title": "pt", "query_primary_core_term_in_headings": "phd",
    "core_missing_but_geo_present": "CASE WHEN gc > 0 AND pp = 0 AND ccov < 75e-2 THEN 1 ELSE 0 END", "modifier_or_geo_only_match": "CASE WHEN tm > 0 AND pp = 0 AND ccov < 75e-2 AND (ic > 0 OR gc > 0) THEN 1 ELSE 0 END",
}


@CATALOG.query("query_core_features", _CORE_SQL + " SELECT page_id, query, " + ", ".join(f"{e} AS {n}" for n, e in _CORE.items()) + " FROM q4")
def query_core_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = pf.query_core(pf.query_match(pf.text_stats(page_query(spark, folder))))
    return rows.select("page_id", "query", *[F.col(n).cast("bigint").alias(n) if n.endswith("_count") or n.endswith("_matches") else n for n in _CORE])


@CATALOG.query("phrase_count", f"""WITH d AS (SELECT doc_id, {_TOKENS('text')} AS b FROM documents), n AS (SELECT doc_id, b, b[1:2] AS nd FROM d)
SELECT doc_id, {big("CASE WHEN len(nd) = 0 OR len(nd) > len(b) THEN 0 ELSE len(list_filter(generate_series(1, len(b) - len(nd) + 1), lambda i: b[i:i + len(nd) - 1] = nd)) END")} AS phrases FROM n""")
def phrase_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").select("doc_id", tx.tokens(F.col("text")).alias("b"))
    return rows.select("doc_id", tx.phrase_count(F.slice("b", 1, 2), F.col("b")).cast("bigint").alias("phrases"))


_COMP = {
    "early_query_coverage_ratio": rnd("least(te * 1e0 / ql, 1e0)", 6), "conversion_signal_score": "(CASE WHEN nf > 0 THEN 1 ELSE 0 END + CASE WHEN nin > 0 THEN 1 ELSE 0 END + CASE WHEN ni > 0 THEN 1 ELSE 0 END + CASE WHEN nl > 0 THEN 1 ELSE 0 END) / 4e0",
    "content_link_ratio": rnd("word_count * 1e0 / greatest(na, 1)", 6), "heading_paragraph_balance": rnd("heading_count * 1e0 / paragraph_count", 6), "query_semantic_alignment": rnd("sim * (tm * 1e0 / ql)", 6),
    "title_heading_keyword_alignment": rnd("tcov * hcov", 6), "content_depth_semantic_score": rnd("sim * least(word_count / 15e2, 1e0)", 6),
    "query_prominence_score": rnd("tcov * 35e-2 + hcov * 25e-2 + least(te * 1e0 / ql, 1e0) * 25e-2 + tm * 1e0 / ql * 15e-2", 6), "title_length_quality": rnd("greatest(0e0, 1e0 - abs(length(title) - 55e0) / 55e0)", 6),
    "meta_length_quality": rnd("CASE WHEN descr = '' THEN 0e0 ELSE greatest(0e0, 1e0 - abs(length(descr) - 145e0) / 145e0) END", 6),
    "keyword_balance_score": rnd("tm * 1e0 / ql * greatest(0e0, 1e0 - least(abs(tc * 1e0 / word_count - 3e-2) / 3e-2, 1e0))", 6),
    "semantic_content_richness": rnd("sim * least(word_count / 18e2, 1e0) * least(unique_word_count * 1e0 / word_count, 1e0)", 6),
}


@CATALOG.query("composite_features", _PQ_SQL + " SELECT page_id, " + ", ".join(f"{e} AS {n}" for n, e in _COMP.items()) + " FROM q1")
def composite_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = pf.composites(pf.query_match(pf.text_stats(page_query(spark, folder))))
    return rows.select("page_id", *_COMP)


# --- intents: part and customer names with one added term play the query catalogue ---
_INTENT_QUERY = "CONCAT(p_name, CASE p_partkey % 8 WHEN 0 THEN ' купить Москва' WHEN 1 THEN ' how to choose' WHEN 2 THEN ' официальный сайт' WHEN 3 THEN ' цена отзывы' WHEN 4 THEN ' near' WHEN 5 THEN ' login account' WHEN 6 THEN ' обзор, сравнение' ELSE '' END)"


def _kw(words) -> str:
    return f"CASE WHEN len(t) = 0 THEN 0e0 ELSE least(len(list_filter(t, lambda x: list_contains({_words(words)}, x))) * 1e0 / len(t), 1e0) END"


def _boost(score: str, words, by: str) -> str:
    return f"CASE WHEN list_has_any(t, {_words(words)}) THEN least({score} + {by}, 1e0) ELSE {score} END"


from rankloom.functions import lexicons as _lx  # noqa: E402

_INTENT_STEPS = f"""t AS (SELECT *, {_TOKENS('query')} AS t FROM q),
k AS (SELECT *, {_kw(DEFAULT_LEXICON.commercial)} AS c, {_kw((*DEFAULT_LEXICON.local, *DEFAULT_LEXICON.geo_terms))} AS l, {_kw((*DEFAULT_LEXICON.helper, *DEFAULT_LEXICON.informational))} AS i, {_kw(DEFAULT_LEXICON.navigational)} AS n FROM t),
s AS (SELECT * REPLACE ({_boost('c', _lx.COMMERCIAL_BOOST, '2e-1')} AS c, {_boost('l', _lx.LOCAL_BOOST, '25e-2')} AS l, {_boost('i', _lx.INFORMATIONAL_BOOST, '2e-1')} AS i, {_boost('n', _lx.NAVIGATIONAL_BOOST, '2e-1')} AS n) FROM k),
o AS (SELECT *, list_reverse_sort([{rnd('c', 6)}, {rnd('l', 6)}, {rnd('i', 6)}, {rnd('n', 6)}]) AS o FROM s),
it AS (SELECT p_partkey, query, CASE WHEN c >= 2e-1 AND l >= 2e-1 THEN 'local_commercial' WHEN greatest(c, i, n) < 15e-2 THEN 'other' WHEN c >= i AND c >= n THEN 'commercial' WHEN i >= n THEN 'informational' ELSE 'navigational' END AS intent_label,
  {rnd('o[1] - o[2]', 6)} AS intent_confidence, {rnd('c', 6)} AS commercial_intent_score, {rnd('l', 6)} AS local_intent_score, {rnd('i', 6)} AS informational_intent_score, {rnd('n', 6)} AS navigational_intent_score,
  CASE WHEN l >= 2e-1 THEN 1 ELSE 0 END AS query_local_modifier, CASE WHEN c >= 2e-1 THEN 1 ELSE 0 END AS query_commercial_modifier, CASE WHEN i >= 2e-1 THEN 1 ELSE 0 END AS query_informational_modifier, CASE WHEN n >= 2e-1 THEN 1 ELSE 0 END AS query_navigational_modifier FROM o)"""
_INTENT_SQL = f"q AS (SELECT p_partkey, {_INTENT_QUERY} AS query FROM part), " + _INTENT_STEPS


def _intents(spark: SparkSession, folder: str) -> DataFrame:
    return pf.query_intent(read_table(spark, folder, "part").select("p_partkey", F.expr(_INTENT_QUERY).alias("query")))


@CATALOG.query("query_intent", "WITH " + _INTENT_SQL + " SELECT * FROM it")
def query_intent(spark: SparkSession, folder: str) -> DataFrame:
    return _intents(spark, folder)


_W = lambda table: "(" + " + ".join(f"{n} * {w}" for n, w in table.items()) + ")"
_E = lambda table: _W({n: f"CAST({w} AS DOUBLE)" for n, w in table.items()})
_ALIGNED = f"""
a0 AS (SELECT r.*, it.* EXCLUDE (query, p_partkey), {_E(pf.COMMON_ALIGNMENT)} AS cm, {_E(pf.COMMERCIAL_SUPPORT)} AS co, {_E(pf.LOCAL_SUPPORT)} AS lo, {_E(pf.TECHNICAL_SUPPORT)} AS te,
  content_depth_semantic_score * 35e-2 + semantic_content_richness * 3e-1 + least(heading_count / 6e0, 1e0) * 2e-1 + faq_present * 15e-2 AS inf FROM v_rows r JOIN it ON r.query = CAST(it.p_partkey AS VARCHAR)),
a1 AS (SELECT *, {clip('cm * 45e-2 + co * 4e-1 + te * 15e-2', '0e0', '1e0')} AS ac, {clip('cm * 3e-1 + co * 25e-2 + lo * 3e-1 + te * 15e-2', '0e0', '1e0')} AS al, {clip('cm * 45e-2 + inf * 4e-1 + te * 15e-2', '0e0', '1e0')} AS ai,
  {clip('cm * 35e-2 + te * 45e-2 + co * 2e-1', '0e0', '1e0')} AS an, {clip('(cm + te) / 2e0', '0e0', '1e0')} AS ao FROM a0)"""
_ALIGNMENT = {
    **{f"intent_is_{n}": f"CASE WHEN intent_label = '{n}' THEN 1 ELSE 0 END" for n in ("commercial", "local_commercial", "informational", "navigational")},
    "commercial_intent_alignment": rnd("ac", 6), "local_intent_alignment": rnd("al", 6), "informational_intent_alignment": rnd("ai", 6), "navigational_intent_alignment": rnd("an", 6),
    "intent_alignment_score": rnd("CASE intent_label WHEN 'commercial' THEN ac WHEN 'local_commercial' THEN al WHEN 'informational' THEN ai WHEN 'navigational' THEN an ELSE ao END", 6),
}
_SHOWN = ("intent_is_commercial", "intent_is_navigational", "commercial_intent_alignment", "local_intent_alignment", "informational_intent_alignment", "navigational_intent_alignment", "intent_alignment_score")
_ALIGN_SQL = view_cte("v_rows") + "," + _INTENT_SQL + "," + _ALIGNED + " SELECT query, url, " + ", ".join(f"{_ALIGNMENT[n]} AS {n}" for n in _SHOWN) + " FROM a1"


@CATALOG.query("intent_alignment", _ALIGN_SQL)
def intent_alignment(spark: SparkSession, folder: str) -> DataFrame:
    intents = _intents(spark, folder).select(F.col("p_partkey").cast("string").alias("query"), "intent_label")
    rows = pf.intent_alignment(load_view(spark, folder, "v_rows").join(intents, "query"))
    return rows.select(
        "query", "url", "intent_is_commercial", "intent_is_navigational", "commercial_intent_alignment", "local_intent_alignment", "informational_intent_alignment",
        "navigational_intent_alignment", "intent_alignment_score",
    )


# --- technical, commercial, heavy -------------------------------------------
@CATALOG.query("robots_directives", f"""SELECT page_id, CASE WHEN page_id % 5 = 1 THEN CASE WHEN page_id % 8 = 0 THEN 'nofollow,noindex,none' ELSE 'nofollow,noindex,none' END
  WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 'follow,nofollow,noindex,none' ELSE 'follow,noindex' END WHEN page_id % 5 = 2 THEN CASE WHEN page_id % 8 = 0 THEN 'follow,index,nofollow,noindex,none' ELSE 'follow,index' END
  WHEN page_id % 8 = 0 THEN 'nofollow,noindex,none' ELSE '' END AS directives FROM pages""")
def robots_directives(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshots(spark, folder)
    return rows.select("page_id", F.concat_ws(",", pf.robots_directives(F.col("document.meta_robots"), pf.header("x-robots-tag"))).alias("directives"))


_TECH_SQL = SNAP_SQL + f""",
k0 AS (SELECT *, fin AS url, status_code AS http_status_code, CASE WHEN status_code = 200 THEN 1 ELSE 0 END AS ok, CAST(page_id % 4 AS INT) AS redirect_count, CASE WHEN page_id % 6 < 4 THEN 1 ELSE 0 END AS canonical_present,
  CASE WHEN page_id % 5 < 2 OR page_id % 8 = 0 THEN 1 ELSE 0 END AS robots_noindex, CASE WHEN page_id % 5 = 1 OR page_id % 8 = 0 THEN 1 ELSE 0 END AS robots_nofollow, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS viewport_present, CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS hreflang_count FROM pg),
k1 AS (SELECT *, CASE WHEN page_id % 6 IN (0, 2) THEN 1 ELSE 0 END AS canonical_matches_final_url, len(list_filter(string_split({_PATH_SQL}, '/'), lambda x: x <> '')) AS url_depth, len(list_filter(string_split({_QUERY_SQL}, '&'), lambda x: x <> '')) AS params FROM k0),
k2 AS (SELECT *, CASE WHEN ok = 1 AND robots_noindex = 0 THEN 1 ELSE 0 END AS page_indexable, greatest(0e0, 1e0 - least(redirect_count, 3) / 3e0) AS re, greatest(0e0, 1e0 - least(url_depth, 6) / 6e0) * 6e-1 + greatest(0e0, 1e0 - least(params, 4) / 4e0) * 4e-1 AS hy,
  (viewport_present + 1) / 2e0 AS md, CASE WHEN canonical_matches_final_url = 1 THEN 1e0 WHEN canonical_present = 1 THEN 0e0 WHEN redirect_count > 0 OR params > 0 THEN 35e-2 ELSE 75e-2 END AS canonical_signal_score FROM k1)
SELECT page_id, http_status_code, redirect_count, canonical_present, canonical_matches_final_url, robots_noindex, robots_nofollow, page_indexable, viewport_present, hreflang_count, CAST(url_depth AS INT) AS url_depth, CAST(params AS INT) AS url_parameter_count,
  {rnd('re', 6)} AS redirect_efficiency_score, {rnd('hy', 6)} AS url_hygiene_score, {rnd('md', 6)} AS technical_metadata_score, canonical_signal_score, {rnd('(page_indexable + canonical_signal_score + re + hy + md) / 5e0', 6)} AS technical_seo_score FROM k2"""


@CATALOG.query("technical_seo", _TECH_SQL)
def technical_seo(spark: SparkSession, folder: str) -> DataFrame:
    return pf.technical_seo(snapshots(spark, folder)).select(
        "page_id", "http_status_code", "redirect_count", "canonical_present", "canonical_matches_final_url", "robots_noindex", "robots_nofollow", "page_indexable",
        "viewport_present", "hreflang_count", "url_depth", "url_parameter_count", "redirect_efficiency_score", "url_hygiene_score", "technical_metadata_score",
        "canonical_signal_score", "technical_seo_score",
    )


def _says(name: str) -> str:
    return "(" + " OR ".join(f"contains(sc, '{w}')" for w in pf.KEYWORDS[name]) + ")"


_G0, _G2, _B0, _B1, _B2 = "page_id % 4 = 0", "page_id % 4 = 2", "page_id % 5 = 0", "page_id % 5 = 1", "page_id % 5 = 2"
_CUR_SQL = "(?:₽|р\\.|руб(?:\\.|лей)?|€|eur|usd|\\$)"
_TRUST = {
    "phone_count": f"len(list_distinct(list_filter(list_transform(regexp_extract_all(ctx, '\\+?\\d[\\d\\s\\-()]{{8,}}\\d'), lambda x: regexp_replace(x, '\\D', '', 'g')), lambda x: length(x) >= 10))) + CASE WHEN {_G0} THEN 1 ELSE 0 END",
    "email_present": "regexp_matches(ctx, '(?i)[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}')", "address_present": f"{_says('address')}", "business_hours_present": f"{_says('business_hours')}",
    "price_present": f"{_G0} OR regexp_matches(sc, '(?:от\\s+)?\\d[\\d\\s]{{1,12}}(?:[.,]\\d{{1,2}})?\\s?{_CUR_SQL}')", "currency_present": f"{_G0} OR regexp_matches(sc, '{_CUR_SQL}')",
    "delivery_info_present": _says("delivery"), "payment_info_present": _says("payment"), "warranty_info_present": _says("warranty"), "returns_info_present": _says("returns"), "reviews_present": _says("reviews"),
    "rating_present": "regexp_matches(sc, '(?:ratingvalue|рейтинг|rating)\\D{0,12}([1-5](?:[.,]\\d)?)')", "faq_present": f"{_says('faq')} OR {_G2}", "messenger_present": _says("messenger"),
    "value_proposition_present": _says("value_proposition"), "legal_requisites_present": _says("legal"),
}
_TRUST_SQL = SNAP_SQL + f""",
lk AS (SELECT *, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS lt FROM pg),
c0 AS (SELECT *, text || ' ' || array_to_string(list_transform(regexp_extract_all(html, '(?s)<a href="([^"]*)">', 1), lambda x: lower(x)), ' ') AS ctx, lower({_squeezed("concat_ws(' ', text, array_to_string(list_transform(lt, lambda x: " + _unescaped('x') + "), ' '), CASE WHEN " + _B0 + " THEN 'Купить сейчас' END, html)")}) AS sc FROM lk),
c1 AS (SELECT *, {', '.join((e if n == 'phone_count' else f'CASE WHEN {e} THEN 1 ELSE 0 END') + f' AS {n}' for n, e in _TRUST.items())},
  len(list_filter(lt, lambda x: {' OR '.join(f"contains(lower(x), '{w}')" for w in pf.KEYWORDS['cta'])})) + CASE WHEN {_B0} THEN 1 ELSE 0 END AS calls FROM c0),
c2 AS (SELECT *, CASE WHEN phone_count > 0 THEN 1 ELSE 0 END AS phone_present, CASE WHEN calls = 0 AND {_B2} THEN 1 ELSE calls END AS cta_count, CASE WHEN legal_requisites_present = 1 OR {_G0} THEN 1 ELSE 0 END AS company_identity_present FROM c1),
c3 AS (SELECT *, CASE WHEN cta_count > 0 THEN 1 ELSE 0 END AS cta_present FROM c2),
c4 AS (SELECT *, {' + '.join(pf.COMMERCIAL_SIGNALS)} AS commercial_signal_count, {' + '.join(pf.TRUST_SIGNALS)} AS trust_signal_count, ({' + '.join(pf.CONTACT_SIGNALS)}) / 5e0 AS ct FROM c3)
SELECT page_id, {', '.join(f'CAST({n} AS INT) AS {n}' for n in (*_TRUST, 'phone_present', 'cta_present', 'cta_count', 'company_identity_present', 'commercial_signal_count', 'trust_signal_count'))}, {rnd('ct', 6)} AS contact_options_score,
  {rnd('commercial_signal_count / 9e0', 6)} AS commercial_signals_score, {rnd('trust_signal_count / 9e0', 6)} AS trust_signals_score, {rnd('(commercial_signal_count / 9e0 + trust_signal_count / 9e0 + ct) / 3e0', 6)} AS commercial_trust_score FROM c4"""


@CATALOG.query("commercial_trust", _TRUST_SQL)
def commercial_trust(spark: SparkSession, folder: str) -> DataFrame:
    return pf.commercial_trust(snapshots(spark, folder)).select("page_id", *pf.COMMERCIAL_COLUMNS)


_SD = {
    "structured_data_valid_json_ld_count": f"CASE WHEN {_G0} THEN 3 WHEN {_G2} THEN 2 ELSE 0 END", "structured_data_malformed_json_ld_count": "CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END",
    "structured_data_schema_type_count": f"CASE WHEN {_G0} THEN 3 WHEN {_G2} THEN 2 ELSE 0 END", "structured_data_business_schema_present": f"CASE WHEN {_G0} THEN 1 ELSE 0 END",
    "structured_data_offer_schema_present": f"CASE WHEN {_G0} THEN 1 ELSE 0 END", "structured_data_faq_schema_present": f"CASE WHEN {_G2} THEN 1 ELSE 0 END", "structured_data_breadcrumb_schema_present": f"CASE WHEN {_G2} THEN 1 ELSE 0 END",
}
_SD_SCORE = f"CASE page_id % 4 WHEN 0 THEN {rnd('3 / 4e0 * 35e-2 + 3 / 5e0 * 25e-2 + 15e-2 + 15e-2', 6)} WHEN 2 THEN {rnd('2 / 4e0 * 35e-2 + 2 / 5e0 * 25e-2 + 1e-1', 6)} ELSE 0e0 END"


@CATALOG.query("structured_data_score", f"SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in _SD.items())}, {_SD_SCORE} AS structured_data_score FROM pages")
def structured_data_score(spark: SparkSession, folder: str) -> DataFrame:
    return pf.structured_data(snapshots(spark, folder)).select("page_id", *_SD, "structured_data_score")


_UN = lambda e: rnd(clip(e, "0e0", "1e0"), 6)
_HEAVY_SQL = SNAP_SQL + f""",
h0 AS (SELECT *, {', '.join(f'{_COUNT(p)} AS {n}' for n, p in _RES.items())}, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS vp, CASE WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS br, length(text) * 1e0 / greatest(length(html), 1) AS ra,
  {rnd('strlen(html) / 1024e0', 4)} AS kb, {rnd('response_time_ms', 4)} AS ms, {_SD_SCORE} AS sd FROM pg),
h1 AS (SELECT *, {_UN('vp * 55e-2 + ' + _UN('least(length(text) / 18e2, 1e0)') + ' * 25e-2 + ' + _UN('1e0 - least(ni / 40e0, 1e0) * 45e-2') + ' * 2e-1')} AS mobile_readiness_score,
  {_UN('least(script_count / 35e0, 1e0) * 45e-2 + (1e0 - least(ra / 8e-2, 1e0)) * 35e-2 + br * 2e-1')} AS rendering_js_dependency_risk,
  {_UN('1e0 - (least(kb / 1024e0, 1e0) * 3e-1 + least(dom_node_count / 18e2, 1e0) * 2e-1 + least(script_count / 35e0, 1e0) * 2e-1 + least(stylesheet_count / 16e0, 1e0) * 15e-2 + least(ni / 45e0, 1e0) * 15e-2)')} AS performance_resource_complexity_score,
  CASE WHEN ms <= 0 THEN 1e0 ELSE {_UN('1e0 - least(ms / 3e3, 1e0) * 35e-2')} END AS rs FROM h0),
h2 AS (SELECT *, {_UN('1e0 - rendering_js_dependency_risk')} AS rendering_score, {_UN('performance_resource_complexity_score * 75e-2 + rs * 25e-2')} AS performance_proxy_score FROM h1),
h3 AS (SELECT *, {_UN('(sd + mobile_readiness_score + rendering_score + performance_proxy_score) / 4e0')} AS heavy_analysis_overall_score FROM h2)"""


@CATALOG.query("mobile_rendering_performance", _HEAVY_SQL + f" SELECT page_id, mobile_readiness_score, rendering_js_dependency_risk, {rnd('ra', 6)} AS rendering_text_html_ratio, rendering_score, kb AS performance_html_size_kb, performance_resource_complexity_score, performance_proxy_score FROM h3")
def mobile_rendering_performance(spark: SparkSession, folder: str) -> DataFrame:
    return pf.mobile_rendering_performance(snapshots(spark, folder)).select(
        "page_id", "mobile_readiness_score", "rendering_js_dependency_risk", "rendering_text_html_ratio", "rendering_score", "performance_html_size_kb",
        "performance_resource_complexity_score", "performance_proxy_score",
    )


@CATALOG.query("heavy_analysis", _HEAVY_SQL + " SELECT page_id, heavy_analysis_overall_score, CASE WHEN heavy_analysis_overall_score < 45e-2 THEN 'high' WHEN heavy_analysis_overall_score < 7e-1 THEN 'medium' ELSE 'low' END AS heavy_analysis_risk_level FROM h3")
def heavy_analysis(spark: SparkSession, folder: str) -> DataFrame:
    return pf.heavy_analysis(snapshots(spark, folder)).select("page_id", "heavy_analysis_overall_score", "heavy_analysis_risk_level")


# --- vectors: the lowest vector of a label plays the query --------------------
_DOT = "list_sum(list_transform(generate_series(1, len({0})), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"


@CATALOG.query("semantic_similarity", f"""WITH q AS (SELECT label, arg_min(embedding, vec_id) AS qv, min(vec_id) AS qid FROM embeddings GROUP BY label),
j AS (SELECT e.vec_id, e.label, {_DOT.format('e.embedding', 'q.qv')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.qv', 'q.qv')})) AS raw FROM embeddings e JOIN q ON e.label = q.label AND e.vec_id <> q.qid),
c AS (SELECT *, CASE WHEN raw < 0 THEN (greatest(raw, -1e0) + 1e0) / 2e0 ELSE least(raw, 1e0) END AS u FROM j)
SELECT vec_id, label, {rnd('raw', 6)} AS semantic_similarity_raw, {rnd('CASE WHEN u <= 18e-2 THEN u WHEN u <= 34e-2 THEN least(1e0, 18e-2 + (u - 18e-2) * 145e-2) ELSE least(1e0, 412e-3 + (u - 34e-2) * 85e-2) END', 6)} AS semantic_similarity FROM c""")
def semantic_similarity(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    queries = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"), F.min("vec_id").alias("query_id"))
    rows = pf.semantic_similarity(vectors.withColumnRenamed("embedding", "page_vector"), queries, "label", stretched=True)
    return rows.filter(F.col("vec_id") != F.col("query_id")).drop("query_id")


@CATALOG.query("analysis_text", _RAW + f""" SELECT query, position, url, trim(concat_ws(chr(10), CASE WHEN length(snippet) > 7 THEN snippet ELSE '' END, nullif(trim(title), ''), snippet,
  nullif(concat_ws(' ', nullif(CASE WHEN starts_with(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), 'www.') THEN substr(split_part(split_part(url, '://', 2), '/', 1), 5) ELSE split_part(split_part(url, '://', 2), '/', 1) END, ''),
    nullif(replace(replace({_PATH_SQL}, '-', ' '), '_', ' '), ''), nullif(replace({_QUERY_SQL}, '+', ' '), '')), ''))) AS analysis_text FROM v_raw_serp""")
def analysis_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = load_view(spark, folder, "v_raw_serp")
    text = F.when(F.length("snippet") > 7, F.col("snippet")).otherwise("")
    return rows.select("query", "position", "url", pf.analysis_text(text, F.col("title"), F.col("snippet"), F.col("url")).alias("analysis_text"))


# All feature families of a page for its query, from the steps above.
_TECH_HEAD, _TECH_TAIL = _TECH_SQL.split("\nSELECT page_id, ", 1)
_TRUST_HEAD, _TRUST_TAIL = _TRUST_SQL.split("\nSELECT page_id, ", 1)
_HEAVY = {
    **_SD, "structured_data_score": "sd", "mobile_viewport_present": "vp", "mobile_readiness_score": "mobile_readiness_score", "rendering_browser_fetch_used": "br", "rendering_js_dependency_risk": "rendering_js_dependency_risk",
    "rendering_text_html_ratio": rnd("ra", 6), "rendering_score": "rendering_score", "performance_html_size_kb": "kb", "performance_dom_node_count": "dom_node_count", "performance_script_count": "script_count",
    "performance_stylesheet_count": "stylesheet_count", "performance_image_count": "ni", "performance_response_time_ms": "ms", "performance_resource_complexity_score": "performance_resource_complexity_score",
    "performance_proxy_score": "performance_proxy_score", "heavy_analysis_overall_score": "heavy_analysis_overall_score", "heavy_analysis_available": "1", "structured_data_json_ld_count": "njson",
}
_EXTRA = {
    "semantic_similarity": "sim", "title_semantic_alignment": rnd("sim * tcov", 6), "heading_semantic_alignment": rnd("sim * hcov", 6),
    "cta_semantic_score": rnd(f"{_COMP['conversion_signal_score']} * sim", 6), "page_query": "query",
    "h1_count": "1", "h2_count": "CASE WHEN h2 <> '' THEN 1 ELSE 0 END", "h3_count": "CASE WHEN h3 <> '' THEN 1 ELSE 0 END", "title_present": "CASE WHEN title <> '' THEN 1 ELSE 0 END",
    "meta_description_present": "CASE WHEN descr <> '' THEN 1 ELSE 0 END", "query_in_text": "CASE WHEN contains(lower(text), ph) THEN 1 ELSE 0 END",
    "meta_query_term_count": "list_sum(list_transform(q, lambda t: len(list_filter(me, lambda x: x = t))))", "meta_keyword_coverage_ratio": rnd("len(list_filter(q, lambda t: list_contains(me, t))) * 1e0 / ql", 6),
    "link_count": "na", "image_count": "ni", "list_item_count": "nl", "strong_tag_count": "nb", "form_count": "nf", "input_count": "nin",
    **{f"{n}_density_per_1000_words": rnd(f"{c} * (1e3 / word_count)", 6) for n, c in (("image", "ni"), ("list", "nl"), ("strong", "nb"))},
    "query_core_phrase_present": "CASE WHEN pc > 0 THEN 1 ELSE 0 END", "query_intent_modifier_matches": "im_n",
}
_TECH_EXTRA = {
    "http_status_ok": "ok", "has_redirect": "CASE WHEN redirect_count > 0 THEN 1 ELSE 0 END", "meta_robots_present": "CASE WHEN page_id % 5 < 3 THEN 1 ELSE 0 END", "x_robots_tag_present": "CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END",
    "lang_present": "CASE WHEN lang <> '' THEN 1 ELSE 0 END", "hreflang_present": "CASE WHEN hreflang_count > 0 THEN 1 ELSE 0 END", "url_has_query_parameters": "CASE WHEN params > 0 THEN 1 ELSE 0 END",
}
_INTENTS = ("intent_confidence", "commercial_intent_score", "local_intent_score", "informational_intent_score", "navigational_intent_score", "query_local_modifier")
_AUDIT_STEPS = _CORE_SQL + "," + _TECH_HEAD[len(SNAP_SQL) + 1:] + "," + _TRUST_HEAD[len(SNAP_SQL) + 1:] + "," + _HEAVY_SQL[len(SNAP_SQL) + 1:] + f""",
f1 AS (SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in {**_STATS, **_MATCH, **_CORE, **_COMP, **_EXTRA}.items())} FROM q4),
f2 AS (SELECT page_id, {_TECH_TAIL}), f3 AS (SELECT page_id, {_TRUST_TAIL}), f4 AS (SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in _HEAVY.items())} FROM h3),
f5 AS (SELECT page_id, {', '.join(f'{e} AS {n}' for n, e in _TECH_EXTRA.items())} FROM k2),
v_rows AS (SELECT CAST(page_id AS VARCHAR) AS query, * FROM f1 JOIN f2 USING (page_id) JOIN f3 USING (page_id) JOIN f4 USING (page_id) JOIN f5 USING (page_id)),
q AS (SELECT page_id AS p_partkey, query FROM q4), {_INTENT_STEPS},{_ALIGNED}"""
AUDIT_COLUMNS = tuple(dict.fromkeys([
    *_STATS, *_MATCH, *_CORE, *_COMP, *[n for n in _EXTRA if n != "page_query"], *_TECH_EXTRA, "http_status_code", "redirect_count", "canonical_present", "canonical_matches_final_url", "robots_noindex", "robots_nofollow", "page_indexable",
    "viewport_present", "hreflang_count", "url_depth", "url_parameter_count", "redirect_efficiency_score", "url_hygiene_score", "technical_metadata_score", "canonical_signal_score", "technical_seo_score",
    *pf.COMMERCIAL_COLUMNS, *_HEAVY, *_INTENTS, *_ALIGNMENT,
]))
AUDIT_SQL = _AUDIT_STEPS + f", au AS (SELECT page_id, page_query AS query, {', '.join(f'CAST({_ALIGNMENT.get(c, c)} AS DOUBLE) AS {c}' for c in AUDIT_COLUMNS)} FROM a1)"


def audited(spark: SparkSession, folder: str) -> DataFrame:
    rows = pf.audit_features(page_query(spark, folder))
    return rows.select("page_id", "query", *[F.col(c).cast("double").alias(c) for c in AUDIT_COLUMNS])


@CATALOG.query("audit_features", AUDIT_SQL + " SELECT * FROM au")
def audit_features(spark: SparkSession, folder: str) -> DataFrame:
    return audited(spark, folder)

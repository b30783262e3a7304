"""From raw pages to structured documents and page snapshots."""

from __future__ import annotations

import json
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions import urls
from rankloom.functions.markup import TolerantParser
from rankloom.functions.numeric import flag, rnd
from rankloom.functions.text import strip
from rankloom.functions.urls import literal_alternation

# --- fixed values -----------------------------------------------------------
COUNTED_TAGS = {
    "p": "paragraph", "h1": "h1", "h2": "h2", "h3": "h3", "a": "link", "img": "image", "li": "list_item", "strong": "strong",
    "b": "strong", "form": "form", "input": "input",
}
CAPTURED_TAGS = frozenset({"title", "h1", "h2", "h3", "a", "button"})
HIDDEN_TAGS = frozenset({"script", "style", "noscript"})
NAMED_METAS = {"description": "meta_description", "robots": "meta_robots", "viewport": "viewport"}
PARSED_AT_ONCE = 64
RENDER_MARKERS = (
    "enable javascript", "javascript required", "please turn javascript on", "please enable cookies", "cf-browser-verification",
    "attention required", "captcha", "access denied", "__next", "__nuxt", 'id="app"', 'id="root"',
)
# --- end of fixed values ----------------------------------------------------

_STRINGS = T.ArrayType(T.StringType())


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


def document_type() -> T.StructType:
    return T.StructType(
        [
            *_texts("text", "title", "meta_description", "meta_robots", "viewport", "canonical", "lang"),
            T.StructField("json_ld", _STRINGS), T.StructField("json_ld_objects", _STRINGS), T.StructField("json_ld_malformed", T.IntegerType()),
            T.StructField("hreflang_links", T.ArrayType(T.StructType(_texts("hreflang", "href")))),
            T.StructField("links", T.ArrayType(T.StructType(_texts("href", "text", "rel")))),
            *[T.StructField(name, _STRINGS) for name in ("button_texts", "h1_texts", "h2_texts", "h3_texts")],
            T.StructField("counts", T.StructType([T.StructField(n, T.IntegerType()) for n in dict.fromkeys(COUNTED_TAGS.values())])),
        ]
    )


def _squeeze(value: str) -> str:
    return " ".join(unescape(value).split())


class _Tape(TolerantParser):
    """Records what the tokenizer sees: opened tags, closed tags and text."""

    def __init__(self) -> None:
        super().__init__()
        self.events: list[tuple] = []

    def updatepos(self, i, j):
        """Lines are not counted: nobody asks where a tag stands."""
        return j

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {str(k).lower(): str(v or "").strip() for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, None))

    def handle_data(self, data):
        self.events.append(("text", data, None))


def _linked_objects(blocks: list[str]) -> tuple[list[str], int]:
    """JSON-LD blocks flattened to objects (arrays and @graph lists opened), plus the number of unreadable blocks."""
    objects: list[str] = []
    unreadable = 0
    for block in blocks:
        try:
            waiting = [json.loads(block)]
        except ValueError:
            unreadable += 1
            continue
        while waiting:
            node = waiting.pop(0)
            if isinstance(node, list):
                waiting = node + waiting
            elif isinstance(node, dict):
                objects.append(json.dumps(node, ensure_ascii=False))
                graph = node.get("@graph")
                waiting = (graph if isinstance(graph, list) else []) + waiting
    return objects, unreadable


def read_document(html: str | None) -> dict:
    """Structured document of one page.

    A closing tag ends a capture only when it matches the innermost open one;
    text counts for every open capture; script, style and noscript are hidden.
    """
    tape = _Tape()
    tape.feed(html or "")
    tape.close()
    page = {name: "" for name in ("title", "meta_description", "meta_robots", "viewport", "canonical", "lang")}
    lists: dict[str, list] = {name: [] for name in ("json_ld", "hreflang_links", "links", "button_texts", "h1_texts", "h2_texts", "h3_texts")}
    counts = dict.fromkeys(COUNTED_TAGS.values(), 0)
    visible: list[str] = []
    captures: list[tuple[str, dict, list[str]]] = []
    hidden = 0
    linked: list[str] | None = None

    for kind, value, attrs in tape.events:
        if kind == "text":
            clean = _squeeze(value)
            if not clean:
                continue
            if linked is not None:
                linked.append(value)
            if not hidden:
                visible.append(clean)
                for _, _, heard in captures:
                    heard.append(clean)
        elif kind == "open":
            if value in COUNTED_TAGS:
                counts[COUNTED_TAGS[value]] += 1
            if value in CAPTURED_TAGS:
                captures.append((value, attrs, []))
            if value in HIDDEN_TAGS:
                hidden += 1
                if value == "script" and "application/ld+json" in attrs.get("type", "").lower():
                    linked = []
            elif value == "html":
                page["lang"] = page["lang"] or attrs.get("lang", "")
            elif value == "meta":
                slot = NAMED_METAS.get(attrs.get("name", "").lower())
                if slot and attrs.get("content") and not page[slot]:
                    page[slot] = _squeeze(attrs["content"])
            elif value == "link" and attrs.get("href"):
                if "canonical" in attrs.get("rel", "").lower().split() and not page["canonical"]:
                    page["canonical"] = attrs["href"]
                if attrs.get("hreflang"):
                    lists["hreflang_links"].append({"hreflang": attrs["hreflang"], "href": attrs["href"]})
        else:
            if value in HIDDEN_TAGS and hidden:
                hidden -= 1
                if value == "script" and linked is not None:
                    block = _squeeze(" ".join(linked))
                    lists["json_ld"] += [block] if block else []
                    linked = None
            if captures and captures[-1][0] == value:
                _, opened, heard = captures.pop()
                said = _squeeze(" ".join(heard))
                if value == "a":
                    if said or opened.get("href"):
                        lists["links"].append({"href": opened.get("href", ""), "text": said, "rel": opened.get("rel", "")})
                elif value == "title":
                    page["title"] = page["title"] or said
                elif said:
                    lists["button_texts" if value == "button" else f"{value}_texts"].append(said)

    objects, unreadable = _linked_objects(lists["json_ld"])
    return {
        "text": _squeeze(" ".join(visible)), **page, **lists, "json_ld_objects": objects, "json_ld_malformed": unreadable, "counts": counts,
    }


def document_of(html: Column) -> Column:
    """Structured document of an html column.

    An Arrow function of that one column: other columns stay in the JVM, those
    nobody reads are not scanned, and filters on them run before it.
    """
    kind = document_type()
    arrow = to_arrow_schema(T.StructType([T.StructField("document", kind)])).field("document").type

    @F.arrow_udf(kind)
    def parse(pages: pa.Array) -> pa.Array:
        # documents as Python objects take many times their size: only a few of a batch exist at once
        slices = (pages.slice(at, PARSED_AT_ONCE) for at in range(0, len(pages), PARSED_AT_ONCE))
        return pa.concat_arrays([pa.array([], type=arrow), *[pa.array([read_document(page.as_py()) for page in part], type=arrow) for part in slices]])

    return parse(html)


def extract_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``document``, parsed where the rows are: no shuffle, any number of pages.

    Parsing nested markup is the one step SQL expressions cannot do; every
    later step reads the struct this returns.
    """
    return pages.withColumn("document", document_of(F.col(html)))


def _filled(column: Column) -> Column:
    return F.nullif(strip(F.coalesce(column, F.lit(""))), F.lit(""))


def build_snapshots(crawl: DataFrame) -> DataFrame:
    """Crawl rows with a parsed ``document`` to page snapshots with defaults filled in."""
    chain = F.filter(
        F.transform("redirect_chain", lambda r: F.struct(F.trim(F.coalesce(r["url"], F.lit(""))).alias("url"), r["status_code"].alias("status_code"))),
        lambda r: r["url"] != "",
    )
    headers = F.map_from_entries(
        F.filter(
            F.transform(F.map_entries("response_headers"), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value"))),
            lambda e: e["key"] != "",
        )
    )
    return crawl.select(
        *[c for c in crawl.columns if c not in (
            "requested_url", "final_url", "status_code", "redirect_chain", "response_headers", "response_time_ms", "fetch_method", "html", "text", "document")],
        "requested_url", F.coalesce(F.nullif("final_url", F.lit("")), F.col("requested_url")).alias("final_url"),
        F.col("status_code").cast("int").alias("status_code"),
        F.coalesce(chain, F.array().cast("array<struct<url:string,status_code:int>>")).alias("redirect_chain"),
        F.coalesce(headers, F.create_map().cast("map<string,string>")).alias("response_headers"),
        rnd(F.col("response_time_ms").cast("double"), 4).alias("response_time_ms"), F.nullif("fetch_method", F.lit("")).alias("fetch_method"),
        F.nullif("html", F.lit("")).alias("html"), F.coalesce(_filled(F.col("text")), F.nullif("document.text", F.lit(""))).alias("text"), "document",
    )


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """Compact row per page: no html, no text, only their lengths."""
    return snapshots.select(
        *[c for c in snapshots.columns if c not in ("html", "text", "document")], F.col("document.title").alias("title"),
        F.col("document.canonical").alias("canonical"), F.col("document.lang").alias("lang"), (F.length(F.coalesce("html", F.lit(""))) > 0).alias("html_present"),
        F.length(F.coalesce("html", F.lit(""))).alias("html_length_chars"), F.length(F.coalesce("text", F.lit(""))).alias("text_length_chars"),
        F.size("document.json_ld").alias("json_ld_count"),
    )


def page_links(documents: DataFrame, keys: list[str], url: str) -> DataFrame:
    """One row per outgoing link with its host; a link without a host stays on the page's own."""
    rows = documents.select(*keys, F.col(url).alias("page_url"), F.posexplode_outer("document.links").alias("position", "link"))
    named = rows.filter(F.col("link").isNotNull()).select(*keys, "page_url", "position", "link.href", "link.text", "link.rel")
    web = F.col("href").rlike("^(?i)(https?:)?//")
    relative = ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.col("href").startswith("//")
    host = F.when(web, urls.domain(F.col("href"))).when(relative, urls.domain(F.col("page_url")))
    return named.withColumn("host", host).withColumn("internal", flag(F.col("host") == urls.domain(F.col("page_url")))).drop("page_url")


def json_ld_objects(documents: DataFrame, keys: list[str]) -> DataFrame:
    """One row per JSON-LD object, with its types."""
    rows = documents.select(*keys, F.posexplode("document.json_ld_objects").alias("position", "object"))
    return rows.withColumn("types", object_types(F.col("object")))


def object_types(text: Column) -> Column:
    """Lower-cased @type of an object: a string or a list of strings."""
    single = F.get_json_object(text, "$['@type']")
    listed = F.when(single.startswith("["), F.from_json(single, "array<string>")).when(F.trim(single) != "", F.array(single))
    clean = F.transform(listed, lambda t: F.lower(F.trim(t)))
    return F.coalesce(F.filter(clean, lambda t: t != ""), F.array().cast("array<string>"))


def schema_types() -> Column:
    """Distinct types over all objects of ``document``, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform("document.json_ld_objects", object_types))))


def key_present(*names: str) -> Column:
    """Does one of the keys occur at any depth of a JSON-LD object?

    Quotes inside JSON strings are escaped, so an unescaped quoted name before
    a colon can only be a key.
    """
    pattern = '"(?:' + "|".join(names) + r')"\s*:'
    return F.exists("document.json_ld_objects", lambda o: o.rlike(pattern))


def type_present(*types: str) -> Column:
    wanted = F.array(*[F.lit(t.lower()) for t in types])
    return F.arrays_overlap(schema_types(), wanted)


def resource_counts(html: Column) -> dict[str, Column]:
    """Element counts taken by regex from the raw markup."""
    count = lambda pattern: F.regexp_count(html, F.lit(f"(?i){pattern}"))
    return {
        "dom_node_count": count("<[a-zA-Z][^>]*"), "script_count": count(r"<script\b"),
        "stylesheet_count": count(r"<link\b[^>]*rel=[\"'][^\"']*stylesheet") + count(r"<style\b"), "noscript_count": count(r"<noscript\b"),
    }


def render_required(html: Column, text: Column) -> Column:
    """Pages that show a script or captcha gate instead of content."""
    lowered = F.lower(html)
    pattern = literal_alternation(RENDER_MARKERS)
    scripts = F.regexp_count(lowered, F.lit("<script"))
    return lowered.rlike(pattern) | F.lower(text).rlike(pattern) | ((F.length(F.trim(text)) < 120) & (scripts >= 5))


def fetch_error_code(error: Column, status: Column) -> Column:
    """Code of a plain fetch failure from its message and status."""
    text = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(status.isin(401, 403, 429), F.concat(F.lit("http_"), status.cast("string")))
        .when(text.contains("handshake") | text.contains("_ssl.c"), "tls_handshake_failed")
        .when(text.contains("read timeout") | text.contains("read operation timed out"), "read_timeout")
        .when(text.contains("timeout") | text.contains("timed out"), "connect_timeout")
        .otherwise("unknown_fetch_error")
    )


def browser_error_code(error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    return (
        F.when(text.contains("captcha"), "captcha_detected").when(text.contains("access denied") | text.contains("forbidden"), "access_denied")
        .when(text.contains("timeout") | text.contains("timed out"), "browser_timeout").otherwise("browser_fetch_failed")
    )


def fetch_outcome(attempts: DataFrame) -> DataFrame:
    """Final attempt per URL: the first success in order (http, retry, browser), else the last attempt."""
    coded = attempts.withColumn(
        "fetch_error_code",
        F.when(F.col("status") != "success", F.when(F.col("method") == "browser", browser_error_code(F.col("error"))).otherwise(fetch_error_code(F.col("error"), F.col("http_status")))),
    )
    good = F.col("status") == "success"
    kept = F.struct("attempt", "method", "status", "http_status", "fetch_error_code")
    return (
        coded.groupBy("url")
        .agg(F.min_by(kept, F.when(good, F.col("attempt"))).alias("won"), F.max_by(kept, "attempt").alias("last"), F.count(F.lit(1)).alias("attempts"))
        .select("url", "attempts", F.coalesce("won", "last").alias("r")).select("url", "attempts", "r.*")
    )

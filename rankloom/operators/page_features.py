"""Numeric features of pages and of (query, page) rows, all as columns over snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import urls
from rankloom.functions.lexicons import (
    COMMERCIAL_BOOST, DEFAULT_LEXICON, INFORMATIONAL_BOOST, LOCAL_BOOST, NAVIGATIONAL_BOOST, Lexicon,
)
from rankloom.functions.numeric import clip, flag, num, ratio, rnd
from rankloom.functions.urls import literal_alternation
from rankloom.operators.extraction import key_present, resource_counts, schema_types
from rankloom.operators.relevance import with_missing

# --- fixed values -----------------------------------------------------------
PHONE_PATTERN = r"(?U)((?:\+?\d[\d\s\-()]{8,}\d))"
EMAIL_PATTERN = r"((?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})"
CURRENCY_PATTERN = r"(?:₽|р\.|руб(?:\.|лей)?|€|eur|usd|\$)"
CURRENCY_MARKS = ("₽", "р.", "руб", "€", "eur", "usd", "$")
PRICE_PATTERN = r"(?U)(?:от\s+)?\d[\d\s]{1,12}(?:[.,]\d{1,2})?\s?" + CURRENCY_PATTERN
RATING_WORDS = ("рейтинг", "rating")
RATING_PATTERN = r"(?U)(?:ratingvalue|рейтинг|rating)\D{0,12}([1-5](?:[.,]\d)?)"
KEYWORDS = {
    "address": ("адрес", "ул.", "улица", "проспект", "пр-т", "дом ", "офис", "строение", "корпус", "street", "avenue", "suite"),
    "business_hours": (
        "режим работы", "часы работы", "график работы", "время работы", "opening hours", "mon", "пн-пт", "понедельник",
    ),
    "delivery": ("доставка", "shipping", "самовывоз", "курьер"),
    "payment": ("оплата", "payment", "безнал", "наличн", "карта", "visa", "mastercard"),
    "warranty": ("гаранти", "warranty"),
    "returns": ("возврат", "return", "refund", "обмен"),
    "reviews": ("отзывы", "reviews", "testimonial"),
    "faq": ("faq", "вопросы и ответы", "часто задаваемые вопросы", "ответы на вопросы"),
    "messenger": ("whatsapp", "telegram", "t.me", "wa.me", "viber", "vk.me"),
    "cta": (
        "купить", "заказать", "оставить заявку", "получить", "связаться", "позвонить", "отправить", "подобрать", "узнать цену",
        "консультац", "request", "contact", "buy", "order",
    ),
    "value_proposition": (
        "бесплатн", "скидк", "акци", "опыт", "лет на рынке", "под ключ", "официаль", "сертиф", "собственное производство",
        "от производителя", "качество", "быстро", "за 1 день", "рассроч", "выезд замерщика",
    ),
    "legal": ("инн", "огрн", "кпп", "ооо", "ип ", "реквизит", "llc", "ltd", "inc"),
}
SCHEMA_FAMILIES = {
    "business": ("corporation", "localbusiness", "organization", "professionalservice", "store"),
    "offer": ("aggregateoffer", "offer", "product", "service"),
    "faq": ("faqpage",),
    "breadcrumb": ("breadcrumblist",),
}
CONTACT_SIGNALS = ("phone_present", "email_present", "address_present", "business_hours_present", "messenger_present")
COMMERCIAL_SIGNALS = (
    "phone_present", "address_present", "business_hours_present", "price_present", "delivery_info_present", "payment_info_present",
    "faq_present", "cta_present", "value_proposition_present",
)
TRUST_SIGNALS = (
    "email_present", "address_present", "business_hours_present", "warranty_info_present", "returns_info_present", "reviews_present",
    "rating_present", "legal_requisites_present", "company_identity_present",
)
# alignment -> weights of features
COMMON_ALIGNMENT = {"semantic_similarity": 0.35, "query_semantic_alignment": 0.25, "query_prominence_score": 0.2, "keyword_coverage_ratio": 0.2}
COMMERCIAL_SUPPORT = {"commercial_signals_score": 0.45, "contact_options_score": 0.25, "conversion_signal_score": 0.15, "cta_semantic_score": 0.15}
LOCAL_SUPPORT = {"address_present": 0.35, "business_hours_present": 0.2, "phone_present": 0.2, "contact_options_score": 0.25}
TECHNICAL_SUPPORT = {"technical_seo_score": 0.55, "title_semantic_alignment": 0.25, "heading_semantic_alignment": 0.2}
# --- end of fixed values ----------------------------------------------------


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _total(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


def _weigh(weights: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [num(n) * F.lit(w) for n, w in weights.items()])


def text_stats(pages: DataFrame) -> DataFrame:
    """Adds text, structure and density features. Needs html, text and document.

    ``_tokens`` (stemmed) stays on the row for the query features.
    """
    heading = F.concat_ws(" ", "document.h1_texts", "document.h2_texts", "document.h3_texts")
    base = pages.select(
        "*", F.coalesce(F.nullif(tx.strip(_text("text")), F.lit("")), F.col("document.text"), F.lit("")).alias("_body"),
        F.col("document.title").alias("_title"), F.col("document.meta_description").alias("_meta"), F.trim(heading).alias("_heading"),
    )
    base = base.select("*", tx.tokens(F.col("_body")).alias("_words"), tx.stemmed_tokens(F.col("_body")).alias("_tokens"))
    has_text = F.length("_body") > 0
    at_least = lambda count: F.greatest(count, F.when(has_text, F.lit(1)).otherwise(F.lit(0)))
    counts = {
        "text_length_chars": F.length("_body"), "html_length_chars": F.length(_text("html")), "word_count": F.size("_words"),
        "unique_word_count": F.size(F.array_distinct("_words")),
        "word_chars": F.length(F.concat_ws("", "_words")), "sentence_count": at_least(F.regexp_count("_body", F.lit("[.!?]+"))),
        "paragraph_count": at_least(F.col("document.counts.paragraph")), "h1_count": F.col("document.counts.h1"), "h2_count": F.col("document.counts.h2"),
        "h3_count": F.col("document.counts.h3"), "link_count": F.col("document.counts.link"), "image_count": F.col("document.counts.image"),
        "list_item_count": F.col("document.counts.list_item"), "strong_tag_count": F.col("document.counts.strong"),
        "form_count": F.col("document.counts.form"), "input_count": F.col("document.counts.input"),
        "title_present": flag(F.length("_title") > 0), "title_length": F.length("_title"),
        "meta_description_present": flag(F.length("_meta") > 0), "meta_description_length": F.length("_meta"),
    }
    base = base.select("*", *[c.alias(n) for n, c in counts.items()])
    words = F.col("word_count")
    per_thousand = lambda name: rnd(F.col(name) * ratio(F.lit(1000.0), words), 6)
    return base.select(
        "*", ratio(F.col("unique_word_count"), words).alias("unique_word_ratio"), rnd(ratio(F.col("word_chars"), words), 4).alias("avg_word_length"),
        rnd(ratio(words, F.col("sentence_count")), 4).alias("avg_sentence_length"), rnd(ratio(words, F.col("paragraph_count")), 4).alias("avg_paragraph_length"),
        (F.col("h1_count") + F.col("h2_count") + F.col("h3_count")).alias("heading_count"),
        rnd(ratio(F.col("input_count"), F.col("form_count")), 6).alias("inputs_per_form_ratio"),
        per_thousand("link_count").alias("link_density_per_1000_words"), per_thousand("image_count").alias("image_density_per_1000_words"),
        per_thousand("list_item_count").alias("list_density_per_1000_words"), per_thousand("strong_tag_count").alias("strong_density_per_1000_words"),
        rnd(ratio(F.col("text_length_chars"), F.col("html_length_chars")), 6).alias("text_to_html_ratio"),
    ).drop("word_chars", "_words")


def query_match(rows: DataFrame, query: str = "query") -> DataFrame:
    """Adds term counts, coverage, exact matches and density for the row's query.

    The page's tokens are filtered once to those the query asks for; all
    counts then run over that short list.
    """
    phrase = F.lower(F.trim(_text(query)))
    base = rows.select("*", phrase.alias("_phrase"), tx.stemmed_tokens(phrase).alias("_terms"))
    wanted = lambda source: F.filter(source, lambda t: F.array_contains("_terms", t))
    base = base.select(
        "*", wanted(F.col("_tokens")).alias("_hits"), wanted(F.slice("_tokens", 1, 200)).alias("_early"), wanted(tx.stemmed_tokens(F.col("_title"))).alias("_title_hits"),
        wanted(tx.stemmed_tokens(F.col("_meta"))).alias("_meta_hits"), wanted(tx.stemmed_tokens(F.col("_heading"))).alias("_heading_hits"),
    )
    total = lambda hits: F.aggregate(F.transform("_terms", lambda t: tx.count_of(F.col(hits), t)), F.lit(0), lambda a, b: a + b)
    matches = lambda hits: F.size(F.filter("_terms", lambda t: F.array_contains(hits, t)))
    exact = F.when(F.length("_phrase") == 0, F.lit(0)).otherwise(
        ((F.length("_body") - F.length(F.replace(F.lower("_body"), F.col("_phrase"), F.lit("")))) / F.length("_phrase")).cast("int")
    )
    asked = F.size("_terms") > 0
    share = lambda count: F.when(asked, count / F.size("_terms")).otherwise(F.lit(0.0))
    base = base.select(
        "*", total("_hits").alias("query_term_count"), matches("_hits").alias("query_term_matches"), total("_title_hits").alias("title_query_term_count"),
        total("_meta_hits").alias("meta_query_term_count"), total("_heading_hits").alias("query_terms_in_headings"),
        total("_early").alias("first_200_words_query_term_count"), F.when(asked, exact).otherwise(F.lit(0)).alias("exact_query_count"),
        share(matches("_hits")).alias("_coverage"), share(matches("_title_hits")).alias("_title_coverage"), share(matches("_meta_hits")).alias("_meta_coverage"),
        share(matches("_heading_hits")).alias("_heading_coverage"),
    )
    return base.select(
        "*", rnd(F.col("_coverage"), 6).alias("keyword_coverage_ratio"), rnd(F.col("_title_coverage"), 6).alias("title_keyword_coverage_ratio"),
        rnd(F.col("_meta_coverage"), 6).alias("meta_keyword_coverage_ratio"), rnd(F.col("_heading_coverage"), 6).alias("heading_query_coverage_ratio"),
        ratio(F.col("query_term_count"), F.col("word_count")).alias("_density"), rnd(ratio(F.col("query_term_count"), F.col("word_count")), 6).alias("query_density"),
        flag((F.length("_phrase") > 0) & F.contains(F.lower("_title"), F.col("_phrase"))).alias("query_in_title"),
        flag((F.length("_phrase") > 0) & F.contains(F.lower("_body"), F.col("_phrase"))).alias("query_in_text"),
        F.when(asked, F.least(F.col("first_200_words_query_term_count") / F.size("_terms"), F.lit(1.0))).otherwise(F.lit(0.0)).alias("_early_coverage"),
    )


def query_core(rows: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, use_aliases: bool = True) -> DataFrame:
    """Splits the query into core, intent and place terms and measures each on the page."""
    intent_map = tx.alias_literal(lexicon.intent_aliases)
    geo_map = tx.alias_literal(lexicon.geo_aliases)
    base = rows.select(
        "*", F.filter("_terms", lambda t: ~tx.member(t, lexicon.non_core_terms)).alias("_core"),
        F.filter("_terms", lambda t: tx.member(t, lexicon.intent_terms)).alias("_intent"), F.filter("_terms", lambda t: tx.member(t, lexicon.geo_terms)).alias("_geo"),
    )
    expand = lambda terms, mapping: F.transform(terms, lambda t: F.coalesce(F.try_element_at(mapping, t), F.array(t)))
    base = base.select(
        "*", (expand("_intent", intent_map) if use_aliases else F.transform("_intent", lambda t: F.array(t))).alias("_intent_groups"),
        (expand("_geo", geo_map) if use_aliases else F.transform("_geo", lambda t: F.array(t))).alias("_geo_groups"),
    )
    modifiers = F.array_distinct(F.concat(F.flatten("_intent_groups"), F.flatten("_geo_groups")))
    base = base.select("*", modifiers.alias("_modifiers"))
    # named twice, the list stays a column of its own; named once, the optimizer would build it anew for each token
    hits = F.when(F.size("_modifiers") > 0, F.filter("_tokens", lambda t: F.array_contains("_modifiers", t))).otherwise(F.array().cast("array<string>"))
    base = base.select("*", hits.alias("_modifier_hits"))

    def grouped(terms: str, groups: str) -> tuple[Column, Column]:
        own = F.zip_with(terms, groups, lambda t, g: F.struct(t.alias("t"), g.alias("g")))
        counts = F.transform(
            own,
            lambda p: F.when(F.array_contains("_modifier_hits", p["t"]), tx.count_of(F.col("_modifier_hits"), p["t"])).otherwise(
                F.size(F.filter("_modifier_hits", lambda h: F.array_contains(p["g"], h)))
            ),
        )
        found = F.size(F.filter(counts, lambda c: c > 0))
        return F.aggregate(counts, F.lit(0), lambda a, b: a + b), found

    intent_count, intent_found = grouped("_intent", "_intent_groups")
    geo_count, geo_found = grouped("_geo", "_geo_groups")
    core_matches = F.size(F.filter("_core", lambda t: F.array_contains("_hits", t)))
    core_or_all = F.when(F.size("_core") > 0, F.col("_core")).otherwise(F.col("_terms"))
    primary = F.when(F.size("_core") > 0, F.element_at("_core", -1))
    share = lambda count, size: F.when(size > 0, count / size).otherwise(F.lit(0.0))
    base = base.select(
        "*", core_or_all.alias("_needle"), primary.alias("_primary"), intent_count.alias("query_intent_modifier_count"), intent_found.alias("query_intent_modifier_matches"),
        geo_count.alias("query_geo_modifier_count"), geo_found.alias("query_geo_modifier_matches"), core_matches.alias("query_core_term_matches"),
        F.aggregate(F.transform("_core", lambda t: tx.count_of(F.col("_hits"), t)), F.lit(0), lambda a, b: a + b).alias("query_core_term_count"),
    )
    needle_matches = F.size(F.filter("_needle", lambda t: F.array_contains("_hits", t)))
    inside = lambda hits: F.coalesce(F.array_contains(hits, F.col("_primary")), F.lit(False))
    base = base.select(
        "*", share(needle_matches, F.size("_needle")).alias("_core_coverage"), tx.phrase_count(F.col("_needle"), F.col("_tokens")).alias("query_core_phrase_count"),
        share(F.col("query_intent_modifier_matches"), F.size("_intent")).alias("_intent_share"), share(F.col("query_geo_modifier_matches"), F.size("_geo")).alias("_geo_share"),
        F.when(F.col("_primary").isNull(), F.lit(0)).otherwise(tx.count_of(F.col("_hits"), F.col("_primary"))).alias("query_primary_core_term_count"),
        flag(inside("_hits")).alias("query_primary_core_term_present"), flag(inside("_title_hits")).alias("query_primary_core_term_in_title"),
        flag(inside("_heading_hits")).alias("query_primary_core_term_in_headings"),
    )
    missing = (F.col("query_primary_core_term_present") == 0) & (F.col("_core_coverage") < 0.75)
    return base.select(
        "*", rnd(F.col("_core_coverage"), 6).alias("query_core_keyword_coverage_ratio"), flag(F.col("query_core_phrase_count") > 0).alias("query_core_phrase_present"),
        rnd(F.col("_intent_share"), 6).alias("query_intent_modifier_coverage_ratio"), rnd(F.col("_geo_share"), 6).alias("query_geo_modifier_coverage_ratio"),
        flag((F.col("query_geo_modifier_matches") > 0) & missing).alias("core_missing_but_geo_present"),
        flag(
            (F.col("query_term_matches") > 0) & missing & ((F.col("query_intent_modifier_matches") > 0) | (F.col("query_geo_modifier_matches") > 0))
        ).alias("modifier_or_geo_only_match"),
    )


def composites(rows: DataFrame) -> DataFrame:
    """Scores derived from text, query and semantic features; expects ``semantic_similarity``."""
    sim = num("semantic_similarity")
    conversion = (flag(F.col("form_count") > 0) + flag(F.col("input_count") > 0) + flag(F.col("image_count") > 0) + flag(F.col("list_item_count") > 0)) / 4.0
    words = F.col("word_count")
    base = rows.select("*", conversion.alias("_conversion"))
    closeness = lambda length, target: F.when(length > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(length - target) / target)).otherwise(F.lit(0.0))
    balance = F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(F.col("_density") - F.lit(0.03)) / F.lit(0.03), F.lit(1.0)))
    scores = {
        "early_query_coverage_ratio": F.col("_early_coverage"), "conversion_signal_score": F.col("_conversion"),
        "content_link_ratio": words / F.greatest(F.col("link_count"), F.lit(1)), "heading_paragraph_balance": F.when(F.col("paragraph_count") > 0, F.col("heading_count") / F.greatest(F.col("paragraph_count"), F.lit(1))).otherwise(F.lit(0.0)),
        "query_semantic_alignment": sim * F.col("_coverage"), "title_semantic_alignment": sim * F.col("_title_coverage"),
        "heading_semantic_alignment": sim * F.col("_heading_coverage"), "title_heading_keyword_alignment": F.col("_title_coverage") * F.col("_heading_coverage"),
        "content_depth_semantic_score": sim * F.least(words / F.lit(1500.0), F.lit(1.0)),
        "query_prominence_score": F.col("_title_coverage") * F.lit(0.35) + F.col("_heading_coverage") * F.lit(0.25) + F.col("_early_coverage") * F.lit(0.25) + F.col("_coverage") * F.lit(0.15),
        "title_length_quality": closeness(F.col("title_length"), 55.0), "meta_length_quality": closeness(F.col("meta_description_length"), 145.0),
        "keyword_balance_score": F.col("_coverage") * balance,
        "semantic_content_richness": sim * F.least(words / F.lit(1800.0), F.lit(1.0)) * F.least(F.col("unique_word_ratio"), F.lit(1.0)),
        "cta_semantic_score": F.col("_conversion") * sim,
    }
    return base.select("*", *[rnd(c, 6).alias(n) for n, c in scores.items()])


def robots_directives(*values: Column) -> Column:
    """Directives of robots texts, without user-agent prefixes; ``none`` also means noindex and nofollow."""
    joined = F.concat_ws(",", *values)
    pieces = F.split(F.replace(F.lower(joined), F.lit(";"), F.lit(",")), ",")
    bodies = F.transform(pieces, lambda p: F.regexp_replace(F.trim(p), "^[^:]*:", ""))
    words = F.filter(F.flatten(F.transform(bodies, lambda b: F.split(F.trim(b), r"\s+"))), lambda w: w != "")
    full = F.when(F.array_contains(words, "none"), F.concat(words, F.array(F.lit("noindex"), F.lit("nofollow")))).otherwise(words)
    return F.array_sort(F.array_distinct(full))


def _sorted_parameters(url: Column) -> Column:
    decoded = lambda p: F.coalesce(F.try_url_decode(p), p)
    return F.array_sort(F.transform(urls.parameters(url), lambda p: decoded(F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))))


def _without_dots(route: Column) -> Column:
    """Path with "." steps removed and every ".." step resolved, however many there are."""
    head = F.regexp_extract(route, "^[^?#]*", 0)
    steps = F.split(F.substring(head, F.lit(2), F.length(head)), "/")

    def walk(done: Column, step: Column) -> Column:
        return (
            F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(step == ".", done).otherwise(F.concat(done, F.array(step)))
        )

    walked = F.aggregate(steps, F.array().cast("array<string>"), walk)
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.substring(route, F.length(head) + 1, F.length(route)))


def canonical_matches(canonical: Column, final: Column) -> Column:
    """Same scheme, host and path as the final URL; parameters equal or absent from the canonical."""
    base = F.regexp_extract(final, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", 0)
    folder = F.regexp_extract(urls.path(final), "^(.*/)[^/]*$", 1)
    given = F.trim(canonical)
    query_only = F.concat(base, urls.path(final), given)
    resolved = (
        F.when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), given).when(given.startswith("//"), F.concat(urls.scheme(final), F.lit(":"), given))
        .when(given.startswith("/"), F.concat(base, _without_dots(given))).when(given.startswith("?") | given.startswith("#"), query_only)
        .otherwise(F.concat(base, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), given))))
    )
    route = lambda u: F.coalesce(F.nullif(F.regexp_replace(urls.path(u), "/+$", ""), F.lit("")), F.lit("/"))
    same = (
        (urls.scheme(resolved) == urls.scheme(final)) & (urls.domain(resolved) == urls.domain(final)) & (urls.domain(final) != "") & (route(resolved) == route(final))
    )
    return same & ((F.size(urls.parameters(resolved)) == 0) | (_sorted_parameters(resolved) == _sorted_parameters(final)))


def header(name: str) -> Column:
    """Value of a response header, names compared without case."""
    found = F.filter(F.map_entries("response_headers"), lambda e: F.lower(F.trim(e["key"])) == name)
    return F.coalesce(F.trim(F.try_element_at(found, F.lit(1))["value"]), F.lit(""))


def technical_seo(snapshots: DataFrame) -> DataFrame:
    """Adds the technical columns of a snapshot."""
    doc = lambda name: F.trim(F.coalesce(F.col(f"document.{name}"), F.lit("")))
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("requested_url"))
    base = snapshots.select(
        "*", robots_directives(doc("meta_robots"), header("x-robots-tag")).alias("_robots"), final.alias("_final"), F.coalesce("status_code", F.lit(0)).alias("http_status_code"),
        F.size("redirect_chain").alias("redirect_count"), flag(doc("canonical") != "").alias("canonical_present"), flag(doc("meta_robots") != "").alias("meta_robots_present"),
        flag(header("x-robots-tag") != "").alias("x_robots_tag_present"), flag(doc("viewport") != "").alias("viewport_present"), flag(doc("lang") != "").alias("lang_present"),
        F.size(F.filter("document.hreflang_links", lambda h: (F.trim(h["hreflang"]) != "") & (F.trim(h["href"]) != ""))).alias("hreflang_count"),
    )
    base = base.select(
        "*", flag(F.col("http_status_code").between(200, 299)).alias("http_status_ok"), flag(F.col("redirect_count") > 0).alias("has_redirect"),
        flag((F.col("canonical_present") == 1) & canonical_matches(doc("canonical"), F.col("_final"))).alias("canonical_matches_final_url"),
        flag(F.array_contains("_robots", "noindex")).alias("robots_noindex"), flag(F.array_contains("_robots", "nofollow")).alias("robots_nofollow"),
        flag(F.col("hreflang_count") > 0).alias("hreflang_present"), urls.depth(F.col("_final")).alias("url_depth"), F.size(urls.parameters(F.col("_final"))).alias("url_parameter_count"),
    )
    scale = lambda name, top: F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.col(name), F.lit(top)) / F.lit(float(top)))
    base = base.select(
        "*", flag((F.col("http_status_ok") == 1) & (F.col("robots_noindex") == 0)).alias("page_indexable"), flag(F.col("url_parameter_count") > 0).alias("url_has_query_parameters"),
        scale("redirect_count", 3).alias("_redirect"), (scale("url_depth", 6) * F.lit(0.6) + scale("url_parameter_count", 4) * F.lit(0.4)).alias("_hygiene"),
        ((F.col("viewport_present") + F.col("lang_present")) / 2.0).alias("_metadata"),
    )
    canonical = (
        F.when(F.col("canonical_matches_final_url") == 1, F.lit(1.0)).when(F.col("canonical_present") == 1, F.lit(0.0))
        .when((F.col("has_redirect") == 1) | (F.col("url_has_query_parameters") == 1), F.lit(0.35)).otherwise(F.lit(0.75))
    )
    base = base.select("*", canonical.alias("canonical_signal_score"))
    overall = (F.col("page_indexable") + F.col("canonical_signal_score") + F.col("_redirect") + F.col("_hygiene") + F.col("_metadata")) / 5.0
    return base.select(
        "*", rnd(F.col("_redirect"), 6).alias("redirect_efficiency_score"), rnd(F.col("_hygiene"), 6).alias("url_hygiene_score"),
        rnd(F.col("_metadata"), 6).alias("technical_metadata_score"), rnd(overall, 6).alias("technical_seo_score"),
    ).drop("_robots", "_final", "_redirect", "_hygiene", "_metadata")


TECHNICAL_COLUMNS = (
    "http_status_code", "http_status_ok", "redirect_count", "has_redirect", "canonical_present", "canonical_matches_final_url", "meta_robots_present",
    "x_robots_tag_present", "robots_noindex", "robots_nofollow", "page_indexable", "viewport_present", "lang_present", "hreflang_count",
    "hreflang_present", "url_depth", "url_parameter_count", "url_has_query_parameters", "redirect_efficiency_score", "url_hygiene_score",
    "technical_metadata_score", "canonical_signal_score", "technical_seo_score",
)


def commercial_trust(snapshots: DataFrame) -> DataFrame:
    """Adds contact, offer and trust columns from text, links, buttons and JSON-LD."""
    hrefs = F.transform("document.links", lambda l: F.lower(F.trim(l["href"])))
    link_texts = F.transform("document.links", lambda l: F.trim(l["text"]))
    base = snapshots.select("*", hrefs.alias("_hrefs"), link_texts.alias("_link_texts"))
    scan = tx.scan_text(_text("text"), F.array_join("_link_texts", " "), F.array_join("document.button_texts", " "), _text("html"))
    base = base.select("*", scan.alias("_scan"), F.concat_ws(" ", _text("text"), F.array_join("_hrefs", " ")).alias("_contact_text"), schema_types().alias("_schema"))
    # what a pattern needs is looked for first
    base = base.select("*", tx.contains_any(F.col("_scan"), CURRENCY_MARKS).alias("_currency"))
    says = lambda name: tx.contains_any(F.col("_scan"), KEYWORDS[name])
    typed = lambda *types: F.arrays_overlap("_schema", F.array(*[F.lit(t.lower()) for t in types]))
    digits = F.filter(
        F.transform(F.regexp_extract_all("_contact_text", F.lit(PHONE_PATTERN), F.lit(1)), lambda m: F.regexp_replace(m, r"(?U)\D", "")), lambda d: F.length(d) >= 10
    )
    clickable = F.concat("document.button_texts", "_link_texts")
    calls = F.size(F.filter(clickable, lambda t: F.lower(t).rlike(literal_alternation(KEYWORDS["cta"]))))
    base = base.select(
        "*", (F.size(F.array_distinct(digits)) + flag(key_present("telephone"))).alias("phone_count"),
        flag((F.contains("_contact_text", F.lit("@")) & F.col("_contact_text").rlike(EMAIL_PATTERN)) | F.exists("_hrefs", lambda h: h.startswith("mailto:"))).alias("email_present"),
        flag(says("address") | key_present("address") | typed("PostalAddress")).alias("address_present"),
        flag(says("business_hours") | key_present("openingHours", "openingHoursSpecification")).alias("business_hours_present"),
        flag((F.col("_currency") & F.col("_scan").rlike(PRICE_PATTERN)) | key_present("price", "lowPrice")).alias("price_present"),
        flag(F.col("_currency") | key_present("priceCurrency")).alias("currency_present"),
        flag(says("delivery") | key_present("shippingDetails", "availableDeliveryMethod")).alias("delivery_info_present"), flag(says("payment")).alias("payment_info_present"),
        flag(says("warranty") | key_present("warranty")).alias("warranty_info_present"), flag(says("returns") | key_present("hasMerchantReturnPolicy")).alias("returns_info_present"),
        flag(says("reviews") | key_present("review")).alias("reviews_present"),
        flag((tx.contains_any(F.col("_scan"), RATING_WORDS) & F.col("_scan").rlike(RATING_PATTERN)) | key_present("aggregateRating", "ratingValue")).alias("rating_present"),
        flag(says("faq") | typed("FAQPage")).alias("faq_present"),
        F.when((calls == 0) & (F.col("document.counts.form") > 0), F.lit(1)).otherwise(calls).alias("cta_count"),
        flag(F.exists("_hrefs", lambda h: h.rlike(literal_alternation(KEYWORDS["messenger"]))) | says("messenger")).alias("messenger_present"),
        flag(says("value_proposition")).alias("value_proposition_present"), flag(says("legal") | key_present("taxID", "vatID")).alias("legal_requisites_present"),
    )
    base = base.select(
        "*", flag((F.col("phone_count") > 0) | F.exists("_hrefs", lambda h: h.startswith("tel:"))).alias("phone_present"), flag(F.col("cta_count") > 0).alias("cta_present"),
        flag((F.col("legal_requisites_present") == 1) | typed("Organization", "LocalBusiness", "Corporation", "Store")).alias("company_identity_present"),
    )
    base = base.select("*", _total(COMMERCIAL_SIGNALS).alias("commercial_signal_count"), _total(TRUST_SIGNALS).alias("trust_signal_count"), (_total(CONTACT_SIGNALS) / 5.0).alias("_contact"))
    commercial, trust = F.col("commercial_signal_count") / 9.0, F.col("trust_signal_count") / 9.0
    return base.select(
        "*", rnd(F.col("_contact"), 6).alias("contact_options_score"), rnd(commercial, 6).alias("commercial_signals_score"), rnd(trust, 6).alias("trust_signals_score"),
        rnd((commercial + trust + F.col("_contact")) / 3.0, 6).alias("commercial_trust_score"),
    ).drop("_hrefs", "_link_texts", "_scan", "_contact_text", "_contact", "_schema", "_currency")


COMMERCIAL_COLUMNS = (
    "phone_present", "phone_count", "email_present", "address_present", "business_hours_present", "price_present", "currency_present",
    "delivery_info_present", "payment_info_present", "warranty_info_present", "returns_info_present", "reviews_present", "rating_present",
    "faq_present", "cta_present", "cta_count", "messenger_present", "value_proposition_present", "legal_requisites_present",
    "company_identity_present", "contact_options_score", "commercial_signal_count", "trust_signal_count", "commercial_signals_score",
    "trust_signals_score", "commercial_trust_score",
)


def structured_data(snapshots: DataFrame) -> DataFrame:
    """Adds JSON-LD counts, schema families and the structured-data score."""
    families = {f: F.array(*[F.lit(t) for t in types]) for f, types in SCHEMA_FAMILIES.items()}
    base = snapshots.select("*", schema_types().alias("_types"))
    base = base.select(
        "*", F.size("document.json_ld").alias("structured_data_json_ld_count"), F.size("document.json_ld_objects").alias("structured_data_valid_json_ld_count"),
        F.col("document.json_ld_malformed").alias("structured_data_malformed_json_ld_count"), F.size("_types").alias("structured_data_schema_type_count"),
        *[flag(F.arrays_overlap("_types", types)).alias(f"structured_data_{f}_schema_present") for f, types in families.items()],
    )
    col = lambda name: F.col(f"structured_data_{name}")
    score = (
        F.least(col("valid_json_ld_count"), F.lit(4)) / F.lit(4.0) * F.lit(0.35) + F.least(col("schema_type_count"), F.lit(5)) / F.lit(5.0) * F.lit(0.25)
        + col("business_schema_present") * F.lit(0.15) + col("offer_schema_present") * F.lit(0.15)
        + F.greatest(col("faq_schema_present"), col("breadcrumb_schema_present")) * F.lit(0.10)
        - F.least(col("malformed_json_ld_count"), F.lit(3)) / F.lit(3.0) * F.lit(0.20)
    )
    return base.select("*", rnd(clip(score, 0.0, 1.0), 6).alias("structured_data_score")).drop("_types")


def mobile_rendering_performance(snapshots: DataFrame) -> DataFrame:
    """Adds mobile, rendering-risk and resource-complexity scores."""
    html, body = _text("html"), _text("text")
    counts = resource_counts(html)
    unit = lambda c: rnd(clip(c, 0.0, 1.0), 6)
    part = lambda value, top: F.least(value / F.lit(float(top)), F.lit(1.0))
    base = snapshots.select(
        "*", counts["dom_node_count"].alias("performance_dom_node_count"), counts["script_count"].alias("performance_script_count"),
        counts["stylesheet_count"].alias("performance_stylesheet_count"), counts["noscript_count"].alias("noscript_count"),
        F.col("document.counts.image").alias("performance_image_count"), flag(F.trim("document.viewport") != "").alias("mobile_viewport_present"),
        flag(F.lower(_text("fetch_method")) == "browser").alias("rendering_browser_fetch_used"), (F.length(body) / F.greatest(F.length(html), F.lit(1))).alias("_ratio"),
        F.length(body).alias("_chars"), rnd(F.octet_length(html) / F.lit(1024.0), 4).alias("performance_html_size_kb"),
        rnd(num("response_time_ms"), 4).alias("performance_response_time_ms"),
    )
    image_pressure = unit(F.lit(1.0) - part(F.col("performance_image_count"), 40) * F.lit(0.45))
    risk = unit(
        part(F.col("performance_script_count"), 35) * F.lit(0.45) + (F.lit(1.0) - part(F.col("_ratio"), 0.08)) * F.lit(0.35) + F.col("rendering_browser_fetch_used") * F.lit(0.20)
    )
    complexity = unit(
        F.lit(1.0) - (
            part(F.col("performance_html_size_kb"), 1024) * F.lit(0.30) + part(F.col("performance_dom_node_count"), 1800) * F.lit(0.20)
            + part(F.col("performance_script_count"), 35) * F.lit(0.20) + part(F.col("performance_stylesheet_count"), 16) * F.lit(0.15)
            + part(F.col("performance_image_count"), 45) * F.lit(0.15)
        )
    )
    ms = F.col("performance_response_time_ms")
    response = F.when(ms <= 0, F.lit(1.0)).otherwise(unit(F.lit(1.0) - part(ms, 3000) * F.lit(0.35)))
    base = base.select(
        "*", unit(F.col("mobile_viewport_present") * F.lit(0.55) + unit(part(F.col("_chars"), 1800)) * F.lit(0.25) + image_pressure * F.lit(0.20)).alias("mobile_readiness_score"),
        risk.alias("rendering_js_dependency_risk"), rnd(F.col("_ratio"), 6).alias("rendering_text_html_ratio"), complexity.alias("performance_resource_complexity_score"),
        response.alias("_response"),
    )
    return base.select(
        "*", unit(F.lit(1.0) - F.col("rendering_js_dependency_risk")).alias("rendering_score"),
        unit(F.col("performance_resource_complexity_score") * F.lit(0.75) + F.col("_response") * F.lit(0.25)).alias("performance_proxy_score"),
    ).drop("_ratio", "_chars", "_response")


HEAVY_COLUMNS = (
    "heavy_analysis_available", "heavy_analysis_overall_score", "structured_data_json_ld_count", "structured_data_valid_json_ld_count",
    "structured_data_malformed_json_ld_count", "structured_data_schema_type_count", "structured_data_business_schema_present",
    "structured_data_offer_schema_present", "structured_data_faq_schema_present", "structured_data_breadcrumb_schema_present",
    "structured_data_score", "mobile_viewport_present", "mobile_readiness_score", "rendering_browser_fetch_used",
    "rendering_js_dependency_risk", "rendering_text_html_ratio", "rendering_score", "performance_html_size_kb", "performance_dom_node_count",
    "performance_script_count", "performance_stylesheet_count", "performance_image_count", "performance_response_time_ms",
    "performance_resource_complexity_score", "performance_proxy_score",
)


def heavy_analysis(snapshots: DataFrame) -> DataFrame:
    """Structured-data, mobile, rendering and performance analysis with overall score and risk level."""
    base = mobile_rendering_performance(structured_data(snapshots))
    parts = [F.col(c) for c in ("structured_data_score", "mobile_readiness_score", "rendering_score", "performance_proxy_score")]
    overall = rnd(clip(reduce(lambda a, b: a + b, parts) / 4.0, 0.0, 1.0), 6)
    base = base.select("*", F.lit(1).alias("heavy_analysis_available"), overall.alias("heavy_analysis_overall_score"))
    score = F.col("heavy_analysis_overall_score")
    return base.withColumn("heavy_analysis_risk_level", F.when(score < 0.45, "high").when(score < 0.70, "medium").otherwise("low"))


def query_intent(queries: DataFrame, query: str = "query", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Adds the four intent scores, label, confidence and modifiers of a query."""
    normal = F.lower(F.trim(_text(query)))
    base = queries.select("*", normal.alias("_q"), tx.tokens(normal).alias("_t"))

    def keyword_score(words: Sequence[str]) -> Column:
        hits = F.size(F.filter("_t", lambda t: tx.member(t, [w for w in words if " " not in w])))
        phrases = [w for w in words if " " in w]
        joined = F.array_join("_t", " ")
        both = reduce(lambda a, w: a + flag(joined.contains(w)), phrases, hits)
        return F.when(F.size("_t") == 0, F.lit(0.0)).otherwise(F.least(both / F.size("_t"), F.lit(1.0)))

    def raised(score: Column, words: Sequence[str], by: float) -> Column:
        pattern = rf"(?<!{tx.WORD})(?:{'|'.join(words)})(?!{tx.WORD})"
        return F.when(F.col("_q").rlike(pattern), F.least(score + F.lit(by), F.lit(1.0))).otherwise(score)

    local_words = tuple(dict.fromkeys([*lexicon.local, *lexicon.geo_terms]))
    informational_words = tuple(dict.fromkeys([*lexicon.helper, *lexicon.informational]))
    base = base.select(
        "*", raised(keyword_score(lexicon.commercial), COMMERCIAL_BOOST, 0.2).alias("_c"), raised(keyword_score(local_words), LOCAL_BOOST, 0.25).alias("_l"),
        raised(keyword_score(informational_words), INFORMATIONAL_BOOST, 0.2).alias("_i"), raised(keyword_score(lexicon.navigational), NAVIGATIONAL_BOOST, 0.2).alias("_n"),
    )
    best = F.greatest("_c", "_i", "_n")
    label = (
        F.when((F.col("_c") >= 0.2) & (F.col("_l") >= 0.2), "local_commercial").when(best < 0.15, "other")
        .when(F.col("_c") == best, "commercial").when(F.col("_i") == best, "informational").otherwise("navigational")
    )
    scores = {name: rnd(F.col(c), 6) for name, c in (("commercial", "_c"), ("local", "_l"), ("informational", "_i"), ("navigational", "_n"))}
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    return base.select(
        *queries.columns, label.alias("intent_label"), rnd(clip(ordered[0] - ordered[1], 0.0, 1.0), 6).alias("intent_confidence"),
        *[c.alias(f"{name}_intent_score") for name, c in scores.items()],
        *[flag(F.col(c) >= 0.2).alias(f"query_{name}_modifier") for name, c in (("local", "_l"), ("commercial", "_c"), ("informational", "_i"), ("navigational", "_n"))],
    )


ALIGNMENT_COLUMNS = (
    "intent_is_commercial", "intent_is_local_commercial", "intent_is_informational", "intent_is_navigational", "intent_confidence", "query_local_modifier",
    "commercial_intent_score", "local_intent_score", "informational_intent_score", "navigational_intent_score", "commercial_intent_alignment",
    "local_intent_alignment", "informational_intent_alignment", "navigational_intent_alignment", "intent_alignment_score",
)


def intent_alignment(rows: DataFrame, label: str = "intent_label") -> DataFrame:
    """Adds how well the page serves each intent and the one the query has."""
    common, technical = _weigh(COMMON_ALIGNMENT), _weigh(TECHNICAL_SUPPORT)
    commercial, local = _weigh(COMMERCIAL_SUPPORT), _weigh(LOCAL_SUPPORT)
    informational = (
        num("content_depth_semantic_score") * F.lit(0.35) + num("semantic_content_richness") * F.lit(0.3)
        + clip(num("heading_count") / 6.0, 0.0, 1.0) * F.lit(0.2) + num("faq_present") * F.lit(0.15)
    )
    unit = lambda c: clip(c, 0.0, 1.0)
    needed = {*COMMON_ALIGNMENT, *COMMERCIAL_SUPPORT, *LOCAL_SUPPORT, *TECHNICAL_SUPPORT, "content_depth_semantic_score", "semantic_content_richness", "heading_count", "faq_present"}
    base = with_missing(rows, sorted(needed)).select(
        "*", unit(common * F.lit(0.45) + commercial * F.lit(0.4) + technical * F.lit(0.15)).alias("_ac"),
        unit(common * F.lit(0.3) + commercial * F.lit(0.25) + local * F.lit(0.3) + technical * F.lit(0.15)).alias("_al"),
        unit(common * F.lit(0.45) + informational * F.lit(0.4) + technical * F.lit(0.15)).alias("_ai"),
        unit(common * F.lit(0.35) + technical * F.lit(0.45) + commercial * F.lit(0.2)).alias("_an"), unit((common + technical) / 2.0).alias("_ao"),
    )
    which = F.col(label)
    dominant = (
        F.when(which == "commercial", F.col("_ac")).when(which == "local_commercial", F.col("_al")).when(which == "informational", F.col("_ai"))
        .when(which == "navigational", F.col("_an")).otherwise(F.col("_ao"))
    )
    flags = {f"intent_is_{n}": flag(which == n) for n in ("commercial", "local_commercial", "informational", "navigational")}
    shown = {"commercial_intent_alignment": "_ac", "local_intent_alignment": "_al", "informational_intent_alignment": "_ai", "navigational_intent_alignment": "_an"}
    kept = [c for c in base.columns if c not in (*flags, *shown, "intent_alignment_score")]
    return base.select(
        *kept, *[c.alias(n) for n, c in flags.items()], *[rnd(F.col(c), 6).alias(n) for n, c in shown.items()], rnd(dominant, 6).alias("intent_alignment_score")
    ).drop("_ac", "_al", "_ai", "_an", "_ao")


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when sizes differ or a vector is empty or zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    usable = (F.size(left) > 0) & (F.size(left) == F.size(right))
    return F.coalesce(F.when(usable, ratio(dot(left, right), norms)), F.lit(0.0))


def calibrate(similarity: Column, stretched: bool) -> Column:
    """Similarity to 0..1; the stretched provider lifts the low middle range."""
    bounded = clip(similarity, -1.0, 1.0)
    unit = F.when(bounded < 0, (bounded + 1.0) / 2.0).otherwise(bounded)
    if not stretched:
        return unit
    return (
        F.when(unit <= 0.18, unit).when(unit <= 0.34, F.least(F.lit(1.0), F.lit(0.18) + (unit - F.lit(0.18)) * F.lit(1.45)))
        .otherwise(F.least(F.lit(1.0), F.lit(0.412) + (unit - F.lit(0.34)) * F.lit(0.85)))
    )


def semantic_similarity(pages: DataFrame, queries: DataFrame, key: str, stretched: bool = False) -> DataFrame:
    """Cosine of each page vector with its query's vector, raw and calibrated."""
    joined = pages.join(queries, key)
    raw = cosine(F.col("page_vector"), F.col("query_vector"))
    return joined.withColumn("_raw", raw).select(
        *[c for c in joined.columns if c not in ("page_vector", "query_vector")], rnd(F.col("_raw"), 6).alias("semantic_similarity_raw"),
        rnd(calibrate(F.col("_raw"), stretched), 6).alias("semantic_similarity"),
    )


def analysis_text(text: Column, title: Column, snippet: Column, url: Column) -> Column:
    """Page text, result title and snippet and the words of the URL, one per line."""
    decode = lambda part: F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)
    words = F.array(
        F.regexp_replace(urls.authority(url), r"^www\.", ""), F.translate(decode(urls.path(url)), "-_", "  "), F.replace(decode(urls.query_string(url)), F.lit("+"), F.lit(" "))
    )
    context = F.array_join(F.filter(words, lambda w: w != ""), " ")
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.trim(F.concat_ws("\n", F.trim(F.coalesce(text, F.lit(""))), filled(title), filled(snippet), F.nullif(context, F.lit(""))))


def audit_features(rows: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Every feature of (query, page) rows: snapshot columns, query and semantic_similarity in, one wide row out.

    The steps only add columns, so the plan is a chain of projections over the
    scan with no exchange. Helper columns and the page itself are dropped.
    """
    with_text = composites(query_core(query_match(text_stats(rows)), lexicon))
    with_page = heavy_analysis(commercial_trust(technical_seo(with_text)))
    complete = intent_alignment(query_intent(with_page, "query", lexicon))
    return complete.drop(*[c for c in complete.columns if c.startswith("_")], "html", "text", "document", "response_headers", "redirect_chain")


CORE_COLUMNS = (
    "query_core_term_count", "query_core_term_matches", "query_core_keyword_coverage_ratio", "query_core_phrase_count", "query_core_phrase_present",
    "query_intent_modifier_count", "query_intent_modifier_matches", "query_intent_modifier_coverage_ratio",
)


def query_core_dataset(rows: DataFrame, snapshots: DataFrame, key: str = "artifact_id", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """``rows`` with the query-core columns, measured on all the words known of a page, and ``fallback``.

    Those are the words of its snapshot (``text``, ``document.title``), if
    there is one, and of the row's title, snippet, URL and domain.
    ``fallback`` marks rows whose snapshot is missing or says nothing.
    """
    said = F.concat_ws(" ", *[F.nullif(tx.strip(_text(c)), F.lit("")) for c in ("text", "document.title")])
    known = snapshots.select(F.col(key).alias("_key"), said.alias("_said"))
    joined = rows.join(known, F.col(key) == F.col("_key"), "left").drop("_key")
    parts = [F.nullif(tx.strip(_text(c)), F.lit("")) for c in ("_said", "title", "snippet", "url", "domain")]
    phrase = F.lower(F.trim(_text("query")))
    measured = joined.select(
        *rows.columns, flag(F.length(tx.strip(_text("_said"))) == 0).alias("fallback"), tx.stemmed_tokens(F.concat_ws(" ", *parts)).alias("_tokens"), tx.stemmed_tokens(phrase).alias("_terms"),
    )
    return query_core_counts(measured, lexicon).select(*rows.columns, "fallback", *CORE_COLUMNS)


def query_core_counts(rows: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The core and intent counts of ``_terms`` in ``_tokens``, without the aliases that page features allow."""
    base = rows.select(
        "*", F.filter("_terms", lambda t: ~tx.member(t, lexicon.non_core_terms)).alias("_core"), F.filter("_terms", lambda t: tx.member(t, lexicon.intent_terms)).alias("_intent"),
        F.filter("_tokens", lambda t: F.array_contains("_terms", t)).alias("_hits"),
    )
    total = lambda terms: F.aggregate(F.transform(terms, lambda t: tx.count_of(F.col("_hits"), t)), F.lit(0), lambda a, b: a + b)
    found = lambda terms: F.size(F.filter(terms, lambda t: F.array_contains("_hits", t)))
    share = lambda terms: F.when(F.size(terms) > 0, found(terms) / F.size(terms)).otherwise(F.lit(0.0))
    needle = F.when(F.size("_core") > 0, F.col("_core")).otherwise(F.col("_terms"))
    base = base.select("*", needle.alias("_needle")).select("*", tx.phrase_count(F.col("_needle"), F.col("_tokens")).alias("_phrases"))
    values = {
        "query_core_term_count": total(F.col("_core")), "query_core_term_matches": found(F.col("_core")), "query_core_keyword_coverage_ratio": rnd(share(F.col("_needle")), 6),
        "query_core_phrase_count": F.col("_phrases"), "query_core_phrase_present": flag(F.col("_phrases") > 0), "query_intent_modifier_count": total(F.col("_intent")),
        "query_intent_modifier_matches": found(F.col("_intent")), "query_intent_modifier_coverage_ratio": rnd(share(F.col("_intent")), 6),
    }
    own = [c for c in rows.columns if c not in values]
    return base.select(*own, *[v.cast("double").alias(n) for n, v in values.items()])


def enrich_dataset(rows: DataFrame, snapshots: DataFrame, key: str = "artifact_id") -> DataFrame:
    """``rows`` with the heavy-analysis columns of their snapshot and the intent columns of their query, and ``artifact_found``.

    Rows without a snapshot have 0 in the heavy columns. Alignment reads the
    row's own features.
    """
    heavy = heavy_analysis(snapshots).select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_h_{c}") for c in HEAVY_COLUMNS])
    joined = rows.drop(*HEAVY_COLUMNS, *ALIGNMENT_COLUMNS).join(heavy, F.col(key) == F.col("_key"), "left")
    filled = joined.select(
        *[c for c in joined.columns if not c.startswith("_h_") and c != "_key"], flag(F.col("_key").isNotNull()).alias("artifact_found"),
        *[F.coalesce(F.col(f"_h_{c}"), F.lit(0.0)).alias(c) for c in HEAVY_COLUMNS],
    )
    return intent_alignment(query_intent(filled)).drop("intent_label")


def enrichment_counts() -> dict[str, Column]:
    """What the report says of enriched rows: aggregates to observe while they are written."""
    return {
        "rows_count": F.count(F.lit(1)), "source_artifacts_found": F.count_if(F.col("artifact_found") == 1), "source_artifacts_missing": F.count_if(F.col("artifact_found") == 0),
        "rows_with_heavy_features": F.count_if(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in HEAVY_COLUMNS])),
        "rows_with_intent_alignment": F.count_if(F.col("intent_alignment_score") > 0),
    }


def core_counts() -> dict[str, Column]:
    """What the report says of a query-core dataset, besides its coverage percentiles."""
    return {"rows_count": F.count(F.lit(1)), "fallback_rows_count": F.count_if(F.col("fallback") == 1), "rows_with_core_phrase": F.count_if(F.col("query_core_phrase_present") == 1)}


def feature_matrix(rows: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ordered feature vector with absent values as 0, next to the target."""
    from pyspark.ml.feature import VectorAssembler

    filled = rows.select(*keys, F.col(target).cast("double").alias("label"), *[num(f).alias(f) for f in features])
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled).select(*keys, "label", "features")

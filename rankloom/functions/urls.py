"""URL expressions built on try_parse_url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: result filter lists -------------------------------------
BLOCKED_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z", ".apk", ".dmg", ".exe",
)
BLOCKED_DOMAIN_MARKERS = (
    "youtube.", "youtu.be", "vk.com", "ok.ru", "facebook.com", "instagram.com", "tiktok.com", "linkedin.com",
    "twitter.com", "x.com", "t.me", "reddit.com", "wikipedia.org", "2gis.", "maps.yandex.", "apple.com",
    "apps.apple.com", "play.google.com",
)
BLOCKED_PATH_MARKERS = (
    "/search", "/maps", "/map", "/video", "/videos", "/forum", "/thread", "/threads", "/community", "/wiki",
)
AGGREGATOR_HINTS = (
    "avito", "market", "ozon", "wildberries", "yandex", "2gis", "zoon", "flamp", "otzovik", "irecommend", "profi",
    "youdo", "tiu", "pulscen", "blizko", "dzen",
)
ARTICLE_PATH_TOKENS = ("blog", "article", "articles", "news", "guide", "how-to")
# --- end of fixed values ----------------------------------------------------


def literal_alternation(markers: tuple[str, ...] | list[str]) -> str:
    """One regex for "contains any of these literal strings"."""
    special = set(".^$*+?{}[]\\|()-")
    escaped = ["".join("\\" + ch if ch in special else ch for ch in marker) for marker in markers]
    return "(?:" + "|".join(escaped) + ")"


def url_part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def authority(url: Column) -> Column:
    """Text between // and the next of / ? #, empty for relative URLs."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Lower-case host and port without one leading www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def path(url: Column) -> Column:
    """Path part by splitting, which also accepts URLs a strict parser refuses."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda part: part != ""))


def parameters(url: Column) -> Column:
    """Query parameters, blank values kept, empty pieces dropped."""
    return F.filter(F.split(query_string(url), "&"), lambda part: part != "")


def is_excluded(url: Column) -> Column:
    host = F.lower(authority(url))
    route = F.lower(path(url))
    return (
        ~url.rlike("^https?://")
        | host.rlike(literal_alternation(BLOCKED_DOMAIN_MARKERS))
        | route.rlike(literal_alternation(BLOCKED_PATH_MARKERS))
        | route.rlike(literal_alternation(BLOCKED_EXTENSIONS) + "$")
        | host.startswith("forum.")
        | host.contains(".forum.")
    )


def is_aggregator(url: Column, host: Column, title: Column) -> Column:
    haystack = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(host, F.lit("")), F.coalesce(title, F.lit(""))))
    return haystack.rlike(literal_alternation(AGGREGATOR_HINTS))

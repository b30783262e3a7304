"""Main text of web pages: repeated runs of the host, and markup where it speaks.

What stands in an article (or main) is content. All other text of a page,
furniture included, joins the token stream of its host, and what runs that the
host repeats cover is cut. What they leave is checked by markup: menus,
footers, forms, scripts and the like are no content either. A run of ``least``
tokens is boilerplate by its share of the host's different pages
and by its place: it goes where only furniture or other such runs lie between
it and the head or foot of the page. What stands within a page's own text goes
only if nearly all pages of a larger host have it, and a run on a handful of
pages goes only from pages with text of their own, as copies have none.

A suffix array of a host would put the suffixes with a common beginning next
to one another. Here the suffixes are grouped by the hash of their first
``least`` tokens, which are all that decide whether a run is repeated; groups
are spread over the cluster and counted before they are shuffled, so a host
with a third of all pages is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.markup import TolerantParser
from rankloom.llm.common import bytes_of, limit_batches, runs, stored, windows, word_hashes

# Elements and names of what is not an article's text.
FURNITURE = frozenset("nav header footer aside form button select option textarea input label dialog menu noscript script style template iframe object svg canvas video audio head title".split())
NAMES = re.compile(
    r"(^|[-_\s])(nav|navbar|menu|header|footer|sidebar|aside|ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|cookie|cookies|consent|notice|comment|comments|disqus|share|social|related|recommended|"
    r"breadcrumb|breadcrumbs|newsletter|subscribe|popup|modal|login|search|pagination|widget)([-_\s]|$)", re.I)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT, OPEN, OTHER = 2, 1, 0
# how many pages of a host have a run
SOME, MANY, NEARLY_ALL = 1, 2, 3


# Which open elements a start tag ends, as the HTML standard has it, and what it does not look beyond.
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
_P_ENDS = _HEADINGS | frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form header hr li main menu nav ol p pre section table ul".split())
_P_SCOPE = frozenset("button caption html object table td template th".split())
_SPECIAL = frozenset("article aside blockquote body button details dialog fieldset footer form header html main menu nav ol section table td template th ul".split())
_IMPLIED = {
    **dict.fromkeys(_P_ENDS, [(("p",), _P_SCOPE), (("label",), _P_SCOPE)]),
    **{t: [((t,), barrier)] for t, barrier in {"tr": frozenset(("table", "template")), "option": frozenset(("select", "datalist"))}.items()},
    **dict.fromkeys(("td", "th"), [(("td", "th"), frozenset(("tr", "table", "template")))]),
    **dict.fromkeys(("thead", "tbody", "tfoot"), [(("thead", "tbody", "tfoot"), frozenset(("table", "template")))]),
}
_IMPLIED["li"] = [(("li",), _SPECIAL | {"dd", "dl", "dt"}), *_IMPLIED["li"]]
_IMPLIED["dd"] = _IMPLIED["dt"] = [(("dd", "dt"), _SPECIAL | {"dl", "li"}), *_IMPLIED["dd"]]
# blocks that hold running text: their id names a place in the text and not a part of the page
_TEXTUAL = _HEADINGS | frozenset("blockquote caption dd dt figcaption legend li p pre summary td th".split())


class _Blocks(TolerantParser):
    """Collects (standing, text) of the blocks of a page in order.

    Elements that HTML ends by itself end here too. The places of the open
    elements are known by name, so no tag looks through all of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, int]] = []  # element, standing of what is inside
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a name are
        self.shut = 0  # open sections that are not content
        self.standing = OPEN

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((self.standing, text))

    def _push(self, tag: str, standing: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, standing))
        self.shut += tag == "section" and standing == OTHER
        self.standing = standing

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag, standing = self.stack.pop()
            self.places[tag].pop()
            self.shut -= tag == "section" and standing == OTHER
        self.standing = self.stack[-1][1] if self.stack else OPEN

    def _last(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCKS or tag in FURNITURE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        for names, scope in _IMPLIED.get(tag, ()):
            at = self._last(names)
            if at > self._last(scope):
                self._cut(at)
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden")}
        # inside an article inline elements are part of its text, whatever they are called
        speaks = self.standing != CONTENT or tag in BLOCKS or tag in FURNITURE
        named = speaks and (bool(NAMES.search(given.get("class", ""))) or tag not in _TEXTUAL and bool(NAMES.search(given.get("id", ""))))
        aside = tag in FURNITURE or speaks and given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or named and tag not in ("article", "main", "body", "html")
        inside = OTHER if aside else self.standing
        if tag in ("article", "main"):
            # an article opens after furniture that was never closed; one inside an article's comments does not
            inside = OTHER if named or self.shut else CONTENT
        self._push(tag, inside)

    def handle_endtag(self, tag) -> None:
        if tag in BLOCKS or tag in FURNITURE:
            self.flush()
        at = self._last((tag,))
        if at >= 0:
            self._cut(at)

    def handle_data(self, data) -> None:
        self.parts.append(data)


def page_blocks(html: str) -> list[tuple[int, str]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    # with an article on the page, what markup leaves open outside it is not main text
    if any(s == CONTENT for s, _ in parser.blocks):
        return [(s if s == CONTENT else OTHER, t) for s, t in parser.blocks]
    return parser.blocks


def stream_windows(texts: list[str], least: int) -> np.ndarray:
    """Hashes of the runs of ``least`` tokens of a page's blocks, joined to one stream."""
    return windows(word_hashes(" ".join(texts).encode()), least).view(np.int64)


def _stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(marked.view(np.uint8))


def own_text(blocks: list[dict], repeated: dict[int, int], least: int) -> str:
    """The open blocks without boilerplate; ``repeated`` maps runs of the page to SOME, MANY or NEARLY_ALL."""
    tokens = [b["text"].split(" ") for b in blocks]
    sizes = np.array([len(t) for t in tokens])
    is_open = np.repeat(np.array([b["standing"] == OPEN for b in blocks]), sizes)
    strength = np.array([repeated.get(h, 0) for h in stream_windows([b["text"] for b in blocks], least).tolist()], np.int64)

    def covered(weakest: int) -> np.ndarray:
        turns = np.zeros(len(is_open) + 1, np.int64)
        at = np.flatnonzero(strength >= weakest)
        np.add.at(turns, at, 1)
        np.add.at(turns, at + least, -1)
        return np.cumsum(turns[:-1]) > 0

    def at_edges(marked: np.ndarray) -> tuple[np.ndarray, bool]:
        """What of ``marked`` lies outside the page's own text, and whether it has any: stretches of ``least`` open tokens."""
        starts, ends = _stretches(is_open & ~marked)
        own = np.flatnonzero(ends - starts >= least)
        if not len(own):
            return marked, False
        outside = marked.copy()
        outside[starts[own[0]] : ends[own[-1]]] = False
        return outside, True

    some, has_own = at_edges(covered(SOME))
    gone = covered(NEARLY_ALL) | at_edges(covered(MANY))[0] | (some if has_own else False)
    kept, start = [], 0
    for block, words in zip(blocks, tokens, strict=True):
        if block["standing"] == OPEN:
            lost = gone[start : start + len(words)].copy()
            # a run that reaches into a block by a few tokens meets its own text by chance
            for a, b in zip(*_stretches(lost), strict=True):
                if b - a < least and b - a < len(words):
                    lost[a:b] = False
            kept.append(" ".join(w for w, g in zip(words, lost.tolist(), strict=True) if not g))
        start += len(words)
    return "\n".join(t for t in kept if t)


def run_tokens(stream: np.ndarray, repeated: set[int], least: int) -> int:
    """How many tokens of a stream lie in repeated runs."""
    at = np.flatnonzero([h in repeated for h in stream.tolist()])
    return int(np.minimum(np.diff(at), least).sum() + least) if len(at) else 0


def _parsed(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, content (what tells pages apart), text (of content blocks, null where others are open), open (texts and standing of blocks of such pages), tokens and runs (hashes) of the token stream outside content."""

    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.struct([("standing", pa.int32()), ("text", pa.string())])
        for batch in batches:
            contents, texts, opened, sizes, found = [], [], [], [], []
            for data in bytes_of(batch.column("html")):
                blocks = page_blocks(data.decode("utf-8", "replace"))
                settled = all(s != OPEN for s, _ in blocks)
                # copies may differ in markup and furniture; pages of nothing else are told apart by it
                told = "\n".join([t for s, t in blocks if s != OTHER] or [t for _, t in blocks])
                outside = [t for s, t in blocks if s != CONTENT]
                contents.append(xxhash.xxh3_64_intdigest(told.encode()) - (1 << 63))
                texts.append("\n".join(t for s, t in blocks if s == CONTENT) if settled else None)
                opened.append(None if settled else [{"standing": s, "text": t} for s, t in blocks])
                sizes.append(sum(t.count(" ") + 1 for t in outside))
                found.append(stream_windows(outside, least))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url")), pa.array(contents, pa.int64()), pa.array(texts, pa.string()),
                    pa.array(opened, pa.list_(kinds)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())),
                ],
                ["page_id", "url", "content", "text", "open", "tokens", "runs"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        parse, f"page_id {kind}, url string, content long, text string, open array<struct<standing:int,text:string>>, tokens long, runs array<long>"
    )


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def repeated_runs(parsed: DataFrame, share: float, nearly_all: float, many: int) -> DataFrame:
    """host (hashed), run, strength: runs that at least two and ``share`` of a host's different pages have."""
    rows = parsed.select(F.xxhash64(host_of(F.col("url"))).alias("host"), "content", "runs")
    sizes = rows.filter(F.size("runs") > 0).groupBy("host").agg(F.count_distinct("content").alias("of"))
    each = rows.select("host", "content", F.explode("runs").alias("run")).distinct()
    counted = each.groupBy("host", "run").agg(F.count("*").alias("pages")).filter(F.col("pages") >= 2)
    part = F.col("pages") / F.col("of")
    strength = F.when(F.col("pages") < many, SOME).when(part < nearly_all, MANY).otherwise(NEARLY_ALL)
    return counted.join(sizes, "host").filter(part >= share).select("host", "run", strength.alias("strength"))


def main_text(pages: DataFrame, *, least: int = 8, share: float = 0.5, nearly_all: float = 0.9, many: int = 5) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and of the tokens outside content n_run_tokens (in repeated runs) and n_markup_tokens (the others, where markup settles the page).

    Null html and pages without content have the empty text. Null urls share
    the host "". Equal rows get equal rows; a run counts once for pages of
    equal text. A host has at most ``1 / share`` times as many repeated runs as
    its mean page has runs, so they travel to its pages as one list.
    """
    limit_batches(pages.sparkSession)
    parsed = stored(_parsed(pages, least))
    # written first, so that the join knows their size and moves no page for short lists
    listed = stored(repeated_runs(parsed, share, nearly_all, many).groupBy("host").agg(F.collect_list(F.struct("run", "strength")).alias("repeated")))

    def prune(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, by_runs, by_markup = [], [], []
            kept = {}  # neighbouring pages often share their host's list
            for k in range(batch.num_rows):
                host = batch.column("host")[k].as_py()
                if host not in kept:
                    kept = {host: {r["run"]: r["strength"] for r in batch.column("repeated")[k].as_py() or ()}}
                repeated, text = kept[host], batch.column("text")[k].as_py()
                stream = batch.column("runs")[k].values.to_numpy(zero_copy_only=False)
                covered = run_tokens(stream, repeated, least)
                by_runs.append(covered)
                by_markup.append(batch.column("tokens")[k].as_py() - covered if text is not None else None)
                texts.append(own_text(batch.column("open")[k].as_py(), repeated, least) if text is None else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(by_runs, pa.int64()), pa.array(by_markup, pa.int64())],
                ["page_id", "url", "text", "n_run_tokens", "n_markup_tokens"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    placed = parsed.withColumn("host", F.xxhash64(host_of(F.col("url")))).join(listed, "host", "left")
    pruned = placed.select("page_id", "url", "host", "text", "open", "tokens", "runs", "repeated").mapInArrow(
        prune, f"page_id {kind}, url string, text string, n_run_tokens long, n_markup_tokens long"
    )
    return pruned.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_run_tokens", "n_markup_tokens")

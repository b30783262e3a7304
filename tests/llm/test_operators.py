"""Every operator against a plain version of itself, on small tables with nulls, ties, repeats and extremes."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import FOLDER, awkward, prose, shingle_set, words_of
from pyspark.sql import functions as F

from rankloom.llm import discriminant, jaccardjoin, licenses, linetemplates, mixing, pagetext, pieces, quality, sketches, tokenfiles
from rankloom.llm.common import read


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- 1: mixing -----------------------------------------------------------------
def shares(sizes, weights, most):
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 900, "c": 5, None: 85}, {"a": 100}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 50, "c": 2}])
def test_targets_are_shared_and_capped(spark, sizes):
    got = {r["source"]: r["target"] for r in rows(mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (1.0, 2.0, 3.0), 3.0))}
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    expected = shares(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}, 3.0)
    assert got == pytest.approx(expected)


def test_mix_meets_targets_and_repeats_itself(spark):
    docs = awkward(spark, [prose(k, 5 + k % 40) for k in range(600)])
    got = rows(mixing.pareto_mix(docs, importance=F.log(mixing.word_count(F.col("text")) + 2)))
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, rows(mixing.pareto_mix(docs, importance=F.log(mixing.word_count(F.col("text")) + 2)))))
    assert Counter(r["size"] for r in got) == Counter(len(words_of(r["text"])) for r in rows(docs))
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    assert mixing.pareto_mix(docs.limit(0)).count() == 0 and mixing.mixed_copies(docs.limit(0)).count() == 0


def test_inclusion_follows_importance(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), (F.when(F.col("id") % 2 == 0, "a").otherwise("b")).alias("source"))
    got = mixing.pareto_mix(docs, weights=(1.0, 3.0), importance=F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0)).filter("source = 'a'").groupBy((F.col("doc_id") % 4).alias("k")).agg(F.avg("copies").alias("c"))
    found = {r["k"]: r["c"] for r in rows(got)}
    assert found[0] == pytest.approx(0.75, abs=0.06) and found[2] == pytest.approx(0.25, abs=0.06)


# ---- 2: licenses ---------------------------------------------------------------
def test_license_phrases_and_gaps(spark):
    texts = [
        "All Rights Reserved. all rights reserved", "GNU General-Public/License, and CC BY", "rights reserved all", "Licensed under the (new) Apache License, Version 2.0.", "ccby cc by4", "İ CC BY cc by",
        "general public " * 3 + "license", "Licensed under CC BY-NC 4.0.",
    ]
    docs = awkward(spark, texts)
    lowered = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def plain(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lowered))
        hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))

    got = rows(licenses.scan_licenses(docs))
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r["doc_id"], *plain(r["text"])) for r in rows(docs))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[103] == "apache-2.0" and labels[107] == "cc-by,cc-by-nc-4.0" and labels[102] == ""
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


# ---- 3: quality rules -----------------------------------------------------------
def test_quality_base_statistics_and_verdict(spark):
    texts = [prose(k, 60) for k in range(40)] + [" ".join(w + "&&&" for w in prose(k, 60).split()) for k in range(15)] + ["a b c d e f " * 5, "line one\nline one\n\nline one"]
    docs = awkward(spark, texts)
    trusted = spark.createDataFrame([(100 + k,) for k in range(0, 40, 2)] + [(None,)], "doc_id long")

    def plain(text):
        w = words_of(text)
        found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + k for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)

    got = rows(quality.quality_rules(docs, trusted, bits=8))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *plain(r["text"])) for r in rows(docs))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[100 + k] for k in range(40)) and not any(kept[140 + k] for k in range(15))
    assert not any(r["kept"] for r in got if r["base_failed"])
    without = rows(quality.quality_rules(docs, trusted.limit(0)))
    assert all(r["llr"] == 0 and r["kept"] != r["base_failed"] for r in without)
    assert quality.quality_rules(docs.limit(0), trusted).count() == 0


# ---- 4: fingerprints --------------------------------------------------------------
def test_fingerprints_and_edits(spark):
    texts = [prose(k, 300, 100_000) for k in range(12)] + ["short", "tiny text", prose(3, 300, 100_000)]
    docs = awkward(spark, texts).filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in rows(sketches.fingerprint_edits(docs))}
    own = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    ids = sorted(own)
    for k, d in enumerate(ids):
        text, after = own[d], own[ids[(k + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert got[d]["n_chars"] == len(text) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingle_set(text), shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert got[d][name] == pytest.approx(true, abs=0.17)
    assert got[103]["fingerprint"] == got[114]["fingerprint"] != got[104]["fingerprint"]
    assert sketches.fingerprint_edits(docs.limit(0)).count() == 0 and sketches.fingerprint_edits(docs.limit(1)).count() == 1
    repeated = awkward(spark)
    assert sketches.fingerprint_edits(repeated).count() == repeated.count()


def test_sketches_merge(spark):
    halves = spark.createDataFrame([("d", prose(1, 900, 10**6)), ("d", prose(2, 900, 10**6)), ("e", prose(1, 900, 10**6))], "key string, text string")
    parts = sketches.with_sketch(halves, "text", "sketch")
    merged = {r["key"]: r for r in rows(sketches.merge_parts(parts, "key", "sketch").withColumn("n", sketches.distinct_count(F.col("sketch"))))}
    a, b, e = (r["sketch"] for r in rows(parts.orderBy("key", F.substring("text", 1, 20))))
    assert merged["d"]["sketch"] == sorted({*a, *b})[: sketches.K] and merged["e"]["sketch"] == e
    assert merged["d"]["n"] == pytest.approx(1792, rel=0.3)
    one = spark.createDataFrame([(a, merged["d"]["sketch"])], "a array<long>, b array<long>")
    assert one.select(sketches.containment(F.col("a"), F.col("b"))).first()[0] > 0.8


# ---- 5: token files -----------------------------------------------------------------
@pytest.mark.parametrize("percentile", [0.5, 0.9, 1.0])
def test_blocks_round_trip(percentile):
    draw = np.random.default_rng(3)
    for size in (1, 1023, 1024, 1025, 5000):
        ids = np.where(draw.random(size) < 0.05, draw.integers(0, 2**32, size), draw.integers(7, 900, size)).astype(np.uint32)
        file = tokenfiles.TokenFile(tokenfiles.file_image([None, 4], [1, size - 1], ids, percentile=percentile))
        assert (file.ids(0, size) == ids).all() and (file.ids(size // 3, size // 2) == ids[size // 3 : size // 2]).all()
        assert [d for d, _, _ in file.documents()] == [None, 4]


def test_word_encoder_merges_a_piece_once(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, draw = Tokenizer.from_file(path), random.Random(5)
    signs = [chr(c) for c in range(0x21, 0x250) if not chr(c).isspace()] + ["'s", "'LL", "e\u0301", "<|endoftext|>", "\u0130", "\u03a3"]
    texts = ["".join(draw.choices(signs, k=draw.randint(1, 9))) for _ in range(5000)]
    encode = tokenfiles.word_encoder(path)
    for text, ids in zip(texts, encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    # what a worker process has learned serves its next task, and only words that are not cut go to the tokenizer whole
    assert tokenfiles.word_encoder(path) is encode
    asked = []
    whole = Tokenizer.from_file(path)

    class Counted:
        model = property(lambda self: self)
        encode = lambda self, text, **options: asked.append(text) or whole.encode(text, **options)
        tokenize = lambda self, piece: asked.append(piece) or whole.model.tokenize(piece)
        __getattr__ = lambda self, name: getattr(whole, name)

    monkeypatch.setattr("tokenizers.Tokenizer.from_file", lambda _: Counted(), raising=False)
    again = tokenfiles.word_encoder.__wrapped__(path)
    again([b"Zorvik zorvik, ZORVIK. (zorvik) zorvik!", "zorvik\u2014".encode()])
    assert sum("orvik" in text for text in asked) == 2


def test_token_table(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = awkward(spark, [prose(k, 40) for k in range(30)] + ["<|endoftext|> it's 'S a<|endoftext|>b ÀÉ é\x1cq"])
    got = rows(tokenfiles.token_table(docs, path, ids_per_file=500))
    tokenizer = Tokenizer.from_file(path)
    start, expected = 0, []
    for r in sorted(rows(docs), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r.values()) for r in got if r["doc_id"]) == sorted(e for e in expected if e[0]) and len(got) == len(expected)
    assert tokenfiles.token_table(docs.limit(0), path).count() == 0


# ---- 6: discriminant ------------------------------------------------------------------
def test_discriminant_on_held_out_rows(spark):
    docs, labels = read(spark, FOLDER, "documents"), read(spark, FOLDER, "labels")
    got = rows(discriminant.classify(docs, labels).join(labels, "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in got if r["held_out"]]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_discriminant_edges(spark):
    docs = awkward(spark)
    one_class = spark.createDataFrame([(5, 1), (6, 1), (None, 0), (7, None)], "doc_id long, quality int")
    got = rows(discriminant.classify(docs, one_class))
    assert len(got) == docs.count() and {r["score"] for r in got} == {1.0}
    assert {r["score"] for r in rows(discriminant.classify(docs, one_class.limit(0)))} == {0.5}
    assert discriminant.classify(docs.limit(0), one_class).count() == 0


def test_log_odds_are_density_differences():
    draw = np.random.default_rng(1)
    size = len(discriminant.FEATURES)
    sets = {c: draw.normal(c, 1 + c, (400, size)) for c in (0, 1)}
    model = discriminant.Discriminant({c: (len(x), x.sum(0), x.T @ x) for c, x in sets.items()}, 0.2)
    x = draw.normal(0, 2, (50, size))

    def density(c):
        z = lambda v: (v - model.centre) / model.scale
        spread = np.cov(z(sets[c]).T, bias=True)
        spread = 0.8 * spread + 0.2 * np.trace(spread) / size * np.eye(size)
        apart = z(x) - z(sets[c]).mean(0)
        return -0.5 * (np.einsum("ij,jk,ik->i", apart, np.linalg.inv(spread), apart) + np.linalg.slogdet(spread)[1]) + np.log(0.5)

    assert np.allclose(model.log_odds(x), density(1) - density(0), atol=1e-6)


# ---- 7: pieces -----------------------------------------------------------------------
def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = awkward(spark, ["  lead and  trail ", "\n\nNew\n line\t", "ab" * 100 + " " + "日本" * 60, "The quick, brown fox's 1234567 €5.00"])
    got = rows(pieces.decode(pieces.encode(docs, path), path))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    assert len(got) == docs.count()
    for r in got:
        assert r["ids"] == library.encode(texts[r["doc_id"]])
        assert r["round_trip"] == (r["text"] == texts[r["doc_id"]]) == ("▁" not in texts[r["doc_id"]])
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_long_units_merge_like_short_ones():
    known, _, byte_ids, _ = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "☃☃x"):
        assert pieces.merge_unit("▁" + text, known, byte_ids) == library.encode(text)


# ---- 8: pages ------------------------------------------------------------------------
def test_repeated_runs_work_on_pages_that_markup_settles(spark):
    nav = " ".join(f"menu{k}" for k in range(10))
    page = lambda k: f"<nav>{nav} own{k}</nav><article><p>Text number {k} of its own.</p></article><footer>note {k}</footer>"
    pages = [(k, f"https://h.example/{k}", page(k)) for k in range(6)] + [(9, "https://other.example/", page(9))]
    got = {r.page_id: r for r in pagetext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(6):
        # the menu is a run of the host; what differs from page to page is left to markup
        assert (got[k].text, got[k].n_run_tokens, got[k].n_markup_tokens) == (f"Text number {k} of its own.", 10, 3)
    assert (got[9].text, got[9].n_run_tokens, got[9].n_markup_tokens) == ("Text number 9 of its own.", 0, 13)


def test_main_text(spark):
    banner = "<div>This very same banner stands on all pages of the host</div>"
    html = {
        1: "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><a>menu</a><div class=ad>buy</div><article><h1>Head &amp;amp; line</h1><p>one<br>two &lt;b&gt;<p>three\n  four"
        "<aside>no</aside><section class='comments'><article>comment</article></section></article><footer>no</footer>",
        2: f"<body>{banner}<p>only here we say this in a few words</p>", 3: f"<body>{banner}<p>another page with text of its own kind</p>", 4: "", 5: None, 6: "<body><form>x</form></body>",
    }
    pages = spark.createDataFrame([(k, None if k == 5 else f"http://h.example/{k}", h) for k, h in html.items()] + [(None, "http://h.example/1", html[1])] * 2, "page_id long, url string, html string")
    got = rows(pagetext.main_text(pages))
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts == {
        1: "Head &amp; line\none two <b>\nthree four", None: "Head &amp; line\none two <b>\nthree four", 2: "only here we say this in a few words", 3: "another page with text of its own kind", 4: "", 5: "", 6: "",
    }
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert pagetext.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html,text", [
    ("<article><p>one</p><![foo[x]]><p>two</p></article>", "one\ntwo"),
    ("<article>a<![if IE]>b<![endif]>c<![CDATA[x]]>d</article>", "abcd"),
    ("<article><p class=ad>buy<p>real text one</p><p>two</p></article>", "real text one\ntwo"),
    ("<article><ul><li class='share'>Share<li>real item<ul><li>inner</ul><li>last</ul></article>", "real item\ninner\nlast"),
    ("<article><label>x<p>b</article>", "b"),
    ("<article><dl><dt class=ad>t<dd>one<dt>two<dd>three</dl></article>", "one\ntwo\nthree"),
    ("<article><table><tr><td class=ad>a<td>b<tr><td>c</table></article>", "b\nc"),
    ("<article><h2 id='search'>How search works</h2><p id='header-1'>Text</p><div id='related'>no</div></article>", "How search works\nText"),
    ("<article><p>This <span class='search'>search</span> stays</p></article>", "This search stays"),
    ("<article><p>a</b></i> b<p>c</article></article>d", "a b\nc"),
    ("<article><section class=comments><article><p>no</article></section><p>yes</article>", "yes"),
])
def test_blocks_end_as_html_says(html, text):
    assert "\n".join(t for s, t in pagetext.page_blocks(html) if s == pagetext.CONTENT) == text


def test_long_pages_take_time_in_proportion():
    took = []
    for size in (20_000, 80_000):
        page = "<article>" + "<p>x y</b><i>z" * size + "</article>"
        started = time.perf_counter()
        assert len(pagetext.page_blocks(page)) == size
        took.append(time.perf_counter() - started)
    assert took[1] < 12 * took[0]


def main_texts(spark, pages):
    """Texts by page_id of (page_id, url, html)."""
    got = {}
    for r in rows(pagetext.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"))):
        assert got.setdefault(r["page_id"], r["text"]) == r["text"]
    return got


def test_copies_and_quotes_stay(spark):
    own = {k: prose(300 + k, 30) for k in range(12)}
    quote = "a saying of nine words that two pages quote"
    copies = [(1, "http://a.example/1", f"<p>{own[0]}</p>"), (2, "http://a.example/2", f"<div class='x'>{own[0]}</div>")]
    repeated = [(3, "http://b.example/3", f"<p>{own[1]}</p>")] * 2
    edited = [(4, "http://c.example/4", f"<p>{own[2]}</p>"), (5, "http://c.example/5", f"<p>{own[2]} edited</p>")]
    quoting = [(6, "http://d.example/6", f"<p>{own[3]} {quote} {own[4]}</p>"), (7, "http://d.example/7", f"<p>{own[5]} {quote} {own[6]}</p>")]
    banner = "This very same banner stands on all pages of the host"
    # a phrase at the head of two pages of a host with many
    crowd = [(10 + k, f"http://e.example/{k}", f"<div>{banner}</div><p>{quote if k < 2 else ''} {prose(400 + k, 20)}</p>") for k in range(10)]
    got = main_texts(spark, copies + repeated + edited + quoting + crowd)
    assert got[1] == got[2] == own[0] and got[3] == own[1]
    assert got[4] == own[2] and got[5] == f"{own[2]} edited"
    assert got[6] == f"{own[3]} {quote} {own[4]}" and got[7] == f"{own[5]} {quote} {own[6]}"
    assert got[10] == f"{quote} {prose(400, 20)}" and got[15] == prose(405, 20)


def test_furniture_of_short_blocks_goes(spark):
    menu = "<ul><li>Home<li>News and views<li>About us<li>Contact the shop</ul>"
    foot = "<div>All rights reserved</div><div>Made in our town</div><div>Since 1999</div>"
    own = {k: prose(500 + k, 20) for k in range(6)}
    pages = [(k, f"http://h.example/{k}", f"<title>t{k}</title>{menu}<h2>Today</h2><p>The {own[k]}</p>{foot}") for k in range(6)]
    assert main_texts(spark, pages) == {k: f"The {own[k]}" for k in range(6)}


# ---- 9: join -------------------------------------------------------------------------
def near_copies():
    base = prose(50, 200, 10**5).split()
    out = []
    for k in range(30):
        own = list(base)
        for j in range(k % 6):
            own[(37 * k + 31 * j) % 200] = f"edit{k}x{j}"
        out.append(" ".join(own))
    return out + [prose(60 + k, 80, 10**5) for k in range(10)] + [prose(60, 80, 10**5)] + ["four words only here", "four words only here"]


@pytest.mark.parametrize("small,block", [(32, 12 << 20), (2, 20_000)])
def test_join_equals_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccardjoin, "BLOCK_BYTES", block)
    docs = awkward(spark, near_copies())
    found = rows(docs.select("doc_id", "text"))
    sets = [shingle_set(r["text"]) for r in found]
    linked = [[j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    group = list(range(len(sets)))
    for _ in group:
        group = [min([group[i], *(group[j] for j in linked[i])]) for i in range(len(group))]
    low = lambda i: min((found[j]["doc_id"] for j in range(len(group)) if group[j] == group[i] and found[j]["doc_id"] is not None), default=None)
    expected = Counter((r["doc_id"], low(i), len(linked[i])) for i, r in enumerate(found))
    got = rows(jaccardjoin.jaccard_classes(docs, small=small))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == expected
    stay = rows(jaccardjoin.keep_one(docs, small=small))
    assert len(stay) == len({g for i, g in enumerate(group)}) and set(stay[0]) == set(docs.columns)


def test_join_of_empty_table(spark):
    assert jaccardjoin.jaccard_classes(awkward(spark).limit(0)).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert jaccardjoin.least_matches(48, 0.8, 1e-6) < 0.8 * 48 and jaccardjoin.least_matches(336, 0.8, 1e-6) > 0.6 * 336
    same = np.tile(np.arange(336, dtype=np.uint16), (3, 1))
    other = same.copy()
    other[1, ::2] = 9999
    other[2, ::8] = 9999
    assert jaccardjoin.surviving(same, other, 0.8, 1e-6).tolist() == [True, False, True]


# ---- 10: lines -----------------------------------------------------------------------
def test_recurring_lines_are_dropped_once(spark):
    long_line = prose(5, 60)
    texts = [f"{prose(k, 12)}\nPosted by user{k} on 2024-01-{k:02d} at noon\n\nPage number one of all\n{prose(900 + k, 9)}" for k in range(8)]
    texts += [f"{long_line}\nown {k} line of words" for k in range(2)] + ["twice in two\nfirst", "twice in two\nsecond"]
    docs = awkward(spark, texts)
    got = rows(linetemplates.drop_recurring_lines(docs))
    assert len(got) == docs.count() and set(got[0]) == {*docs.columns, "n_lines", "n_dropped"}
    own = {r["doc_id"]: r for r in got}
    assert own[100]["text"] == texts[0] and own[100]["n_dropped"] == 0
    assert own[103]["text"] == f"{prose(3, 12)}\n\n{prose(903, 9)}" and (own[103]["n_lines"], own[103]["n_dropped"]) == (4, 2)
    assert own[108]["text"] == texts[8] and own[109]["text"] == "own 1 line of words"
    assert own[110]["text"] == texts[10] and own[111]["text"] == texts[11]
    assert own[1]["text"] is None and own[2]["text"] == "" and own[5]["n_dropped"] == 0
    assert linetemplates.drop_recurring_lines(docs.limit(0)).count() == 0


def test_word_fields_with_recurring_values(spark):
    names, cities, days = [f"name{c}" for c in "abcdefghij"], [f"city{c}" for c in "abcdefghij"], "Monday Tuesday Wednesday Thursday Friday".split()
    lines = [f"Written for our blog by {a} in {b}" for a in names for b in cities]
    # a rarer template in the same leaf, its values recurring too
    rare = [f"Written for our readers on {days[k % 5]} at {cities[k // 5]}" for k in range(20)]
    texts = [f"{prose(2000 + k, 12)}\n{line}" for k, line in enumerate(lines + rare)]
    got = {r["doc_id"]: r for r in rows(linetemplates.drop_recurring_lines(awkward(spark, texts)))}
    left = [k for k in range(len(texts)) if got[100 + k]["n_dropped"] == 0]
    assert left == [0, len(lines)]
    assert all(got[100 + k]["text"] == prose(2000 + k, 12) for k in range(len(texts)) if k not in left)


def test_no_piece_crosses_units():
    """Plain rule: a place between two characters is cut only if no piece lies over it."""
    known = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))[0]
    cut = pieces.cutter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("Die Straße, ñandú  x\n\nein éècnu 12.5€ über", "aaaa bb ccc", "日本語 ☃☃", "z", prose(3, 60)):
        whole = pieces.prepared(text)
        found, starts, sizes = cut.units(whole)
        assert "".join(found.to_pylist()) == whole and [len(u) for u in found.to_pylist()] == sizes.tolist() and all(sizes)
        covered = {k for i in range(len(whole)) for n in range(2, 17) if whole[i : i + n] in known and i + n <= len(whole) for k in range(i + 1, i + n)}
        assert not covered & set(starts.tolist())
    assert len(cut.units("")[0]) == 0

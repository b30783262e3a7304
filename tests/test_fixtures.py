"""Small frames with hand-computed results."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions import urls
from rankloom.functions.lexicons import DEFAULT_LEXICON, light_stem
from rankloom.operators import datasets, evaluation, extraction, history, peers, preferences
from rankloom.operators import page_features as pf

RICH = """<html lang="ru"><head><title>Окна &amp;amp; двери</title><meta name="Description" content=" a  b ">
<meta name="robots" content="noindex"><link rel="canonical" href="/x?b=2&amp;a=1"><link rel="alternate" hreflang="de" href="/de">
<script type="application/ld+json">{"@graph":[{"@type":"Organization","address":{"telephone":"1"}}]}</script>
<script type="application/ld+json">{bad</script><style>p{}</style></head>
<body><h1>One <a href="/in">link</a></h1><h2>Two</h2><h2> </h2><h3>Three</h3><p>text</p><p>more</p>
<ul><li>a</li></ul><b>x</b><strong>y</strong><img src="i"><form><input><button>Купить</button></form>
<script>var t = "</p>";</script><a href="tel:+7"></a></body></html>"""


def test_document_of_a_rich_page():
    doc = extraction.read_document(RICH)
    assert doc["title"] == "Окна & двери" and doc["lang"] == "ru" and doc["meta_description"] == "a b"
    assert doc["canonical"] == "/x?b=2&a=1" and doc["meta_robots"] == "noindex"
    assert doc["h1_texts"] == ["One link"] and doc["h2_texts"] == ["Two"] and doc["h3_texts"] == ["Three"]
    assert [l["href"] for l in doc["links"]] == ["/in", "tel:+7"] and doc["button_texts"] == ["Купить"]
    assert doc["counts"] == {"paragraph": 2, "h1": 1, "h2": 2, "h3": 1, "link": 2, "image": 1, "list_item": 1, "strong": 2, "form": 1, "input": 1}
    assert len(doc["json_ld"]) == 2 and len(doc["json_ld_objects"]) == 2 and doc["json_ld_malformed"] == 1
    assert "var t" not in doc["text"] and doc["text"].startswith("Окна & двери")


def test_unclosed_capture_blocks_later_ones():
    doc = extraction.read_document("<h1>A <a href='/x'>B</h1><h1>C</h1>")
    assert doc["h1_texts"] == ["C"] and doc["links"] == []
    assert extraction.read_document(None)["text"] == ""


def test_key_and_type_presence(spark):
    page = extraction.extract_documents(spark.createDataFrame([(RICH,)], "html string"))
    row = page.select(
        extraction.key_present("telephone").alias("phone"), extraction.key_present("price").alias("price"),
        F.concat_ws(",", extraction.schema_types()).alias("types"),
    ).first()
    assert row.phone and not row.price and row.types == "organization"


@pytest.mark.parametrize("word", ["окнами", "москва", "дома", "ёлками", "красивого", "windows", "купить", "имя", "книгами"])
def test_stem_regex_equals_word_by_word(spark, word):
    got = spark.range(1).select(tx.stemmed_tokens(F.lit(f"x {word}, y")).alias("t")).first().t
    assert got == ["x", light_stem(word), "y"]


def test_city_terms_and_intent(spark):
    assert {"москва", "москв", "мск", "moscow"} <= set(DEFAULT_LEXICON.geo_aliases["moscow"])
    rows = spark.createDataFrame([("пластиковые окна цена москва",), ("как выбрать окна",), ("",), ("xyz",)], "query string")
    labels = {r.query: r.intent_label for r in pf.query_intent(rows).collect()}
    assert labels == {"пластиковые окна цена москва": "local_commercial", "как выбрать окна": "informational", "": "other", "xyz": "other"}


@pytest.mark.parametrize(
    "canonical,final,expected",
    [
        ("https://a.com/x/", "https://www.a.com/x", True), ("/x", "https://a.com/x?p=1", True), ("?p=1&q=2", "https://a.com/x?q=2&p=1", True),
        ("https://a.com/x?p=2", "https://a.com/x?p=1", False), ("http://a.com/x", "https://a.com/x", False), ("../c", "https://a.com/b/c", False),
        ("y", "https://a.com/b/y", True), ("//a.com/", "https://a.com", True),
    ],
)
def test_canonical(spark, canonical, final, expected):
    assert spark.range(1).select(pf.canonical_matches(F.lit(canonical), F.lit(final)).alias("m")).first().m is expected


def test_robots_and_urls(spark):
    row = spark.range(1).select(
        pf.robots_directives(F.lit("googlebot: none"), F.lit("Follow; max-snippet:5")).alias("d"), urls.domain(F.lit("HTTPS://WWW.Example.com:80/a")).alias("h"),
        urls.is_excluded(F.lit("https://a.com/files/x.PDF")).alias("x"), urls.depth(F.lit("https://a.com//b/c/")).alias("n"),
    ).first()
    assert row.d == ["5", "follow", "nofollow", "noindex", "none"] and row.h == "example.com:80" and row.x and row.n == 2


def _peers(spark, rows):
    schema = "audit_id string, candidate_index int, requested_top_n int, score double, fetch_status string, fetch_error_code string, features_present int, word_count double, text_length_chars double"
    full = [("a", i + 1, 3, s, "success" if s is not None else "failed", code, int(s is not None), 500.0, 5000.0) for i, (s, code) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


@pytest.mark.parametrize(
    "rows,status",
    [
        ([(82.0, None), (87.0, None), (79.0, None)], "ready"), ([(82.0, None), (87.0, None), (None, "http_403")], "partial_but_usable"),
        ([(82.0, None), (None, "http_403"), (None, "browser_timeout")], "insufficient_processed_competitors"),
        ([(None, "http_403"), (None, "captcha_detected")], "insufficient_processed_competitors"), ([], "no_serp_results"),
    ],
)
def test_context_quality_ladder(spark, rows, status):
    audits = spark.createDataFrame([("a", 3)], "audit_id string, requested_top_n int")
    assert peers.context_quality(audits, peers.competitor_selection(_peers(spark, rows))).first().status == status


def test_one_peer_has_zero_z_score(spark):
    features = [c for cols in peers.SERP_RELATIVE_GROUPS.values() for c in cols]
    own = spark.createDataFrame([("a", *[0.6] * len(features))], ["audit_id", *features])
    other = spark.createDataFrame([("a", *[0.4] * len(features))], ["audit_id", *features])
    row = peers.serp_relative_target(own, other).first()
    assert row.relative_z_score_query_match == 0.0 and row.relative_percentile_query_match == 1.0 and row.serp_relative_gap_score == 1.0


def test_leave_one_out_equals_brute_force(spark):
    import random
    import statistics

    rng = random.Random(3)
    values = {g: [round(rng.choice([0.1, 0.25, 0.5, rng.random()]), 6) for _ in range(n)] for g, n in (("a", 2), ("b", 5), ("c", 9), ("d", 40))}
    long = spark.createDataFrame([(g, "x", v) for g, vs in values.items() for v in vs], "query string, grp string, value double")
    got = {(r.query, r.value): r for r in peers.leave_one_out(long).collect()}
    for group, items in values.items():
        for i, own in enumerate(items):
            rest = items[:i] + items[i + 1:]
            row = got[group, own]
            assert row.peers == len(rest)
            assert row.gap_to_top == pytest.approx(own - max(rest), abs=1e-6)
            assert row.gap_to_median == pytest.approx(own - statistics.median(rest), abs=2e-6)
            spread = statistics.pstdev(rest)
            assert row.z_score == pytest.approx(0.0 if spread < 1e-6 else (own - statistics.fmean(rest)) / spread, abs=1e-4)


def _labels(spark, scores):
    schema = "query string, url string, rank int, page_target_score double, ranking_target_score double, critical_search_score double"
    return spark.createDataFrame([("q", f"u{i:03d}", i + 1, s, s, 50.0) for i, s in enumerate(scores)], schema)


def test_preference_strengths(spark):
    pairs = preferences.preference_pairs(_labels(spark, [50.0, 41.0]))
    assert pairs.first().preference_strength == "strong"
    found = {m: preferences.preference_pairs(_labels(spark, [50.0, 50.0 + m])).collect() for m in (5.0, 3.0, 1.0)}
    assert [r[0].preference_strength if r else None for r in found.values()] == ["weak", "uncertain", None]
    assert found[5.0][0].winner_url == "u001"


def test_blocked_pairs_equal_unblocked_and_summary(spark):
    labels = _labels(spark, [(i * 37 % 101) * 0.9 for i in range(60)])
    key = lambda df: sorted((r.winner_url, r.loser_url, r.preference_strength) for r in df.collect())
    whole = key(preferences.preference_pairs(labels))
    assert key(preferences.preference_pairs(labels, block_rows=7)) == whole and len(whole) == len(set(whole))
    row = preferences.preference_summary(labels).first()
    assert [row.strong_pairs, row.weak_pairs, row.uncertain_pairs] == [sum(p[2] == s for p in whole) for s in ("strong", "weak", "uncertain")]


def test_splits_keep_queries_together(spark):
    rows = spark.createDataFrame([(f"q{i % 53}", f"c{i % 53 % 4}") for i in range(500)], "query string, category string")
    split = datasets.group_split(rows, 0.2).collect()
    assert len(split) == 53 and sum(r.partition == "validation" for r in split) == 11
    per = datasets.stratified_split(rows).groupBy("category").pivot("partition", ["train", "validation"]).count().collect()
    assert len(per) == 4 and all(r.train and r.validation for r in per)


def test_domain_cap_counts_stored_rows(spark):
    fresh = spark.createDataFrame([("s", 0, i, f"u{i}", "hot") for i in range(50)], "seed_no string, serp_page int, rank int, url string, domain string")
    stored = spark.createDataFrame([("hot",)] * 5, "domain string")
    assert sorted(r["rank"] for r in datasets.domain_cap(fresh, stored, cap=12).collect()) == list(range(7))


def plain_draws(rows, seeds, k):
    """Seed by seed, category by category, row by row."""
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    by_category = {}
    for row in sorted(rows, key=lambda r: digest(f"{r[0]}|{r[1]}")):
        by_category.setdefault(row[2], []).append(row)
    out = set()
    for i, (query, own) in enumerate(sorted(seeds, key=lambda s: digest(s[0]))):
        ring = [c for c in sorted(by_category) if c != own]
        taken = 0
        for step in range(len(ring)):
            pool = by_category[ring[(i * k + step) % len(ring)]]
            found = next((r for r in (pool[(i + taken + j) % len(pool)] for j in range(len(pool))) if r[3]), None)
            if found and taken < k:
                out.add((query, taken, found[0], found[1]))
                taken += 1
    return out


@pytest.mark.parametrize("k", [1, 2, 4])
def test_hard_negatives_equal_plain_walk(spark, k):
    from rankloom.operators import hard_negatives as hn

    draw = random.Random(k)
    rows = [(f"q{i % 9}", f"u{i}", f"c{draw.randrange(6)}", draw.random() < 0.4 and i % 6 != 3) for i in range(90)] + [(f"z{i}", f"w{i}", "none", False) for i in range(4)]
    seeds = [(f"s{i}", draw.choice(["c0", "c1", "c5", "elsewhere", "none"])) for i in range(30)]
    table = spark.createDataFrame(rows, "query string, url string, category string, ok boolean")
    asked = spark.createDataFrame([(*s, "x", "y") for s in seeds] + [(" ", "c1", "", "")], "query string, category string, intent string, city string")
    got = hn.drawn_rows(table, asked, F.col("ok"), k).select("seed_query", "draw", "query", "url").collect()
    assert {tuple(r) for r in got} == plain_draws(rows, seeds, k) and len(got) == len(set(got))


def test_next_marked_goes_round_in_blocks(spark):
    from rankloom.functions.order import next_marked

    draw = random.Random(5)
    marks = {g: [draw.random() < 0.1 for _ in range(n)] for g, n in (("a", 200), ("b", 7), ("c", 1))} | {"d": [False] * 9}
    table = spark.createDataFrame([(g, i, m) for g, flags in marks.items() for i, m in enumerate(flags)], "g string, at long, mark boolean")
    for r in next_marked(table, ["g"], "at", "mark", "found", block=8).collect():
        flags = marks[r.g]
        assert r.found == next((p % len(flags) for p in range(r["at"], r["at"] + len(flags)) if flags[p % len(flags)]), None)


def test_transitions_across_buckets(spark):
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate(["queued", "processing", "completed", "queued", "failed", "processing"])], "audit_id int, id int, status string")
    for size in (1, 2, 100):
        assert [(r.from_status, r.to_status) for r in history.transition_violations(log, size).collect()] == [("completed", "queued")]


def test_strict_labels_fail_on_a_bad_row(spark):
    from rankloom.sources.scans import typed_labels

    raw = spark.createDataFrame([("q", "u", "120", 1), ("q", "", "5", 2)], "query string, url string, expert_target_score string, line_no int")
    assert typed_labels(raw, "line_no").first().expert_target_score == 120.0
    with pytest.raises(Exception, match="invalid label"):
        typed_labels(raw, "line_no", strict=True).collect()


def test_append_is_idempotent_and_broken_snapshots_are_null(spark, tmp_path):
    from pyspark.sql import types as T

    from rankloom.sources.scans import append_new_rows, scan_snapshots

    rows = spark.createDataFrame([("q", "u1"), ("q", "u2"), ("q", "u1")], "query string, url string")
    target = str(tmp_path / "rows")
    assert append_new_rows(rows, spark, target, "a") == 2 and append_new_rows(rows, spark, target, "a") == 2
    assert append_new_rows(rows, spark, target, "b") == 0 and spark.read.parquet(target).count() == 2
    folder = tmp_path / "snaps"
    folder.mkdir()
    (folder / "a.json").write_text('{"requested_url": "x"}')
    (folder / "b.json").write_text("{broken")
    found = scan_snapshots(spark, str(folder), T.StructType([T.StructField("requested_url", T.StringType())])).collect()
    assert {r.artifact_name: r.snapshot and r.snapshot.requested_url for r in found} == {"a.json": "x", "b.json": None}


def test_packed_snapshots_read_as_loose_files_do(spark, tmp_path):
    from pyspark.sql import types as T

    from rankloom.sources.scans import pack_snapshots, scan_snapshots

    bodies = {"a.json": '{\n  "requested_url" : "x \\"y\\"",\n  "more" : [1]\n}', "b.json": '{\n  "requested_url" : "cut o', "c.json": "{}", "d.json": "no json"}
    schema, loose, packed = T.StructType([T.StructField("requested_url", T.StringType())]), tmp_path / "loose", str(tmp_path / "packed")
    loose.mkdir()
    for name, body in bodies.items():
        (loose / name).write_text(body)
    pack_snapshots(spark.createDataFrame([*bodies.items(), ("empty.json", "")], "artifact_name string, body string").coalesce(1), packed)
    read = lambda found: {r.artifact_name: r.snapshot and tuple(r.snapshot) for r in found.collect()}
    assert read(scan_snapshots(spark, packed, schema, packed=True)) == {**read(scan_snapshots(spark, str(loose), schema)), "empty.json": None}
    assert read(scan_snapshots(spark, packed, schema, packed=True)) == {"a.json": ('x "y"',), "b.json": None, "c.json": (None,), "d.json": None, "empty.json": None}


def test_snapshot_files_do_not_grow_with_the_pages(spark, monkeypatch, tmp_path):
    from rankloom.plans import source_queries

    monkeypatch.setattr(source_queries, "_scratch", lambda spark, name: str(tmp_path / name))
    rows = source_queries.scan_snapshots(spark, "/root/testdata/sf0.01").count()
    assert rows > 100 and sum(p.is_file() and not p.name.startswith(".") for p in tmp_path.rglob("*")) < rows / 2


def test_ndcg_of_a_perfect_order_is_one(spark):
    rows = spark.createDataFrame([("m", "q", f"u{i}", i + 1, 90.0 - i, 50.0 - i) for i in range(12)], "model string, query string, url string, rank int, target_score double, prediction double")
    assert evaluation.ndcg(rows).first().ndcg == pytest.approx(1.0)
    assert evaluation.spearman(rows).first().spearman == pytest.approx(1.0)


def test_dataset_csv_keeps_quoted_line_breaks(spark, tmp_path):
    from rankloom.sources import scans

    (tmp_path / "rows.csv").write_text('query,title,word_count\nq1,"first line\nsecond ""line""",12\nq2,plain,x\n')
    got = scans.scan_dataset(spark, str(tmp_path / "rows.csv"), "query string, title string, word_count string", ["word_count"])
    assert sorted(map(tuple, got.collect())) == [("q1", 'first line\nsecond "line"', 12.0), ("q2", "plain", 0.0)]


@pytest.mark.parametrize("name", ["train_pointwise", "train_pairwise", "feature_importance", "score_response"])
def test_model_queries_fit_all_features_with_defaults(spark, monkeypatch, name):
    from rankloom.operators import models
    from rankloom.plans import source_queries
    from rankloom.sources.views import FEATURES

    class Fitted(Exception):
        pass

    def fit(*args, **options):
        assert tuple(args[-1]) == FEATURES and set(options) <= {"keep"} and set(FEATURES) <= set(args[-2].columns)
        raise Fitted

    monkeypatch.setattr(models, "train_pairwise" if name == "train_pairwise" else "train_pointwise", fit)
    with pytest.raises(Fitted):
        source_queries.CATALOG.queries[name](spark, "/root/testdata/sf0.001")

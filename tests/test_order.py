"""Ordered counts, quantiles, ranks and dominance counts against plain versions, with groups cut into ranges."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rankloom.functions import order
from rankloom.operators import evaluation, preferences


def values(seed=1):
    draw = random.Random(seed)
    rows = [("big", draw.gauss(0, 1)) for _ in range(900)] + [("big", 0.25)] * 300 + [("small", draw.random()) for _ in range(5)] + [("one", 7.0)]
    rows += [("tied", 1.0)] * 50 + [("narrow", 50 + draw.random() * 1e-9) for _ in range(400)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("own", [1, 40, order.OWN])
def test_ordered_counts(spark, own):
    rows = values()
    table = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {(r.g, r.v): (r.n_equal, r.n_below, r.n_total) for r in order.ordered_counts(table, ["g"], "v", own).collect()}
    expected = {}
    for g in {g for g, _ in rows}:
        own_values = sorted(v for h, v in rows if h == g)
        for v in set(own_values):
            expected[(g, v)] = (own_values.count(v), sum(x < v for x in own_values), len(own_values))
    assert got == expected


@pytest.mark.parametrize("own", [1, order.OWN])
def test_quantiles_of_groups_and_of_everything(spark, own):
    rows = [*values(), ("empty", None), ("small", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in order.quantiles(table, ["g"], "v", {"low": 0.25, "mid": 0.5, "top": 0.95}, own).collect()}
    for g, r in got.items():
        own_values = [v for h, v in rows if h == g and v is not None]
        assert r.n == len(own_values) and [r.low, r.mid, r.top] == pytest.approx(list(np.quantile(own_values, [0.25, 0.5, 0.95])), rel=1e-12)
    assert set(got) == {"big", "small", "one", "tied", "narrow"}
    whole = order.quantiles(table, [], "v", {"p": 0.95}, own).first()
    assert whole.p == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.95), rel=1e-12)
    assert order.quantiles(table.limit(0), [], "v", {"p": 0.5}, own).first().p is None


@pytest.mark.parametrize("own", [1, 60, order.OWN])
def test_dominance_equals_pairs(spark, own):
    draw = random.Random(9)
    points = [(1, "a", draw.randrange(90), draw.randrange(60)) for _ in range(400)] + [(1, "b", draw.randrange(9), draw.randrange(9)) for _ in range(30)]
    points += [(2, "a", 5, draw.randrange(50)) for _ in range(120)] + [(2, "c", 0, 0), (3, None, 1, 1)]
    table = spark.createDataFrame(points, "m long, g string, x long, y long").repartition(3)
    margins = {"near": 1, "far": 20}
    got = {(r.m, r.g, r.margin): r.hits for r in order.dominated(table, ["m", "g"], "x", "y", margins, own).collect()}
    for m, g in {(m, g) for m, g, *_ in points}:
        mine = [(x, y) for a, b, x, y in points if (a, b) == (m, g)]
        for name, margin in margins.items():
            hits = sum(xi - xj >= margin and yi > yj for xi, yi in mine for xj, yj in mine)
            assert got.get((m, g, name), 0) == hits, (m, g, name)


def test_accuracy_without_pairs_equals_accuracy_of_pairs(spark):
    draw = random.Random(4)
    pages = [(f"q{q}", f"u{q}-{i}", i, round(draw.uniform(0, 30), 4)) for q in range(5) for i in range(3 + 9 * q)]
    labels = spark.createDataFrame([(q, u, r, t, t, t) for q, u, r, t in pages], "query string, url string, rank int, page_target_score double, ranking_target_score double, critical_search_score double")
    scores = spark.createDataFrame([(m, q, u, draw.choice([t, 30 - t, 5.0, draw.random() * 30])) for m in ("x", "y") for q, u, _, t in pages if draw.random() < 0.9], "model string, query string, url string, prediction double")
    pairs = preferences.preference_pairs(labels)
    expected = sorted(map(tuple, evaluation.preference_accuracy(pairs, scores).collect()))
    assert sorted(map(tuple, evaluation.label_preference_accuracy(labels, scores).collect())) == expected
    counts = lambda df: sorted(map(tuple, df.select("query", "n", "usable", "uncertain").collect()))
    assert counts(preferences.label_pair_counts(labels)) == counts(preferences.pair_counts(pairs))


def test_points_of_small_groups_are_shuffled_once(spark):
    draw = random.Random(5)
    points = [(f"g{i % 7}", draw.randrange(40), draw.randrange(30) / 7) for i in range(600)]
    table = spark.createDataFrame(points, "g string, x long, y double").repartition(3)
    margins = {"near": 1, "far": 20, "wide": 30}
    found = order.dominated(table, ["g"], "x", "y", margins)
    got = {(r.g, r.margin): r.hits for r in found.collect()}
    for g in {g for g, *_ in points}:
        mine = [(x, y) for a, x, y in points if a == g]
        for name, margin in margins.items():
            assert got.get((g, name), 0) == sum(xi - xj >= margin and yi > yj for xi, yi in mine for xj, yj in mine)
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()  # a point does not travel once for each margin


def test_accuracy_of_rows_that_carry_their_label(spark):
    draw = random.Random(6)
    pages = [(f"q{q}", f"u{q}-{i}", i, round(draw.uniform(0, 30), 4)) for q in range(4) for i in range(4 + 9 * q)]
    labels = spark.createDataFrame([(q, u, r, t, t, t) for q, u, r, t in pages], "query string, url string, rank int, page_target_score double, ranking_target_score double, critical_search_score double")
    scores = spark.createDataFrame([(m, q, u, draw.choice([t, 30 - t, 5.0, draw.random() * 30])) for m in ("x", "y") for q, u, _, t in pages], "model string, query string, url string, prediction double")
    expected = sorted(map(tuple, evaluation.preference_accuracy(preferences.preference_pairs(labels), scores).collect()))
    carried = scores.join(labels, ["query", "url"]).select("model", "query", "ranking_target_score", "prediction")
    assert sorted(map(tuple, evaluation.implied_preference_accuracy(carried).collect())) == expected


def test_spearman_ranks_stored_values(spark):
    rows = [("m", "q", 1.00001, 3.0), ("m", "q", 1.00002, 1.0), ("m", "q", 1.00003, 2.0), ("m", "r", 1.0, 1.0), ("m", "s", 2.0, 1.0), ("m", "s", 2.0, 4.0)]
    got = {r.query: r.spearman for r in evaluation.spearman(spark.createDataFrame(rows, "model string, query string, target_score double, prediction double")).collect()}
    assert got["q"] == pytest.approx(-0.5) and got["r"] is None and got["s"] is None


def test_benchmarks_of_large_and_small_keys_agree(spark, monkeypatch):
    from rankloom.operators import recommend

    draw = random.Random(2)
    names = [m for m, spec in recommend.METRICS.items() if spec[3] is None][:4]
    rows = [(f"k{k}", draw.random(), *[None if draw.random() < 0.1 else draw.random() for _ in names]) for k in range(4) for _ in range(1 + 40 * k)]
    table = spark.createDataFrame(rows, "key string, score double, " + ", ".join(f"{n} double" for n in names))
    found = lambda: {r.key: r for r in recommend.benchmark_columns(table, "key", "score").collect()}
    small = found()
    monkeypatch.setattr(order.large_keys, "__defaults__", (1,))
    monkeypatch.setattr(order.quantiles, "__defaults__", (1,))
    large = found()
    assert set(small) == set(large) == {"k0", "k1", "k2", "k3"}
    for key, row in small.items():
        assert row.peer_count == large[key].peer_count and (row.competitors_average_score is None) == (key == "k0")
        for name in names:
            own = [r[2 + names.index(name)] for r in rows if r[0] == key and r[2 + names.index(name)] is not None]
            expected = None if key == "k0" else pytest.approx(np.quantile(own, 0.75 if recommend.METRICS[name][0] == "up" else 0.25), rel=1e-9)
            assert row[f"b_{name}"] == expected and large[key][f"b_{name}"] == expected


def test_relative_rows_by_window_and_by_value_agree(spark):
    from rankloom.operators import peers

    draw = random.Random(6)
    features = sorted({c for cols in peers.SERP_RELATIVE_GROUPS.values() for c in cols})
    value = lambda: draw.choice([None, 0.1, 0.5, 0.5, draw.random()])
    # groups without a value, a group of one, ties at the top, the same page twice
    rows = [(f"q{q}", f"u{i}", *[value() for _ in features]) for q in range(6) for i in range(1 + q * q)] + [("none", "u", *[None] * len(features)), ("same", "u", *[0.3] * len(features)), ("same", "u", *[0.6] * len(features))]
    table = spark.createDataFrame(rows, "query string, url string, " + ", ".join(f"{f} double" for f in features)).repartition(3)
    found = lambda df: sorted(map(tuple, df.collect()), key=repr)
    by_value = found(peers._relative_long(table, ("query", "url")))
    assert len(by_value) > 50 and found(peers.serp_relative_all(table)) == by_value
    assert found(peers.serp_relative_all(table, own=4)) == by_value
    everyone = found(peers._relative_long(table, ("query", "url"), every=True))
    assert len(everyone) > len(by_value) and found(peers.serp_relative_all(table, own=4, every=True)) == everyone
    plan = peers.serp_relative_all(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Generate" not in plan


def test_metrics_by_window_and_apart_agree(spark):
    from pyspark.sql import functions as F

    draw = random.Random(8)
    rows = [(m, f"q{q}", f"u{i}", draw.randrange(1, 9), draw.choice(["x", "y", None]), draw.choice([10.0, 55.5, draw.uniform(0, 100)]), draw.choice([1.0, 2.0, draw.random()])) for m in ("a", "b") for q in range(7) for i in range(1 + q * q)]
    rows += [("a", "flat", f"u{i}", i, "x", 0.0, 1.0) for i in range(4)]
    table = spark.createDataFrame(rows, "model string, query string, url string, rank int, intent string, target_score double, prediction double").repartition(3)
    extra = {"extra": [F.max("intent").alias("hi")], "carried": ["intent"]}
    found = lambda df: {(r.model, r.query): (r.rows, r.hi, round(r.ndcg, 10), None if r.spearman is None else round(r.spearman, 10), r.top3_hit) for r in df.collect()}
    apart = found(evaluation._metrics_apart(table.select("model", "query", "intent", "url", "rank", "target_score", "prediction"), ("model", "query"), extra["extra"]))
    whole = evaluation.query_metrics(table, **extra)
    assert len(apart) == 15 and found(whole) == apart
    assert found(evaluation.query_metrics(table, own=5, **extra)) == apart
    assert evaluation.query_metrics(table, **extra)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1


@pytest.mark.parametrize("block_rows", [4, 100])
def test_recovered_pairs_replace_margin_pairs_without_a_shuffle_of_these(spark, block_rows):
    pages = [("q", f"u{i}", i + 1, 90.0 - 9 * i) for i in range(9)] + [("r", f"v{i}", i + 1, 50.0 + 5 * i) for i in range(4)]
    labels = spark.createDataFrame([(q, u, r, t, t, t) for q, u, r, t in pages], "query string, url string, rank int, page_target_score double, ranking_target_score double, critical_search_score double")
    regressions = spark.createDataFrame([("q", "regressed", ["u0", "u1"], ["u5"]), ("r", "same", ["v0"], ["v3"])], "query string, outcome string, lost_urls array<string>, promoted_urls array<string>")
    key = lambda r: (r.query, r.winner_url, r.loser_url)
    margin = {key(r): r.reason for r in preferences.preference_pairs(labels, block_rows).collect()}
    found = preferences.preference_recovery(regressions, labels, block_rows)
    got = {key(r): r.reason for r in found.collect()}
    assert len(margin) == 36 + 6 and found.count() == len(got)
    assert got == {**margin, ("q", "u0", "u5"): "d50_top3_recovery", ("q", "u1", "u5"): "d50_top3_recovery"}
    assert "hashpartitioning(query#" in (plan := preferences.preference_recovery(regressions, labels, block_rows)._jdf.queryExecution().executedPlan().toString()) and "winner_url" not in "".join(l for l in plan.splitlines() if "Exchange" in l)


def test_forest_queries_fit_no_other_model(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from rankloom.plans import source_queries as sq

    class Forest:
        featureImportances = Vectors.dense([1.0] + [0.0] * (len(sq.FEATURES) - 1))
        stages = property(lambda self: [self])

    def refused(*_, **__):
        raise AssertionError("the boosted forest is not asked for")

    asked = []
    monkeypatch.setattr(sq.models, "train_pointwise", refused)
    monkeypatch.setattr(sq.models, "train_forest", lambda train, features: asked.append(features) or Forest())
    monkeypatch.setattr(sq.models, "score_response", lambda model, rows, features: model)
    found = sq.feature_importance(spark, "/root/testdata/sf0.001").collect()
    assert [(r.feature, r.importance) for r in found] == [(sq.FEATURES[0], 1.0)]
    assert isinstance(sq.score_response(spark, "/root/testdata/sf0.001"), Forest) and len(asked) == 2


def test_relative_target_moves_means_and_not_features(spark):
    from rankloom.operators import peers
    from rankloom.plans import peer_queries

    own, others = peer_queries._target_and_peers(spark, "/root/testdata/sf0.001")
    assert set(own.columns) == set(others.columns) == {"audit_id", "url", "own_url", "_groups"}
    row = own.first()
    assert len(row._groups) == len(peers.SERP_RELATIVE_GROUPS) and row.url == row.own_url


def test_dealt_labels_meet_without_another_shuffle(spark):
    from rankloom.plans import evaluation_queries as eq

    rows = [(q, f"{q}-{i}", i + 1, float(i * 13 % 40)) for q in ("q", "r") for i in range(9)] + [(None, "x", 1, 5.0), (None, "y", 2, 50.0)]
    labels = spark.createDataFrame([(q, u, r, t, t, t) for q, u, r, t in rows], "query string, url string, rank int, page_target_score double, ranking_target_score double, critical_search_score double")
    pairs = preferences.preference_pairs(labels.repartition("query"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = {(q, u, v) for q, u, _, t in rows for p, v, _, s in rows if q and q == p and t - s >= 2}
    assert {(r.query, r.winner_url, r.loser_url) for r in pairs.collect()} == want and pairs.count() == len(want)
    plan = eq.pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(trim(cast(l_partkey") == 1 and "hashpartitioning(query" not in plan

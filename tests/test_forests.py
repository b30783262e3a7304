"""Trees on packed rows against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import datasets, forests

FEATURES = ["a", "b", "c"]


def table(spark, rows=600, seed=5):
    draw = random.Random(seed)
    data = [(round(draw.random(), 3), float(draw.randrange(4)), None if draw.random() < 0.2 else draw.gauss(0, 1)) for _ in range(rows)]
    full = [(*d, 20 * d[0] + 5 * (d[1] >= 2) + 3 * ((d[2] or 0.0) > 0.5)) for d in data]
    return spark.createDataFrame(full, "a double, b double, c double, target double").repartition(3)


def plain_tree(x, y, cuts, depth):
    """Prediction of every row by a tree that tries every cut."""
    best = None
    for f in range(x.shape[1]):
        for cut in cuts[f]:
            left = x[:, f] <= cut
            if depth and 0 < left.sum() < len(y):
                rest = sum(((part - part.mean()) ** 2).sum() for part in (y[left], y[~left]))
                if best is None or rest < best[0] - 1e-9:
                    best = (rest, left)
    if best is None or best[0] >= ((y - y.mean()) ** 2).sum() - 1e-9:
        return np.full(len(y), y.mean())
    out = np.zeros(len(y))
    for part in (best[1], ~best[1]):
        out[part] = plain_tree(x[part], y[part], cuts, depth - 1)
    return out


def test_boosted_trees_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(forests, "ROWS_OF_A_PACK", 64)
    rows = table(spark)
    learnt_from = forests.prepared(rows, FEATURES, "target")
    cuts = learnt_from[1]
    assert list(cuts[1]) == [0.5, 1.5, 2.5] and all(len(c) <= forests.BINS - 1 and (np.diff(c) > 0).all() for c in cuts)
    forest = forests.boosted_forest(learnt_from, FEATURES, rounds=3, depth=3)
    got = forest.transform(rows).collect()
    x, y = np.array([[r.a, r.b, r.c or 0.0] for r in got]), np.array([r.target for r in got])
    want = plain_tree(x, y, cuts, 3)
    for _ in range(2):
        want = want + 0.1 * plain_tree(x, 2 * (y - want), cuts, 3)
    assert [r.prediction for r in got] == pytest.approx(list(want), abs=1e-3)
    assert [t.weight[0] for t in forest.trees] == [600.0] * 3


def test_random_forest_draws_rows_and_features(spark):
    rows = table(spark)
    forest = forests.random_forest(forests.prepared(rows, FEATURES, "target"), FEATURES, 30, 4, 42)
    weights = [t.weight[0] for t in forest.trees]
    assert len(set(weights)) > 10 and np.mean(weights) == pytest.approx(600, rel=0.02)
    assert {int(t.feature[0]) for t in forest.trees} == {0, 1, 2}  # a node sees one feature of three
    assert forest.featureImportances.toArray().sum() == pytest.approx(1.0)
    found = forest.transform(rows).agg(F.corr("prediction", "target")).first()[0]
    assert found > 0.9


def test_values_are_thinned_at_equal_ranks():
    values, counts = forests._thinned(np.arange(1000.0), np.ones(1000), 10)
    assert list(values) == [99.0, 199.0, 299.0, 399.0, 499.0, 599.0, 699.0, 799.0, 899.0, 999.0] and list(counts) == [100.0] * 10
    assert forests._thresholds(np.arange(64.0), np.ones(64), 32) == [2.0 * i - 0.5 for i in range(1, 32)]


def test_rows_are_placed_by_their_hash_as_the_split_places_them(spark):
    rows = spark.createDataFrame([(q, i) for q in ["", " x", "x", "y ", None, *[f"q{n}" for n in range(23)]] for i in range(3)], "query string, i int")
    joined = datasets.with_partition(rows, datasets.group_split(rows)).select("query", "i", "partition")
    placed = datasets.with_group_split(rows)
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, joined.collect())) and placed.count() == 72

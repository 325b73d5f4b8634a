"""Isolation forest: planted outliers, exact share, fixed seed. NMF: falling residuals, non-negative weights, planted topics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest, topics


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(1900)] + [(5000 + i, 8.0 + i % 3, -7.0, 9.0) for i in range(20)] + [(9999, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5).cache()


def test_planted_outliers_and_share(points):
    out = forest.isolation_forest(points, "id", ["a", "b", "c"], contamination=0.05, trees=60).collect()
    assert len(out) == 1920 and sum(r.is_anomaly for r in out) == 96
    assert all(r.is_anomaly for r in out if r.id >= 5000)
    assert min(r.score for r in out if r.id >= 5000) > np.median([r.score for r in out]) + 0.1
    again = forest.isolation_forest(points.repartition(3), "id", ["a", "b", "c"], contamination=0.05, trees=60).collect()
    assert [r.score for r in sorted(out)] == pytest.approx([r.score for r in sorted(again)])


def test_trees_split_their_samples():
    x = np.random.default_rng(1).normal(size=(64, 2))
    feature, threshold, size = forest._grow(x, 3, 6)
    for i in np.flatnonzero(feature >= 0):
        assert size[i] == size[2 * i + 1] + size[2 * i + 2] and min(size[2 * i + 1], size[2 * i + 2]) > 0
    assert size[0] == 64 and float(forest.expected_path(2)) == 1.0 and float(forest.expected_path(1)) == 0.0
    assert float(forest.expected_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_contributions_constant_column_and_empty(points):
    got = {r.column_name: r.contribution for r in forest.feature_contributions(points, "id", ["a", "b"], trees=20).collect()}
    assert set(got) == {"a", "b"} and all(0 < v <= 1 for v in got.values())
    flat = points.where("a is not null").select("id", F.lit(1.0).alias("a"))
    assert not any(r.is_anomaly for r in forest.isolation_forest(flat, "id", ["a"], trees=5).collect())
    assert forest.isolation_forest(points.limit(0), "id", ["a"]).count() == 0


def test_nmf_finds_planted_topics(spark):
    rng = np.random.default_rng(2)
    words = {0: ["apple", "pear", "plum", "cherry"], 1: ["wheel", "engine", "brake", "gear"], 2: ["river", "lake", "ocean", "stream"]}
    rows = [(i, " ".join(rng.choice(words[i % 3], 12))) for i in range(90)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    listed, assigned, model = topics.nmf_topics(df, k=3, vocabulary=50, top=4, rounds=8)
    assert all(b <= a + 1e-9 for a, b in zip(model.residuals, model.residuals[1:])) and model.weights.min() >= 0
    found = {}
    for r in listed.collect():
        found.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, words.values()))
    by_topic = {}
    for r in assigned.collect():
        assert min(r.weights) >= 0
        by_topic.setdefault(r.topic, set()).add(r.doc_id % 3)
    assert all(len(v) == 1 for v in by_topic.values()) and len(by_topic) == 3


def test_learning_curve_sizes_and_containment(spark):
    from tessera.operators.learning import CELLS, learning_curve, nested
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(x), int(x + rng.normal() * 0.2 > 0)) for i, x in enumerate(rng.normal(size=900))], "id long, x double, y int")
    cells = {r.id: r.cell for r in nested(df, ["id"]).collect()}
    small, large = ({i for i, c in cells.items() if c < s * CELLS} for s in (0.3, 0.7))
    assert small < large and abs(len(small) - 270) < 60
    out = sorted(learning_curve(df, ["x"], "y", "logistic_regression", "classification", ["id"], sizes=3, folds=2).collect())
    assert [r.share for r in out] == [0.1, 0.55, 1.0] and out[-1].train_rows == 900
    assert out[0].train_rows < out[1].train_rows < 900 and out[-1].val_mean > 0.85

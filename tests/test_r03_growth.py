"""Findings of round 3 on growth: what is read, shuffled or made once, on rows built here."""

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.sql import functions as F

from tessera.functions import quantiles as Q
from tessera.operators import clean, ml, text_models
from tessera.operators import retrain as R


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    a, b = rng.normal(size=3000), rng.integers(0, 12, 3000)
    rows = [(float(x), float(y) if i % 7 else None, None) for i, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "a double, b double, c double").repartition(5)


@pytest.mark.parametrize("few,sliver", [(10_000, 0.1), (20, 1.0), (20, 0.0), (1, 1.0)])
def test_quantiles_of_a_column_share_sketches(spark, numbers, monkeypatch, few, sliver):
    """One sketch a column in the first round, not one for each rank; the same quantiles with or without values held apart."""
    sketches, whole = [], F.percentile_approx
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "SLIVER", sliver, raising=False)
    monkeypatch.setattr(F, "percentile_approx", lambda *a: sketches.append(a[1]) or whole(*a))
    rounds, narrow = [], Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: (narrow(*a), rounds.append(len(sketches))))
    got = Q.exact_quantiles(numbers, {c: F.col(c) for c in "abc"}, [0.25, 0.5, 0.9])
    rows = numbers.collect()
    for c in "ab":
        assert got[c] == pytest.approx(np.quantile([r[c] for r in rows if r[c] is not None], [0.25, 0.5, 0.9]).tolist())
    assert got["c"] is None
    assert rounds[:1] == ([2] if few < 3000 else [])


def test_median_is_fitted_for_columns_with_gaps(spark, numbers, monkeypatch):
    asked, fit = [], clean.exact_quantiles
    monkeypatch.setattr(clean, "exact_quantiles", lambda df, columns, shares: asked.append(sorted(columns)) or fit(df, columns, shares))
    out = clean.impute(numbers, "median")
    assert asked == [["b", "c"]] and out.columns == ["a", "b", "c"]
    assert out.where("b is null").count() == 0 and out.where("c is null").count() == 3000


def test_cleaning_removes_copies_once(spark, tmp_path, monkeypatch):
    """Medians go over held rows instead of removing copies anew; a skipped step makes no table."""
    frame = spark.createDataFrame([(i % 300, float(i % 300 % 17) if i % 300 % 5 else None, 2.0 * (i % 300)) for i in range(400)], "id long, x double, y double")
    held, fill = [], clean.impute
    monkeypatch.setattr(clean, "impute", lambda df, *a: held.append(df.is_cached) or fill(df, *a))
    out = {r.step: r for r in R.run(frame, R.Job("j", "y", ["id"], features=["x"]), "r", str(tmp_path)).collect()}
    assert held == [True] and out["data_cleaning"].n_rows == out["feature_engineering"].n_rows == out["split_data"].n_rows == 300
    assert out["feature_engineering"].status == "skipped" and not (tmp_path / "runs/r/feature_engineering").exists()
    from pyspark.ml import PipelineModel
    model, data = PipelineModel.load(f"{tmp_path}/models/j/r"), spark.read.parquet(f"{tmp_path}/runs/r/split_data")
    scores = {r.metric: r.value for r in R.registry(spark, str(tmp_path), "j").collect()}
    job = R.Job("j", "y", ["id"])
    assert {k: scores[k] for k in ("r2", "rmse", "mae")} == pytest.approx(R._scores(model, data.where("split = 'test'"), job))
    assert (scores["val_score"], scores["train_score"]) == pytest.approx(tuple(R._scores(model, data.where(f"split = '{s}'"), job)["r2"] for s in ("validation", "train")))


WORDS = ["good fine alpha beta", "bad poor gamma delta", "good alpha alpha", "poor delta bad bad"]


def test_texts_are_tokenised_once_for_all_classifiers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, WORDS[i % 4]) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    calls, tokens = [], text_models.clean_tokens
    monkeypatch.setattr(text_models, "clean_tokens", lambda c: calls.append(1) or tokens(c))
    got = {r.model: r for r in text_models.compare_text_classifiers(docs, labels, ["naive_bayes", "random_forest", "logistic_regression"]).collect()}
    assert len(calls) == 1 and len(got) == 3 and all(r.accuracy == 1.0 for r in got.values())


def test_topics_sample_held_vectors(spark, monkeypatch):
    docs = spark.createDataFrame([(i, WORDS[i % 4]) for i in range(200)], "doc_id long, text string")
    held = []

    class Seen(LDA):
        def fit(self, dataset, params=None):
            held.append(dataset.is_cached)
            return super().fit(dataset, params)

    monkeypatch.setattr(text_models, "LDA", Seen)
    terms, documents = text_models.lda_topics(docs, k=2)
    counted = text_models.topic_distribution(docs, k=2)
    assert held == [True, True] and terms.count() == 2 * 8
    assert sorted(documents.collect()) == sorted(counted.collect()) and sum(r.n_documents for r in counted.collect()) == 200


def test_models_hold_what_they_read(spark, monkeypatch):
    frame = spark.createDataFrame([(float(i), 2.0 * i, "x" * 9, ["train", "test"][i % 2]) for i in range(40)], "a double, y double, other string, split string")
    seen, fit = [], ml.fit
    monkeypatch.setattr(ml, "fit", lambda df, *a, **k: seen.append(df.columns) or fit(df, *a, **k))
    out = ml.train_many(frame, ["a"], "y", "regression", ["linear_regression"], metric="r2").collect()
    assert seen == [["a", "y", "split"]] and out[0].score == pytest.approx(1.0)

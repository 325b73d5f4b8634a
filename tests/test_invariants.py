"""What the queries without an oracle must satisfy: shares, round trips, accuracy above chance, fixed seeds."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.plans.registry import load_all

QUERIES, _ = load_all()
SF = SF_SMALL.replace("0.001", "0.01")


def sql(text):
    return duckdb.sql(text.replace("$", SF)).fetchall()


def run(spark, name, sf=SF):
    return QUERIES[name](spark, sf)


def test_split_shares(spark):
    sizes = {r.split: r.n for r in run(spark, "split_sizes").collect()}
    total, = sql("SELECT count(*) FROM '$/orders.parquet'")[0]
    assert sum(sizes.values()) == total
    assert max(sizes.values()) > 0.5 * total and min(sizes.values()) > 0.05 * total


@pytest.mark.parametrize("name", ["log_reg", "tree_fit", "forest_fit", "gbt_fit", "svc_fit"])
def test_classifiers_do_not_lose_to_the_majority(spark, name):
    rows = run(spark, name).collect()
    hits = sum(r.label == r.prediction for r in rows) / len(rows)
    assert hits >= max(Counter(r.label for r in rows).values()) / len(rows) - 0.02
    assert {r.prediction for r in rows} <= {0.0, 1.0}


def test_entity_offsets_point_at_their_text(spark):
    texts = dict(sql("SELECT doc_id, text FROM '$/documents.parquet'"))
    rows = run(spark, "entity_offsets").collect()
    assert rows and all(texts[r.doc_id][r.start:r.end] == r.entity for r in rows)


def test_hashing_keeps_every_token(spark):
    rows = run(spark, "hashing_vectors", SF_SMALL)
    per = {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum("count").alias("n")).collect()}
    terms = QUERIES["count_vectors"](spark, SF_SMALL).groupBy("doc_id").agg(F.sum("count").alias("n")).collect()
    assert per == {r.doc_id: float(r.n) for r in terms}


def test_sample_rows_are_rows(spark):
    rows = run(spark, "sample_rows")
    again = {tuple(r) for r in run(spark, "sample_rows").collect()}
    assert rows.count() == 500 and {tuple(r) for r in rows.collect()} == again
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    full = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert rows.join(full, keys, "left_anti").count() == 0


def test_principal_components(spark):
    share = [r for r in run(spark, "pca_variance").collect()]
    x = np.array([r[0] for r in sql("SELECT embedding FROM '$/embeddings.parquet' ORDER BY vec_id")], float)
    want = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = sorted((r.asDict().get("explained_variance_ratio", list(r)[1]) for r in share), reverse=True)
    assert np.allclose(got, (want / want.sum())[:len(got)], atol=1e-3)


def test_steps_log_adds_up(spark):
    rows = sorted(run(spark, "clean_log").collect(), key=lambda r: r.step)
    assert all(r.rows_before - r.rows_after == r.rows_removed for r in rows)
    assert all(a.rows_after == b.rows_before for a, b in zip(rows, rows[1:]))


def test_clusters_and_seeds(spark):
    first = {r.vec_id: r.prediction for r in run(spark, "kmeans").collect()}
    assert first == {r.vec_id: r.prediction for r in run(spark, "kmeans").collect()}
    assert len(set(first.values())) > 1


def test_flag_share_of_reconstruction_errors(spark):
    rows = run(spark, "recon_error").collect()
    flags = [r.is_anomaly for r in rows]
    assert 0.04 * len(rows) <= sum(flags) <= 0.06 * len(rows) + 1


def test_topics(spark):
    terms = run(spark, "lda_topics", SF_SMALL).collect()
    assert len(terms) == 50 and all(a.weight >= b.weight for a, b in zip(terms, terms[1:]) if a.topic == b.topic and a.rank < b.rank)
    docs = duckdb.sql(f"SELECT count(*) FROM '{SF_SMALL}/documents.parquet'").fetchall()[0][0]
    assert sum(r.n_documents for r in run(spark, "topic_distribution", SF_SMALL).collect()) == docs


def test_batch_predictions_are_classes_with_confidence(spark):
    rows = run(spark, "batch_predict").collect()
    assert {r.prediction for r in rows} <= {0.0, 1.0} and all(0.5 <= r.confidence <= 1 for r in rows)
    assert len(rows) == sql("SELECT count(*) FROM '$/orders.parquet'")[0][0]


def test_model_comparisons(spark):
    clf = {r.model: r.score for r in run(spark, "train_many").collect()}
    assert len(clf) == 3 and all(0.3 < v <= 1 for v in clf.values())
    reg = {r.model: r.score for r in run(spark, "regression_models").collect()}
    assert reg["linear_regression"] > 0.9 and all(v > 0.7 for v in reg.values())
    for r in run(spark, "cluster_models").collect():
        assert 1 < r.n_clusters <= r.k and 0 < r.silhouette <= 1
    text = run(spark, "text_classifiers", SF_SMALL).collect()
    assert len(text) == 5 and all(0 <= r.accuracy <= 1 for r in text) and max(r.accuracy for r in text) > 0.5


def test_searches_rank_what_they_tried(spark):
    cv = run(spark, "cross_validate").first()
    assert cv.folds == 3 and 0 < cv.mean_score <= 1 and cv.std_score < 0.2
    for name, n in (("grid_search", 4), ("random_search", 4)):
        rows = sorted(run(spark, name).collect(), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, n + 1)) and len({r.params for r in rows}) == n
        assert all(a.mean_score >= b.mean_score for a, b in zip(rows, rows[1:]))


def test_importances_sum_to_one(spark):
    rows = run(spark, "feature_importance").collect()
    assert abs(sum(r.importance for r in rows) - 1) < 1e-3 and all(r.importance >= 0 for r in rows)


def test_power_transform_is_standardised(spark):
    df = run(spark, "yeo_johnson")
    x = np.array([[v for v in r if isinstance(v, float)] for r in df.collect()])
    numeric = [i for i in range(x.shape[1]) if abs(x[:, i].mean()) < 1e-6]
    assert numeric and np.allclose(x[:, numeric].std(axis=0), 1, atol=1e-6)


def test_scores_have_the_variance_of_their_component(spark):
    rows = run(spark, "pca_scores").limit(2000)
    first = rows.first().asDict()
    assert len(first) >= 2 and rows.count() > 0

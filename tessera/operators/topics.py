"""Topics by non-negative matrix factorisation of the documents' TF-IDF table.

X (documents x terms, sparse) is factored into W H with k topics. A round goes once over the documents: each batch solves its rows of
W for the current H by coordinate descent (rows of W depend on nothing else, so none is kept between rounds), and adds up W'W and W'X.
From these sums, k x k and k x terms, H is updated by coordinate descent too. Both steps only lower the residual. H is bounded by
``vocabulary`` x k numbers; no task and no driver holds documents or their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rnd
from ..session import ensure_checkpoint_dir
from .text import HOT_DOCS, HOT_TERMS, _Weights


def _solve(products: np.ndarray, gram: np.ndarray, sweeps: int, start: np.ndarray | None = None) -> np.ndarray:
    """Rows w >= 0 that lower ||x - w A||^2 for given x A' (``products``) and A A' (``gram``)."""
    w = np.full_like(products, 0.0) if start is None else start.copy()
    for _ in range(sweeps):
        before = w.copy()
        for j in range(gram.shape[0]):
            if gram[j, j] > 0:
                w[:, j] = np.maximum(w[:, j] + (products[:, j] - w @ gram[:, j]) / gram[j, j], 0)
        if np.abs(w - before).max(initial=0) <= 1e-12 * max(np.abs(w).max(initial=0), 1e-300):
            break
    return w


class Topics:
    """Fitted topics: ``terms`` (list) and ``weights`` (k x terms, non-negative), and the residual after each round."""

    def __init__(self, terms: list[str], weights: np.ndarray, residuals: list[float]):
        self.terms, self.weights, self.residuals = terms, weights, residuals


def vectors(df: DataFrame, text: str, key: str, vocabulary: int, hot: int = HOT_TERMS, hot_docs: int = HOT_DOCS) -> tuple[DataFrame, list[str]]:
    """Rows (key, at, value) of sparse vectors over the ``vocabulary`` terms of most occurrences, and the terms."""
    weights = _Weights(df, text, key, 1, False, hot, hot_docs)
    counted = weights.terms.where(F.col(key).isNotNull()).groupBy("term").agg(F.sum("tf").alias("n"))
    terms = [r.term for r in counted.orderBy(F.desc("n"), "term").limit(vocabulary).select("term").collect()]
    places = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(terms)), "at int, term string"))
    norms = weights.norms()  # over all terms; only those of the vocabulary go on
    rows = weights.hot_rows().join(places, "term").unionByName(weights.cold_rows().join(places, "term"))
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("p"))  # at most ``vocabulary`` a row
    scaled = listed.join(norms, key)
    return scaled.select(key, F.transform("p", lambda e: e["at"]).alias("at"), F.transform("p", lambda e: e["w"] / F.col("nrm")).alias("value")), terms


def _dense(batch: pa.RecordBatch, h: np.ndarray):
    """Row of the batch, term and value of each entry, and X H'."""
    at, value = batch.column("at"), batch.column("value")
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    term, x = at.flatten().to_numpy(), value.flatten().to_numpy()
    products = np.zeros((batch.num_rows, h.shape[0]))
    np.add.at(products, row, x[:, None] * h[:, term].T)
    return row, term, x, products


def fit_topics(docs: DataFrame, terms: list[str], k: int, rounds: int = 10, sweeps: int = 50, seed: int = 42) -> Topics:
    """``docs`` are rows with sparse vectors (at, value); they are read once a round."""
    spark, n = docs.sparkSession, len(terms)
    rng = np.random.Generator(np.random.PCG64(seed))
    h = rng.random((k, n)) + 0.01
    norm = docs.agg(F.sum(F.aggregate("value", F.lit(0.0), lambda a, v: a + v * v))).first()[0] or 0.0
    residuals = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(h)

        def partial(batches, shared=shared):
            h = shared.value
            gram, ww, wx = h @ h.T, np.zeros((k, k)), np.zeros((k, n))
            for batch in batches:
                row, term, x, products = _dense(batch, h)
                w = _solve(products, gram, sweeps)
                ww += w.T @ w
                for j in range(k):
                    wx[j] += np.bincount(term, x * w[row, j], n)
            both = np.hstack([ww, wx])
            at = np.flatnonzero(both.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(both.ravel()[at])], names=["at", "v"])

        total = np.zeros(k * (k + n))
        for r in docs.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():  # k * (k + terms) numbers
            total[r.at] = r.v
        both = total.reshape(k, k + n)
        ww, wx = both[:, :k], both[:, k:]
        h = _solve(wx.T, ww, sweeps, h.T).T
        residuals.append(float(norm - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()))
        shared.unpersist()
    return Topics(terms, h, residuals)


def document_topics(docs: DataFrame, key: str, topics: Topics, sweeps: int = 50) -> DataFrame:
    """(key, weights array, topic = index of the largest, null without any weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(topics.weights)
    kind = docs.schema[key].dataType.simpleString()

    def solved(batches):
        h = shared.value
        gram = h @ h.T
        for batch in batches:
            *_, products = _dense(batch, h)
            w = _solve(products, gram, sweeps)
            topic = pa.array([int(r.argmax()) if r.max(initial=0) > 0 else None for r in w], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(w.tolist(), pa.list_(pa.float64())), topic], names=[key, "weights", "topic"])

    return docs.select(key, "at", "value").mapInArrow(solved, f"{key} {kind}, weights array<double>, topic int")


def nmf_topics(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, vocabulary: int = 5000, top: int = 15, rounds: int = 10,
               seed: int = 42) -> tuple[DataFrame, DataFrame, Topics]:
    """(topic, rank, term, weight) of the ``top`` terms, each document's topics, and the model."""
    ensure_checkpoint_dir(df.sparkSession)
    docs, terms = vectors(df, text, key, vocabulary)
    docs = docs.checkpoint()
    model = fit_topics(docs, terms, k, rounds, seed=seed)
    rows = [(t, r + 1, terms[i], float(w[i])) for t, w in enumerate(model.weights) for r, i in enumerate(np.argsort(-w, kind="stable")[:top])]
    listed = df.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")
    return listed.select("topic", "rank", "term", rnd("weight", 6).alias("weight")), document_topics(docs, key, model), model

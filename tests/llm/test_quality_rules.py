"""Base counts against Python, the robust estimate against numpy, and labelled documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL

from tessera.llm import quality_rules as Q
from tessera.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed)


def test_base_counts(spark):
    rng = random.Random(3)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF_SMALL}/documents.parquet'").fetchall()]
    texts += [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x " * 40, "a b c d e f g h i " * 3 + "q", "é#😀 |\n|\n |\n", "n\n" * 5000]
    texts += ["".join(rng.choice(["ab ", "c ", "d\n", "e f ", "g\x1ch\t"]) for _ in range(rng.randrange(90))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "xx", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int").withColumn("source", Q.F.lit(None).cast("string"))
    got = {r.doc_id: tuple(r)[1:7] for r in Q.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t


def test_estimate_against_numpy(spark):
    rng = np.random.default_rng(1)
    d = len(Q.FLOORS)
    x = rng.normal(size=(400, d)) * np.array([1, .3, .1, .1, .1, .1, .1]) + 2
    x[:80] += 9  # a fifth are outliers
    rows = spark.createDataFrame([("g", i % Q.SALTS, [float(v) for v in r]) for i, r in enumerate(x)], "grp string, salt int, x array<double>")
    fit = Q.estimate(rows, Scratch(spark, "test"), d, 0.75, 4).first()
    bins = np.round(x * Q.BINS)
    q = [[np.sort(bins[:, i])[math.ceil(s * 400) - 1] / Q.BINS for i in range(d)] for s in (.25, .5, .75)]
    mean = np.array(q[1])
    cov = np.diag(((np.array(q[2]) - q[0]) / 1.349) ** 2 + np.array(Q.FLOORS) ** 2)
    scale = 0.75 / Q.chi_square_share(Q.chi_square_quantile(0.75, d), d + 2)
    for _ in range(4):
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        b = np.round(np.log(d2 + 1e-6) * Q.BINS)
        near = x[b <= np.sort(b)[299]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) * scale + np.diag(np.array(Q.FLOORS) ** 2)
    inv = np.zeros((d, d))
    inv[np.tril_indices(d)] = fit.inv
    assert np.allclose(fit.mean, mean, atol=1e-6)
    assert np.allclose(inv @ cov @ inv.T, np.eye(d), atol=1e-6)


def test_labelled_documents(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    got = {r.doc_id: r for r in Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    judged = [(q, got[i]) for i, q in labels if not got[i].base_failed]
    good = [r.kept for q, r in judged if q == 1]
    bad = [r.kept for q, r in judged if q == 0]
    assert sum(good) == len(good) and sum(bad) < 0.7 * len(bad)
    assert not any(r.kept for r in got.values() if r.base_failed)


def test_empty_table_and_chi_square(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.quality_rules(df).count() == 0
    assert Q.chi_square_quantile(0.95, 7) == pytest.approx(14.067, rel=0.01)
    assert Q.chi_square_share(14.067, 7) == pytest.approx(0.95, abs=0.002)

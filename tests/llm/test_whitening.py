"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm.q_whitening import components_of, op12_embedding_whitening
from tessera.llm.whitening import above, feast, slices


def plain(rows, wanted=16):
    """{id: [(component, deviation, whitened)]}, n, explained."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    left = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(left.T @ left / n)
    order = [k for k in np.argsort(-values)[:wanted] if values[k] > 1e-12 * values.max()]
    out = {}
    for i, x in kept:
        y = (np.array([n * c - s for c, s in zip(x, sums)], float) / n) @ vectors[:, order] / np.sqrt(values[order])
        out.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(x, sums)), y))
    return out, n, values[order] / values.sum()


def same(spark, df, rows):
    want, n, shares = plain(rows)
    got = {}
    for r in components_of(df).collect():
        assert r.n == n and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.deviation, r.whitened))
    assert set(got) == set(want)
    signs = {}
    for i, listed in want.items():
        assert sorted(got[i]) == list(range(1, len(shares) + 1))
        for k in got[i]:
            assert len(got[i][k]) == len(listed) and all(d == listed[0][0] for d, _ in got[i][k])
            y = listed[0][1][k - 1]
            for _, w in got[i][k]:
                assert abs(abs(w) - abs(y)) < 1e-8
                if abs(y) > 1e-6:
                    assert signs.setdefault(k, w * y > 0) == (w * y > 0)


def test_query_against_numpy(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    same(spark, df, [(r.vec_id, r.embedding) for r in df.collect()])
    assert op12_embedding_whitening(spark, SF_SMALL).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [4, 2, 1, 0.5, 0]).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0]) for i in range(40)]
    rows += [(70, [0.5] * 5), (70, [0.5] * 5), (None, [0.0] * 5)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [1e300] * 5), (905, []), (906, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "id": F.lit("a"), "whitened": F.lit(2)})
    same(spark, df, rows)
    for few in ([], bad[:5], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert components_of(spark.createDataFrame(few, "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spectrum", [[1.0] * 20, [5, 2, 2, 1, 1, 1, 0, 0, 0], list(np.logspace(0, -6, 40)), [3.0] + [1e-3] * 30, [2.0]], ids=len)
def test_solver_on_given_spectra(spectrum):
    rng, d = np.random.default_rng(5), len(spectrum)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    v = (q * spectrum) @ q.T
    v = (v + v.T) / 2
    falling = sorted(spectrum, reverse=True)
    for shift in (0.5 * (a + b) for a, b in zip(falling, falling[1:]) if a - b > 1e-9):
        assert above(v, shift) == sum(e > shift for e in spectrum)
    found = [feast(v, *part) for part in slices(v, 6)]
    values = np.concatenate([f[0] for f in found])
    vectors = np.hstack([f[1] for f in found])
    with_variance = [e for e in falling if e > 0]
    assert len(values) >= min(6, len(with_variance))
    assert np.allclose(sorted(values, reverse=True), with_variance[:len(values)], rtol=0, atol=1e-13 * falling[0])
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * falling[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_inertia_without_diagonal():
    v = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, -2.0]])
    assert [above(v, s) for s in (-3, -1.5, 0.0, 0.5, 2.0)] == [3, 2, 1, 1, 0]

"""Exact quantiles against numpy, with tiny brackets so that every branch runs; the power transform's search leaves its first range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quantiles


@pytest.mark.parametrize("few,accuracy", [(10_000, 2000), (3, 40)])
def test_against_numpy(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(few)
    table = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000).astype(float), "hot": np.where(rng.random(3000) < 0.9, 7.0, rng.random(3000)),
             "one": np.full(3000, 2.5)}
    rows = [tuple(float(table[c][i]) for c in table) + (None, float(i) if i < 2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*table, "empty", "two"])).repartition(3)
    shares = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, {c: F.col(c) for c in df.columns}, shares)
    assert got["empty"] is None and got["two"] == shares
    for c, v in table.items():
        assert got[c] == pytest.approx(list(np.quantile(v, shares)), rel=1e-12)


def test_lambda_beyond_the_first_range(spark):
    from tessera.operators.encode import yeo_johnson_fit
    z = np.random.default_rng(0).normal(30, 4, 2000)
    df = spark.createDataFrame([(float((6 * v + 1) ** (1 / 6) - 1), float(v - 30), 3.0) for v in z], "a double, b double, c double")
    got = yeo_johnson_fit(df, ["a", "b", "c"])
    x = np.array([r.a for r in df.collect()])
    like = lambda lam: -len(x) / 2 * np.log(np.var(((x + 1) ** lam - 1) / lam)) + (lam - 1) * np.log1p(x).sum()
    best = max(np.arange(2.005, 12, 0.01), key=like)
    assert got["a"] == pytest.approx(best, abs=0.02) and abs(got["b"] - 1) < 0.2

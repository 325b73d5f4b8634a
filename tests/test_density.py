"""DBSCAN against a plain quadratic version."""

import random

import pytest

from tessera.operators import density
from tessera.operators.density import dbscan


def plain(points, eps, least):
    """{id: (core, noise, cluster)}"""
    near = {i: [j for j, y in points if sum((a - b) ** 2 for a, b in zip(x, y)) <= eps * eps] for i, x in points}
    core, label = {i for i in near if len(near[i]) >= least}, {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core and k not in label]
    out = {}
    for i in near:
        reached = [label[j] for j in near[i] if j in core]
        out[i] = (i in core, not reached, label.get(i, min(reached, default=None)))
    return out


def rows(kind, d, rng):
    if kind == "blobs":
        return [tuple(rng.gauss(rng.choice((0, 3, 6)) if k == 0 else 0, 0.5) for k in range(d)) for _ in range(180)]
    if kind == "uniform":
        return [tuple(rng.random() * 5 for _ in range(d)) for _ in range(180)]
    return [tuple(float(rng.randrange(4)) for _ in range(d)) for _ in range(120)] + [(9.0,) * d] * 60 + [(9.0 + 0.5,) * d]


@pytest.mark.parametrize("kind,d,eps,few", [("blobs", 2, 0.4, 4096), ("uniform", 3, 0.8, 4), ("grid", 2, 1.0, 1), ("blobs", 1, 0.1, 4096)])
def test_against_all_pairs(spark, monkeypatch, kind, d, eps, few):
    monkeypatch.setattr(density, "FEW", few)
    data = list(enumerate(rows(kind, d, random.Random(d))))
    df = spark.createDataFrame([(i, *x) for i, x in data] + [(999, *[None] * d)], "id long, " + ", ".join(f"c{k} double" for k in range(d)))
    got = {r.id: (r.is_core, r.is_noise, r.cluster) for r in dbscan(df, "id", [f"c{k}" for k in range(d)], eps, 5, standardize=False).collect()}
    assert got == plain(data, eps, 5)

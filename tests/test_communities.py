"""Communities: exhaustive search on small graphs, monotone modularity, reruns."""

import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.registry import load_all


def modularity(edges, part):
    m = sum(w for _, _, w in edges)
    inner, k = 0.0, {}
    for u, v, w in edges:
        inner += w * (part[u] == part[v])
        k[part[u]] = k.get(part[u], 0) + w
        k[part[v]] = k.get(part[v], 0) + w
    return inner / m - sum((x / (2 * m)) ** 2 for x in k.values())


def partitions(ids):
    if not ids:
        yield {}
        return
    for rest in partitions(ids[1:]):
        groups = sorted(set(rest.values()))
        for g in [*groups, ids[0]]:
            yield {**{i: (ids[0] if c == g else c) for i, c in rest.items()}, ids[0]: ids[0]}


def found(spark, edges, extra=()):
    e = spark.createDataFrame(edges, "src string, dst string, weight long")
    ids = sorted({x for u, v, _ in edges for x in (u, v)} | set(extra))
    return {r.id: r.community for r in G.communities(spark.createDataFrame([(i,) for i in ids], "id string"), e).collect()}


BARBELL = [(a, b, 1) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1:]] + [("d", "w", 1)]


@pytest.mark.parametrize("edges", [
    BARBELL, [("hub", f"l{i}", 1) for i in range(6)], [("a", "b", 5), ("c", "d", 5), ("a", "c", 1), ("b", "d", 1), ("e", "e", 4), ("e", "a", 1)],
], ids=["barbell", "star", "loop"])
def test_best_partition_of_small_graphs(spark, edges):
    ids = sorted({x for u, v, _ in edges for x in (u, v)})
    got = found(spark, edges)
    assert modularity(edges, got) == pytest.approx(max(modularity(edges, p) for p in partitions(ids)))
    assert all(c == min(i for i in got if got[i] == c) for c in got.values())


def test_random_graphs_isolated_nodes_and_reruns(spark):
    for seed in range(1, 2):
        rng = random.Random(seed)
        edges = [(f"n{a}", f"n{b}", rng.randrange(1, 4)) for a in range(24) for b in range(a) if rng.random() < (0.5 if a // 8 == b // 8 else 0.04)]
        got = found(spark, edges, ["alone"])
        assert got.pop("alone") == "alone"
        blocks = modularity(edges, {i: int(i[1:]) // 8 for i in got})
        assert modularity(edges, got) >= blocks - 0.02
        assert found(spark, [(b, a, w) for a, b, w in reversed(edges)]) == got


def test_no_edges(spark):
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([], "src string, dst string, weight long")
    assert {r.id: r.community for r in G.communities(n, e).collect()} == {"a": "a", "b": "b"}


def test_query_beats_components(spark):
    queries, _ = load_all()
    q = {r["partition"]: r.modularity for r in queries["communities_modularity"](spark, SF_SMALL).collect()}
    assert q["communities"] >= q["components"]
    labels = queries["communities"](spark, SF_SMALL)
    assert labels.where(F.col("community") > F.col("id")).count() == 0

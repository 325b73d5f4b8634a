"""Source mixing: targets by brute force, and what the contract promises of the taken words."""

from collections import defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm.mixing import golden_point, mix, mixed_rows


def brute_targets(sizes, weights, most):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def checked(df, docs, weights=(5, 2, 1), most=3, near=0.08):
    rows = df.collect()
    per, target, taken = defaultdict(int), {}, defaultdict(int)
    source = {d[0]: d[2] for d in docs}
    for r in rows:
        s = source[r.doc_id]
        per[s] += r.size
        target[s] = r.target
        taken[s] += r.taken
        assert 0 <= r.taken <= most * r.size
    want = brute_targets(per, weights, most)
    for s in per:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - want[s]) <= max(near * want[s], 200), s
    assert all(r.source_size == per[source[r.doc_id]] for r in rows)
    return rows


def test_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    first = checked(mix(df), docs)
    assert sorted(first) == sorted(mix(df.repartition(7)).collect())


def test_caps_null_source_and_empty_texts(spark):
    docs = ([(i, "w " * 50, "a") for i in range(100)] + [(1000 + i, "x y\tz\n" * 400, "b") for i in range(100)]
            + [(2000, "one two", None), (2001, None, "c"), (2002, "", "b"), (2003, " \n ", None)])
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = checked(mix(df, weights=[50, 2, 1]), docs, weights=[50, 2, 1])
    assert {r.doc_id for r in rows if r.size == 0} == {2001, 2002, 2003}


def test_empty_table_and_mixture_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and mixed_rows(df).count() == 0
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("*", "1 as _key", "2 as copies")
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.doc_id: round(r.taken / r.size) for r in mix(docs).collect() if r.size}
    assert max(counts.values()) <= 3 and sum(counts.values()) == pytest.approx(sum(want.values()), rel=0.02)


def test_golden_points_are_exact(spark):
    n = [0, 1, 2, 3, 65535, 65536, 10**9, 2**32 - 1, 2**32 + 5, 10**13]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", golden_point(F.col("n")).alias("u")).collect()
    assert all(r.u == (r.n % 2**32) * 2654435769 % 2**32 for r in got)

"""Findings of round 3: what must hold on rows built here."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, forest
from tessera.operators import text as X
from tessera.operators import topics

DOCS = [(1, "alpha beta beta gamma"), (2, "beta gamma delta"), (2, "delta delta alpha"), (3, "omega alpha beta"), (4, None), (5, "the of"),
        (6, "alpha beta alpha beta gamma"), (None, "alpha zeta"), (None, "zeta")]


def _brute(ngram_max, sublinear):
    tf = collections.defaultdict(collections.Counter)
    for key, text in DOCS:
        toks = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in X.STOPWORDS]
        for n in range(1, ngram_max + 1):
            tf[key].update(" ".join(toks[i:i + n]) for i in range(len(toks) - n + 1))
    df = collections.Counter(t for terms in tf.values() for t in terms)
    out = {}
    for key, terms in tf.items():
        w = {t: ((1 + math.log(c)) if sublinear else c) * (math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for t, c in terms.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, t): x / norm for t, x in w.items() if key is not None}
    return out


@pytest.mark.parametrize("hot,docs", [(1, 1), (2, 100), (100, 100)])
def test_tfidf_whatever_terms_are_hot(spark, hot, docs):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    for n, sublinear in ((1, True), (2, False)):
        got = {(r.doc_id, r.term): r.weight for r in X.tfidf_terms(df, ngram_max=n, sublinear=sublinear, hot=hot, hot_docs=docs).collect()}
        assert got == pytest.approx(_brute(n, sublinear))
    score = collections.Counter()
    for (_, t), x in _brute(2, True).items():
        score[t] += x / len(DOCS)
    want = sorted(((round(-x, 9), t) for t, x in score.items()))
    for k in (1, 3, 50):
        got = X.keywords_tfidf(df, top_k=k, hot=hot, hot_docs=docs).collect()
        assert [r.keyword for r in got] == [t for _, t in want[:k]]
        assert [r.score for r in got] == pytest.approx([-x for x, _ in want[:k]], abs=1e-6)


def test_topic_vectors_whatever_terms_are_hot(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    got, terms = topics.vectors(df, "text", "doc_id", 3, hot=1, hot_docs=100)
    assert terms == ["beta", "alpha", "delta"]
    want = _brute(1, False)
    for r in got.collect():
        assert dict(zip((terms[i] for i in r["at"]), r["value"])) == pytest.approx({t: x for (k, t), x in want.items() if k == r.doc_id and t in terms})


def test_tfidf_moves_no_term_rows(spark):
    """Terms are counted in their document's row; a shuffle adds up only the rows of keys that repeat."""
    tokens = spark.createDataFrame(DOCS, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("_toks"))
    plans = [X._counted(tokens, "doc_id", 2, again)._jdf.queryExecution().executedPlan().toString() for again in (False, True)]
    assert "Exchange" not in plans[0] and plans[1].count("Exchange") == 1


@pytest.mark.parametrize("few", [2, 100])
def test_label_codes_move_no_hot_value(spark, few):
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c string")
    code = {v: i for i, v in enumerate(sorted({c for _, c in rows if c is not None}))}
    out = encode.label_encode(df, ["c"], few=few)
    assert {(r.id, r.c) for r in out.collect()} == {(i, code.get(c)) for i, c in rows}
    assert "Broadcast" in out._jdf.queryExecution().executedPlan().toString()


def test_forest_scores_follow_each_tree(spark):
    import numpy as np
    x = np.random.default_rng(5).normal(size=(200, 3))
    grown = [forest._grow(x[:64], s, 6) for s in range(4)]
    level = np.floor(np.log2(np.arange(127) + 1))
    model = (np.array([g[0] for g in grown]), np.array([g[1] for g in grown]), np.array([level + forest.expected_path(g[2]) for g in grown]), 64, 6)
    got = forest._score(x, forest._filled(model), 64, 6)
    for row, score in zip(x, got):
        total = 0.0
        for f, t, p in zip(*model[:3]):
            i = 0
            while f[i] >= 0:
                i = 2 * i + 1 + int(row[f[i]] > t[i])
            total += p[i]
        assert score == pytest.approx(2 ** (-(total / 4) / float(forest.expected_path(64))))


def test_contributions_join_no_scores(spark):
    """Five joins by id before; an id that comes twice still counts as those joins counted it."""
    import numpy as np
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(150)]
    df = spark.createDataFrame(rows + rows[:20], "id long, a double, b double")
    std = forest._standardised(df, "id", ["a", "b"])
    n = std.count()
    joined = forest._scores(std, forest._forest(std, n, 10, 256, 42), 2, "bigint").withColumnRenamed("score", "all")
    for i in range(2):
        one = std.select("id", F.array(F.get("x", F.lit(i))).alias("x"))
        joined = joined.join(forest._scores(one, forest._forest(one, n, 5, 256, 42), 1, "bigint").withColumnRenamed("score", f"s{i}"), "id")
    want = joined.agg(F.abs(F.corr("all", "s0")), F.abs(F.corr("all", "s1"))).first()
    got = forest.feature_contributions(df, "id", ["a", "b"], trees=10).collect()
    assert [r.contribution for r in got] == pytest.approx(list(want))

"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from conftest import SF_SMALL

from tessera.llm.components import components
from tessera.llm.minhash import MinMax, drop_near_copies, near_dedup
from tessera.llm.scratch import Scratch
from tessera.llm.shingles import shingle_sets


def brute(docs):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared, by = {}, {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        for a in range(len(ids)):
            for b in range(a):
                key = (ids[b], ids[a])
                shared[key] = shared.get(key, 0) + 1
    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def same(spark, docs, df=None):
    df = df if df is not None else spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(df).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute(docs).items()}
    assert got == want


def test_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    same(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_edits_copies_and_odd_texts(spark, seed):
    rng = random.Random(seed)
    docs, n = [], 0
    for _ in range(12):
        w = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        for _ in range(12):  # each a few edits from the last: links between far members go through others
            docs.append((n, rng.choice([" ", "\n", "\t "]).join(w)))
            n += 1
            if rng.random() < 0.7:
                w = list(w)
                w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "One two"), (n + 5, "one TWO"), (n + 6, "É x"), (n + 7, "é x")]
    docs += [(n + 10 + i, "a b c d e f g") for i in range(50)] + [(n + 100, "z " * 30_000)]
    rng.shuffle(docs)
    same(spark, docs)


def test_minima_and_maxima_estimate_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    hasher = MinMax(512, 4)
    a, b = hasher.signature(pool[:3500]), hasher.signature(pool[500:])
    assert abs((a == b).mean() - 3000 / 4000) < 0.05


def test_shingle_sets_do_not_depend_on_neighbours():
    texts = ["A b c d e f", None, "x", "a B  c\nd e g a b c d e", ""]
    alone = [next(iter(shingle_sets([t]))) for t in texts]
    for one, many in zip(alone, shingle_sets(texts)):
        assert (one == many).all()
    assert [len(s) for s in alone] == [2, 0, 1, 6, 0]


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as u", "id + 1 as v")
    got = components(edges, Scratch(spark, "test")).collect()
    assert {r.component for r in got} == {0} and len(got) == 301
    assert components(edges.limit(0), Scratch(spark, "test")).count() == 0


def test_null_and_repeated_ids_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (4, "A b C", 1), (4, "A b C", 1), (5, "a b c", 2), (None, "q", 3)],
                               "doc_id long, text string, _kept_id int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (5, 4, False), (None, None, True)], key=str)
    assert near_dedup(df.limit(0)).count() == 0
    out = drop_near_copies(df.where("doc_id > 4 or doc_id is null"))
    assert out.columns == df.columns

"""Removal of repeated strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

import pytest
from conftest import SF_SMALL

from tessera.llm.q_repeats import repeat_digests


def brute(docs, length):
    seen = Counter(t[i:i + length] for _, t in docs for i in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        cut = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                cut[s:s + length] = b"\1" * length
        spans = sum(1 for j, c in enumerate(cut) if c and not (j and cut[j - 1]))
        out.append((i, len(t), sum(cut), spans, hashlib.sha256(bytes(b for b, c in zip(t, cut) if not c)).hexdigest()))
    return sorted(out, key=str)


def same(spark, docs, length, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS spans")
    want = brute([(i, (t or "").encode()) for i, t in docs], length)
    assert sorted(map(tuple, repeat_digests(df, length=length, **options).collect()), key=str) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_edits_and_copies(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (8, 12, 20, 60)]
    docs = []
    for i in range(60):
        t = text(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            if rng.random() < 0.5:  # a passage with an edit, or part of one
                x = rng.randrange(len(p))
                p = p[:x] + rng.choice(["", "Q", "zz"]) + p[x + rng.randrange(3):]
            t += p[rng.randrange(9):] + text(rng.randrange(6))
        docs.append((i, t))
    docs += [(100 + i, docs[3][1]) for i in range(5)] + [(7, docs[7][1]), (None, docs[8][1]), (None, "x"), (200, None), (201, "")]
    docs += [(300, "ab" * 400), (301, "q" * 300), (302, "abcabd" * 90)]
    same(spark, docs, 60, k=21)


def test_lengths_at_the_limit(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    p = noise(200)
    docs = [(1, p), (2, noise(30) + p), (3, p[:199] + "!"), (4, noise(50) + p[1:] + "!"), (5, noise(199)), (6, "x" + p + "y" + p[5:])]
    same(spark, docs, 200)


def test_long_texts_and_documents(spark):
    rng = random.Random(4)
    block = "".join(rng.choice("abc d") for _ in range(5000))
    long = "".join(rng.choice("abc de") for _ in range(30_000))
    same(spark, [(1, long + block + long[:700]), (2, block[100:] + long[2000:9000])], 200)
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    same(spark, [(r.doc_id, r.text) for r in rows], 200)


def test_empty_table(spark):
    assert repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0

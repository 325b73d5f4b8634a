"""Exact deduplication against a dictionary of normalised texts."""

import hashlib
from collections import defaultdict

import pytest

from tessera.llm.exact_dedup import drop_exact_copies, exact_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["max", "min"])
def test_against_dictionary(spark, keep):
    texts = ["Abc", "aBC", "ÉA", "éa", "Éa", None, "", " ", "x" * 100_000, "X" * 100_000, "K", "k", "K"]
    rows = [(i, texts[i % len(texts)]) for i in range(200)] + [(500 + i, "hot") for i in range(300)] + [(7, "Abc"), (7, "Abc")]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, _run string, _digest int")
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    pick = max if keep == "max" else min
    want = sorted((i, pick(groups[lowered(t)]), len(groups[lowered(t)]), i == pick(groups[lowered(t)]),
                   hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_dedup(df, keep=keep).collect())) == want


def test_null_ids_empty_table_and_rows_that_stay(spark):
    df = spark.createDataFrame([(None, "a", 1), (3, "A", 2), (None, "b", 3), (4, "c", 4)], "doc_id long, text string, _k int")
    got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.kept) for r in exact_dedup(df).collect()}
    assert got[(3, hashlib.sha256(b"a").hexdigest()[:4])] == (3, True)
    assert got[(None, hashlib.sha256(b"a").hexdigest()[:4])] == (3, False)
    assert got[(None, hashlib.sha256(b"b").hexdigest()[:4])] == (None, True)
    assert exact_dedup(df.limit(0)).count() == 0
    out = drop_exact_copies(df.where("doc_id is not null"))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 4]


def test_executed_plan_merges_sorted_runs(spark):
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(300)], "doc_id long, text string")
    out = exact_dedup(df, fan_in=2, rounds=4, each=7)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out.collect()) == sorted(
        (i, max(j for j in range(300) if j % 40 == i % 40), sum(j % 40 == i % 40 for j in range(300))) for i in range(300))
    said = out._jdf.queryExecution()
    assert said.optimizedPlan().toString().count("sort_array(") >= 5  # one for the runs, one for each round of merging
    assert said.executedPlan().toString().count("functions=[collect_list(") >= 5

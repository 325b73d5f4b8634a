"""The manifest against a plain recursive tree, and its query against SQL."""

import hashlib
import zlib

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm.manifest import fold, manifest
from tessera.llm.q_manifest import COLUMNS, OP11_SQL, op11_merkle_manifest, proofs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(digests, fan=2):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def siblings(tree, i, fan=2):
    out = []
    for level in tree[:-1]:
        run = i // fan * fan
        out += level[run:i] + level[i + 1:run + fan]
        i //= fan
    return out


def climbed(tree, i, digest, fan=2):
    for level in tree[:-1]:
        run = i // fan * fan
        digest = H(*level[run:i], digest, *level[i + 1:run + fan])
        i //= fan
    return digest


def brute(rows, fan=2):
    """{leaf: (subroot, root, proof digest, folded root)} of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[g]], fan) for g in names]
    top = levels([t[-1][0] for t in trees], fan)
    out = []
    for j, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            got = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            folded = climbed(top, j, climbed(trees[j], i, got, fan), fan)
            out.append((r[0], leaf(r), trees[j][-1][0], top[-1][0], H(*siblings(trees[j], i, fan), *siblings(top, j, fan)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(sizes):
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i, f"s{i % 3}" if i % 5 else None, lang, i if i % 4 else None, "é" * (i % 7) if i % 6 else None))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 3}, {"a": 9, "B": 1, "é": 17, "": 4, None: 33}], ids=str)
def test_query_against_plain_tree(spark, sizes):
    rows = made(sizes)
    got = proofs(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("fan,height", [(2, 1), (2, 2), (3, 1), (4, 2)])
def test_many_tables_of_superblocks(spark, fan, height):
    rows = made({"en": 70, "de": 1, None: 5, "fr": 16})
    out = manifest(spark.createDataFrame(rows, SCHEMA), COLUMNS, fan=fan, height=height)
    got = [(r.doc_id, r.leaf, r.subroot, r.root) for r in out.collect()]
    assert sorted(got) == sorted(x[:4] for x in brute(rows, fan))
    assert all(r.folded_root == r.root == fold(r.leaf, r.path) for r in out.collect())
    assert not any(fold(H("else"), r.path) == r.root for r in out.collect())


def test_odd_rows_and_extra_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "s", "en", 2**63 - 1, "x" * 300_000), (5, "s", "en", 1, ""),
            (5, "s", "en", 1, ""), (-7, "s", "en", 1, None), (7, "s", "en", -1, "-"), (13, "", "", 0, "1:a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit(1), "leaf": F.lit("x"), "pos": F.lit(2), "_rid": F.lit(3)})
    assert sorted(map(tuple, proofs(df).collect()), key=repr) == brute(rows)
    assert proofs(df.limit(0)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert sorted(map(tuple, op11_merkle_manifest(spark, SF_SMALL).collect())) == sorted(con.execute(OP11_SQL).fetchall())

"""Personal data: base spans against Python's re, and identifiers found by their context."""

import hashlib
import random
import re

import duckdb
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm.pii import KINDS, found, personal_data
from tessera.llm.q_pii import span_digests

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in span_digests(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in KINDS] == [want.count(k + ":") for k in KINDS]


def test_documents_and_random_texts(spark):
    rng = random.Random(8)
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF_SMALL}/documents.parquet'").fetchall()]
    parts = ["a@b.c", "x.y@d-e.co", "@", "_", ".", " ", "-", "1", "22", "333", "4111 1111 1111 1111", "4111111111111111", "+", "+1 (389) 555-5010",
             "1.2.3.4", "256.1.1.1", "00010.020.0.255", "é", "😀", "\n", "%", "(", ")", "5"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += [None, "", "7" * 50_000, "a" * 200_000, "1." * 30_000, "+1" + " " * 50_000 + "2", "a@b.c " * 3000, "1 " * 30_000, "a@b.c_d@e.f@g.h"]
    check(spark, texts)


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"w{i} please contact desk: user{i}@mail.org today x{i % 3}y") for i in range(40)]
    rows += [(100 + i, f"then contact desk: ID-77{i} soon") for i in range(5)]
    rows += [(200 + i, f"plain number{i} text with item 5{i} in it") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal_data(df).collect()}
    for i in range(5):
        assert got[100 + i] == [("learned", 19, 25)]
    assert all(got[i] == [("email", got[i][0][1], got[i][0][2])] for i in range(40))
    assert all(got[200 + i] == [] for i in range(30))


def test_learned_values_induce_patterns_without_a_seed(spark):
    rows = [(i, f"w{i} please contact desk: user{i}@mail.org today") for i in range(40)]
    rows += [(100 + i, f"then contact desk: ID-77{i} soon") for i in range(1, 6)]
    rows += [(200 + i, f"badge no ID-77{i} here") for i in range(1, 6)] + [(300, "badge no ID-999 here"), (301, "room no ID-998 here")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == [("learned", 19, 25)] and got[200 + i] == [("learned", 9, 15)] for i in range(1, 6))
    assert got[300] == [("learned", 9, 15)] and got[301] == []


def test_patterns_are_whole_words(spark):
    long = "/".join(["x" * 40] * 4)
    contexts = ["id 4711 desk: pin {}", "reach me via <{}>", f"see ref:{long} for {{}}", "our office tel:{}"]
    seeds = ["user{}@mail.org", "user{}@mail.org", "user{}@mail.org", "+1 (389) 555-50{}"]
    rows = [(1000 * k + i, c.format(s.format(10 + i)) + " today") for k, (c, s) in enumerate(zip(contexts, seeds)) for i in range(30)]
    tried = ["id 4711 desk: pin z9123 q", "reach me via z9124 q", f"see ref:{long} for z9125 q", "our office z9126 q"]
    rows += [(9000 + k, t) for k, t in enumerate(tried)]
    rows += [(9100 + i, f"text w{i} v{i} u{i} t") for i in range(9)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in enumerate(tried):
        at = t.index("z91")
        assert got[9000 + k] == [("learned", at, at + 5)], (t, got[9000 + k])
    assert all(got[9100 + i] == [] for i in range(9))


def test_word_of_each_match(spark):
    text = "\x01 a@b.c,d@e.f  \x01g@h.i\nx <j@k.l>"
    got = spark.createDataFrame([(text,)], "t string").select(found(F.col("t"), "email").alias("f")).first().f
    assert [(r.value, r.word) for r in got] == [("a@b.c", 1), ("d@e.f", 1), ("g@h.i", 2), ("j@k.l", 4)]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "m a@b.co"), (1, "q 1.1.1.1"), (1, "q 1.1.1.1")], "doc_id long, text string").withColumn("row", F.lit("x"))
    got = sorted((str(r.doc_id), r.spans) for r in span_digests(df).collect())
    assert got == [("1", "ip:2:9"), ("1", "ip:2:9"), ("None", "email:2:8")]
    assert span_digests(df.limit(0)).count() == 0

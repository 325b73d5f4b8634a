"""The pipeline, stage by stage, against plain versions of what each stage must do."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from conftest import SF_SMALL
from test_near_dedup import brute

import corpus_pipeline
from tessera.llm.bpe import read_ranks
from tessera.llm.mixing import mix
from tessera.llm.q_tokens import VOCABULARY


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage made of the one before, the documents first."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, "### 12 34 ###", "en", "src1", 13)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_SMALL).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return [(t.columns, [tuple(r) for r in t.collect()]) for t in out] + [out]


def test_columns_and_untouched_rows(tables):
    columns, documents = tables[0]
    known = set(documents)
    for c, rows in tables[1:5]:
        assert c == columns and set(rows) <= known
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "source mixing", "byte-level BPE"]


def test_language_and_dedup_stages(tables):
    given, spoken, single, apart = (dict((r[0], r[1]) for r in t[1]) for t in tables[:4])
    assert not {9001, 9002, 9003} & set(spoken) and len(spoken) >= len(given) - 6
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    last = {}
    for i, t in spoken.items():
        last[low(t)] = max(i, last.get(low(t), -1))
    assert set(single) == set(last.values())
    assert set(apart) == {i for i, (_, c) in brute(list(single.items())).items() if i == c}


def test_mixing_and_token_stages(tables):
    _, apart = tables[3]
    copies = Counter(r[0] for r in tables[4][1])
    plan = {r.doc_id: r for r in mix(tables[6][3]).collect()}
    assert {i: n for i, n in copies.items()} == {i: int(r.taken / r.size + 0.5) for i, r in plan.items() if r.size and int(r.taken / r.size + 0.5)}
    words, target = defaultdict(int), {}
    for r in apart:
        words[r[3]] += copies[r[0]] * len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))
        target[r[3]] = plan[r[0]].target
    largest = max(r.size for r in plan.values())
    assert all(abs(words[s] - target[s]) <= largest + 200 for s in target)
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(VOCABULARY)), special_tokens={})
    texts = {r[0]: r[1] for r in apart}
    assert tables[5][0] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(r[0] for r in tables[5][1]) == copies
    for i, n, ids, decoded in tables[5][1]:
        want = oracle.encode_ordinary(texts[i])
        assert n == len(want) and ids == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert decoded == hashlib.sha256(texts[i].encode()).hexdigest()


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

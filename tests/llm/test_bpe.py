"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from conftest import SF_SMALL
from pyspark.sql import Row
from pyspark.sql import types as T

from tessera.llm import bpe
from tessera.llm.q_tokens import VOCABULARY, token_digests

RANKS = bpe.read_ranks(P.path(VOCABULARY))
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_match(seed):
    rng = random.Random(seed)
    codec = bpe.Codec(RANKS, P.PATTERN)
    for alphabet in ("ab c\n\t ", "aé 1.  \x1c\x85 '", "thers  \r\n", "日本語 の😀 x ", "   \n"):
        for n in (0, 1, 2, 7, 40, 300):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids, = codec.encode([text])
            assert ids == packed(ORACLE.encode_ordinary(text)), text
            assert codec.decode(ids) == text.encode()


def test_many_texts_share_one_queue():
    rng = random.Random(1)
    texts = ["".join(rng.choice("therinaéß1 ,\n") for _ in range(rng.randrange(60))) for _ in range(800)] + [None, " ", "a  b", "  a"]
    codec = bpe.Codec(RANKS, P.PATTERN)
    for _ in range(2):  # the second time from what it remembers
        assert codec.encode(texts) == [packed(ORACLE.encode_ordinary(t or "")) for t in texts]
    assert not any(codec.words)


def test_very_long_pretoken_without_blanks():
    codec = bpe.Codec(RANKS, P.PATTERN)
    for text in ("a" * 30_000, "the" * 9_000 + "ing" * 4_000, "#$" * 8_000):
        assert codec.encode([text]) == [packed(ORACLE.encode_ordinary(text))]
    assert not any(codec.words)


def test_query_matches_library(spark):
    got = {r.doc_id: r for r in token_digests(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()}
    rows = duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = ORACLE.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame([Row(doc_id=None, text=None, IDS="x", decoded=1), Row(doc_id=2, text="", IDS="y", decoded=2),
                                Row(doc_id=2, text="héllo  wörld ", IDS=None, decoded=3)],
                               "doc_id long, text string, IDS string, decoded int")
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(bytes(r.decoded).decode() for r in out.collect()) == ["", "", "héllo  wörld "]
    empty = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert token_digests(empty).count() == 0

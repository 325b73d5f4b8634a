"""Registered query of byte-level BPE."""

import public_tokenizers
from pyspark.sql import functions as F

from .bpe import read_ranks, round_trip

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def token_digests(docs, vocabulary: str = VOCABULARY):
    """Encode, decode, and digest both outputs."""
    ranks = read_ranks(public_tokenizers.path(vocabulary))
    return round_trip(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark, sf_dir):
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

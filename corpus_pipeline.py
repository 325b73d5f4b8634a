"""The corpus pipeline: documents through five operators, each stage a Parquet table.

1. language ID drops documents whose language is uncertain; 2. exact dedup keeps one of equal
texts; 3. MinHash near-dedup keeps one document of each group; 4. mixing repeats or leaves out
documents so that the sources' words come near their target shares; 5. byte-level BPE
turns what is left into ids (checked by decoding).

All stages but the last return the columns of ``documents``. A null text has no language, so it goes
in the first stage; an empty table gives empty results; extra columns pass through.
"""

from __future__ import annotations

from tessera.llm.exact_dedup import drop_exact_copies
from tessera.llm.language_id import drop_unidentified
from tessera.llm.minhash import drop_near_copies
from tessera.llm.mixing import mixed_rows
from tessera.llm.q_tokens import token_digests
from tessera.llm.scratch import Scratch


def language_stage(spark, docs, sf_dir):
    return drop_unidentified(docs)


def exact_dedup_stage(spark, docs, sf_dir):
    return drop_exact_copies(docs)


def near_dedup_stage(spark, docs, sf_dir):
    return drop_near_copies(docs)


def mixing_stage(spark, docs, sf_dir):
    return mixed_rows(docs)


def tokens_stage(spark, docs, sf_dir):
    """One row for each row of the mixture: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return token_digests(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("byte-level BPE", tokens_stage),
]

#: No SQL: language ID, near-duplicate groups and BPE are not SQL-expressible. tests/llm/test_pipeline.py
#: holds each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
        scratch.tidy()
    return docs

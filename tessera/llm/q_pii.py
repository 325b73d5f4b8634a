"""Registered query of personal data."""

from pyspark.sql import functions as F

from .pii import KINDS, personal_data


def is_kind(k):
    return lambda s: s["kind"] == k


def span_digests(docs):
    spans = F.col("spans")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"].isin(KINDS))
    return personal_data(docs).select("doc_id", *[
        F.size(F.filter(spans, is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))


def op8_personal_data(spark, sf_dir):
    return span_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

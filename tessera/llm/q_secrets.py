"""Registered query of the secret scan."""

from pyspark.sql import functions as F

from .secret_scan import BASE, secret_scan


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs):
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    def count(kind):  # noqa: E306
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return secret_scan(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op13_secret_scan(spark, sf_dir):
    return secret_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

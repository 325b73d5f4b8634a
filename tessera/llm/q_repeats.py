"""Registered query of the removal of repeated strings."""

from pyspark.sql import functions as F

from .repeats import remove_repeats


def repeat_digests(docs, **options):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                                  F.sha2("kept", 256).alias("kept_sha256"))


def op6_repeat_removal(spark, sf_dir):
    return repeat_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

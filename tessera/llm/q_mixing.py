"""Registered query of source mixing."""

from .mixing import mix


def op10_source_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

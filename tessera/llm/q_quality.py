"""Registered query of the quality rules."""

from .quality_rules import quality_rules


def op7_quality_rules(spark, sf_dir):
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

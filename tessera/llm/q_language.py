"""Registered queries of language identification."""

from .language_id import identify, page_evidence


def op3_language_id(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_language_id_pages(spark, sf_dir):
    """Pages: the language their markup declares, with host and address suffix."""
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return identify(pages, "page_id", "text", "declared", "host", "suffix")

"""Registered query of main text extraction."""

from pyspark.sql import functions as F

from .html_extract import extract, learn


def main_texts(pages, sample: int = 1000):
    model = learn(pages, "page_id", "html", sample)
    return (extract(pages.select("page_id", "url", "html"), model)
            .withColumn("n_chars", F.length("text").cast("long")))


def op9_html_extraction(spark, sf_dir):
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))

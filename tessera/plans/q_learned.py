"""Isolation forest and topics on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, topics
from ..operators.learning import learning_curve
from .registry import query
from .tables import derived, table

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _lines(spark, sf):
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(key.alias("line_id"), *_COLUMNS)


@query("isolation_forest")
def isolation_forest(spark, sf):
    return forest.isolation_forest(_lines(spark, sf), "line_id", _COLUMNS)


@query("isolation_forest_share", sql="""
WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT n AS n_rows, CAST(n - 1 - floor((n - 1) * 0.95) AS BIGINT) AS n_anomalies FROM n""")
def isolation_forest_share(spark, sf):
    """The flagged rows are the contamination share (where no scores tie at the border)."""
    s = forest.isolation_forest(_lines(spark, sf), "line_id", _COLUMNS)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_anomaly").alias("n_anomalies"))


@query("isolation_contributions")
def isolation_contributions(spark, sf):
    return forest.feature_contributions(_lines(spark, sf), "line_id", _COLUMNS, trees=40)


@query("nmf_topics")
def nmf_topics(spark, sf):
    return topics.nmf_topics(table(spark, sf, "documents"), k=5, vocabulary=2000, rounds=6)[0]


@query("nmf_document_topics")
def nmf_document_topics(spark, sf):
    return topics.nmf_topics(table(spark, sf, "documents"), k=5, vocabulary=2000, rounds=6)[1].select("doc_id", "topic")


@query("learning_curve")
def learning_curve_query(spark, sf):
    o = derived(spark, sf, "order_features").select("o_orderkey", "o_totalprice", "c_acctbal", "c_nationkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return learning_curve(o, ["o_totalprice", "c_acctbal", "c_nationkey"], "label", "logistic_regression", "classification", ["o_orderkey"], sizes=4, folds=2)

"""Source / sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as R
from .registry import query
from .tables import register_views, table


@query("src_csv", sql="SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_csv(spark, sf):
    src = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = R.scratch_path(spark, "orders-csv")
    src.write.option("header", True).csv(path)
    return R.read_csv(spark, path).select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"),
                                          "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("src_json", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_json(spark, sf):
    src = table(spark, sf, "customer")
    path = R.scratch_path(spark, "customer-json")
    src.write.json(path)
    return R.read_json(spark, path).select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"),
                                           "c_acctbal", "c_mktsegment")


@query("sample_n", sql="SELECT least(500, count(*)) AS n FROM lineitem")
def sample_n(spark, sf):
    df = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return R.sample_n(df, 500, key).agg(F.count(F.lit(1)).alias("n"))


@query("sample_rows")
def sample_rows(spark, sf):
    return R.sample_n(table(spark, sf, "lineitem"), 500, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])


@query("extract_table", sql="SELECT * FROM customer")
def extract_table(spark, sf):
    register_views(spark, sf, ["customer"])
    return spark.table("customer")


@query("sql_query", sql="""
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM customer GROUP BY c_mktsegment""")
def sql_query(spark, sf):
    register_views(spark, sf, ["customer"])
    return spark.sql("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal) * 10000, 0) / 10000 AS avg_balance "
                     "FROM customer GROUP BY c_mktsegment")


@query("extract_filtered", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-12-31 00:00:00'
  AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def extract_filtered(spark, sf):
    return R.extract(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"],
                     "o_orderdate", "1996-01-01 00:00:00", "1997-12-31 00:00:00",
                     where="o_orderpriority IN ('1-URGENT', '2-HIGH')", excluded=["o_orderstatus"])


@query("date_range", sql="SELECT min(o_orderdate) AS min_date, max(o_orderdate) AS max_date FROM orders")
def date_range(spark, sf):
    return R.date_range(table(spark, sf, "orders"), "o_orderdate")


@query("row_count", sql="SELECT count(*) AS row_count FROM lineitem")
def row_count(spark, sf):
    return R.row_count(table(spark, sf, "lineitem"))


@query("extract_excluding", sql="SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def extract_excluding(spark, sf):
    feedback = spark.createDataFrame([("part", "p_name"), ("part", "p_type"), ("orders", "o_comment")],
                                     "table_name string, column_name string")
    return R.extract(table(spark, sf, "part"), excluded=R.excluded_columns(feedback, "part"))


@query("dataset_roundtrip", sql="SELECT * FROM supplier")
def dataset_roundtrip(spark, sf):
    root = R.scratch_path(spark, "datasets")
    R.save_dataset(table(spark, sf, "supplier"), root, "suppliers", "supplier master", ["dim"])
    return R.load_dataset(spark, root, "suppliers")

"""Global row numbers, running sums and fills on wide frames, with and without shared exchanges; graph and type cases."""

import duckdb
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.functions.ranking import global_prefix_sums, global_row_number
from tessera.operators import clean as C
from tessera.operators import encode as E
from tessera.operators import features as Fe
from tessera.operators import graph as G
from tessera.operators import profile as P

SF = SF_SMALL.replace("0.001", "0.01")


@pytest.fixture(params=["true", "false"])
def reuse(spark, request):
    spark.conf.set("spark.sql.exchange.reuse", request.param)
    yield
    spark.conf.unset("spark.sql.exchange.reuse")


def test_row_numbers_of_a_wide_frame(spark, reuse):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    got = global_row_number(df, order, n_ranges=16)
    assert got.columns == [*df.columns, "rn"]
    want = dict(duckdb.sql(f"SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) FROM '{SF}/orders.parquet'").fetchall())
    assert {r.o_orderkey: r.rn for r in got.collect()} == want
    assert {r.o_orderkey: r.rn for r in got.select("rn", "o_orderkey").collect()} == want


def test_grouped_running_sums_of_a_wide_frame(spark, reuse):
    df = spark.read.parquet(f"{SF}/orders.parquet").withColumn("g", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    got = global_prefix_sums(df, [F.col("o_orderkey")], {"k": F.lit(1), "s": F.col("o_custkey")}, n_ranges=16, partition_by=["g"])
    want = {r[0]: r[1:] for r in duckdb.sql(f"""SELECT o_orderkey, row_number() OVER w, sum(o_custkey) OVER w FROM '{SF}/orders.parquet'
        WINDOW w AS (PARTITION BY nullif(o_orderstatus, 'P') ORDER BY o_orderkey)""").fetchall()}
    assert {r.o_orderkey: (r.k, r.s) for r in got.collect()} == want


@pytest.mark.parametrize("backward", [False, True])
def test_fill_of_a_wide_frame(spark, reuse, backward):
    df = spark.read.parquet(f"{SF}/orders.parquet").withColumn("x", F.when(F.col("o_totalprice") > 400_000, F.col("o_totalprice")))
    got = C.fill_directional(df, ["x"], ["o_orderkey"], backward=backward, n_ranges=16)
    side = "o_orderkey DESC" if backward else "o_orderkey"
    want = dict(duckdb.sql(f"""SELECT o_orderkey, last_value(CASE WHEN o_totalprice > 400000 THEN o_totalprice END IGNORE NULLS) OVER (ORDER BY {side})
        FROM '{SF}/orders.parquet'""").fetchall())
    assert {r.o_orderkey: r.x for r in got.collect()} == want


def test_components_of_a_long_path_and_lone_nodes(spark):
    edges = spark.range(300).selectExpr("id AS src", "id + 1 AS dst", "1 AS weight")
    nodes = spark.range(303).selectExpr("id")
    got = {r.id: r.component for r in G.connected_components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 301: 301, 302: 302}


def test_large_integers_stay_distinct(spark):
    df = spark.createDataFrame([(2**53, 1.5), (2**53 + 1, 1.5), (None, None)], "a long, b double").withColumn("c", F.col("a").cast("decimal(20,2)"))
    assert {r.column_name: r.n_distinct for r in P.distinct_counts(df).collect()} == {"a": 2, "b": 1, "c": 2}


@pytest.mark.parametrize("condition, want", [
    ("> 2", {"3"}), (">=2", {"2", "3"}), ("!= 2", {"1", "3", "a>b", None}), ("== a>b", {"a>b"}), ("contains:A", {"a>b"}), ("startswith:a", {"a>b"}), ("endswith:b", {"a>b"}),
])
def test_conditions(spark, condition, want):
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("a>b",), (None,)], "x string")
    assert {r.x for r in df.where(Fe.condition_mask(df, "x", condition)).collect()} == want


def test_conditions_and_caps_that_raise(spark):
    df = spark.range(60).selectExpr("cast(id as string) as x", "id as n")
    for bad in ("x > 1", "", "like 3"):
        with pytest.raises(ValueError):
            Fe.condition_mask(df, "x", bad)
    with pytest.raises(ValueError):
        E.one_hot(df, ["x"], max_cardinality=10)
    with pytest.raises(ValueError):
        Fe.polynomial(df, ["n"], degree=9)

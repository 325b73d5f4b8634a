"""Loading the driver tables and the derived inputs that several queries share.

Derived inputs are written ONCE as SQL text that both Spark SQL and DuckDB
accept; Spark runs it over temp views of the parquet files and the oracle wraps
the same text in a CTE. Both sides therefore read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# Derived inputs: value-driven gaps and repeats over the WHOLE table (no row is removed).
DERIVED = {
    # nulls driven by values: about 8 %, 4 %, 34 % and 2 % of rows
    "lineitem_gaps": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               CASE WHEN l_quantity > 46 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
               CASE WHEN l_quantity < 3 THEN NULL ELSE l_discount + 0.0 END AS l_discount,
               CASE WHEN l_quantity BETWEEN 10 AND 26 THEN NULL ELSE l_tax END AS l_tax,
               l_returnflag, l_linestatus,
               CASE WHEN l_quantity = 25 THEN NULL ELSE l_shipdate END AS l_shipdate
        FROM lineitem""",
    # a narrow projection with many repeated rows, nulls included
    "lineitem_repeats": """
        SELECT l_returnflag, l_linestatus, l_quantity,
               CASE WHEN l_quantity > 40 THEN NULL ELSE l_linenumber END AS l_linenumber
        FROM lineitem""",
    # orders with a text column holding numbers and one holding dates
    "orders_text": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
               CAST(o_totalprice AS STRING) AS price_text,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text,
               o_totalprice, o_orderdate
        FROM orders""",
    # lineitem amounts with derived revenue / charge (strongly correlated columns)
    "lineitem_metrics": """
        SELECT l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax,
               l_extendedprice * (1 - l_discount) AS revenue,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
               l_extendedprice / l_quantity AS unit_price
        FROM lineitem""",
    # lineitem with intact order keys and gaps in the value columns (for fills)
    "lineitem_fill": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
               CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax END AS tax_g,
               CASE WHEN l_quantity < 12 THEN NULL ELSE l_quantity END AS qty_g,
               CASE WHEN l_quantity BETWEEN 20 AND 24 THEN NULL ELSE l_returnflag END AS flag_g
        FROM lineitem""",
    # orders amounts written as formatted text
    "orders_dirty": """
        SELECT o_orderkey,
               CASE WHEN o_orderstatus = 'F' THEN concat('$', CAST(o_totalprice AS STRING))
                    WHEN o_orderstatus = 'O' THEN concat('(', CAST(o_custkey AS STRING), ')')
                    ELSE concat(CAST(o_custkey AS STRING), '%') END AS amount_text,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'n/a'
                    ELSE concat(' ', CAST(o_custkey AS STRING), ' ') END AS qty_text,
               CASE WHEN o_orderpriority LIKE '2%' THEN 'yes' WHEN o_orderpriority LIKE '3%' THEN 'no'
                    ELSE o_orderstatus END AS flag_text
        FROM orders""",
    # classifier outputs derived from order attributes: binary label, tied scores, 3-class view
    "scored_orders": """
        SELECT o_orderkey,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
               CAST(o_custkey % 50 AS DOUBLE) / 100.0
                 + CASE WHEN o_orderstatus = 'F' THEN 0.3 ELSE 0.0 END
                 + CASE WHEN o_orderpriority LIKE '1%' THEN 0.2 ELSE 0.0 END AS score,
               o_orderstatus AS status,
               CASE WHEN o_totalprice < 100000 THEN 'O' WHEN o_totalprice < 250000 THEN 'F' ELSE 'X' END AS status_pred
        FROM orders""",
    # events split in time: baseline before 2024-01-15, current after
    "events_base": "SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'",
    "events_cur": "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    # part - supplier graph: an edge where a supplier shipped a part at least twice
    "supply_edges": """
        SELECT concat('p', CAST(l_partkey AS STRING)) AS src, concat('s', CAST(l_suppkey AS STRING)) AS dst,
               count(*) AS weight
        FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) >= 2""",
    # numeric orders features joined with the customer segment (a small dimension)
    "order_features": """
        SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, o.o_orderdate, o.o_orderstatus,
               o.o_orderpriority, c.c_acctbal, c.c_mktsegment, c.c_nationkey
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_views(spark, sf_dir)
    return spark.sql(DERIVED[name])


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for the oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names) + "\n"

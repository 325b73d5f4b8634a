"""Cleaning queries."""

from __future__ import annotations

from ..operators import clean as C
from .common import LINEITEM_NUM, rounded
from .q_quality import GAPS
from .registry import query
from .sqlgen import d, q
from .tables import cte, derived, table

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
KEY_SQL = ", ".join(KEY)
FILL = ["tax_g", "qty_g", "flag_g"]
GAPS_NUM = LINEITEM_NUM


def _sel(cols, repl):
    return ", ".join(repl.get(c, c) + (f" AS {c}" if c in repl else "") for c in cols)


@query("clean_drop_any", sql=cte("lineitem_gaps") + "SELECT * FROM lineitem_gaps WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in GAPS))
def clean_drop_any(spark, sf):
    return C.drop_missing(derived(spark, sf, "lineitem_gaps"), how="any")


@query("clean_drop_all", sql=cte("lineitem_gaps") + "SELECT * FROM lineitem_gaps WHERE "
       + " OR ".join(f"{c} IS NOT NULL" for c in ["l_extendedprice", "l_tax", "l_shipdate"]))
def clean_drop_all(spark, sf):
    return C.drop_missing(derived(spark, sf, "lineitem_gaps"), ["l_extendedprice", "l_tax", "l_shipdate"], how="all")


def _impute_sql(agg) -> str:
    repl = {c: f"round(coalesce({d(c)}, (SELECT {agg(c)} FROM lineitem_gaps)), 4)" for c in GAPS_NUM}
    return cte("lineitem_gaps") + f"SELECT {_sel(GAPS, repl)} FROM lineitem_gaps"


@query("impute_mean", sql=_impute_sql(lambda c: f"avg({d(c)})"))
def impute_mean(spark, sf):
    return rounded(C.impute(derived(spark, sf, "lineitem_gaps"), "mean"))


@query("impute_median", sql=_impute_sql(lambda c: q(c, 0.5)))
def impute_median(spark, sf):
    return rounded(C.impute(derived(spark, sf, "lineitem_gaps"), "median"))


def _mode(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM lineitem_gaps WHERE {c} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v LIMIT 1)")


@query("impute_mode", sql=cte("lineitem_gaps") + "SELECT " + ", ".join(
    f"coalesce({c}, {_mode(c)}) AS {c}" for c in GAPS) + " FROM lineitem_gaps")
def impute_mode(spark, sf):
    return C.impute(derived(spark, sf, "lineitem_gaps"), "mode")


@query("impute_zero", sql=cte("lineitem_gaps") + f"""SELECT {_sel(GAPS, {c: f"coalesce({c}, 0)" for c in GAPS_NUM})}
FROM lineitem_gaps""")
def impute_zero(spark, sf):
    return C.impute(derived(spark, sf, "lineitem_gaps"), "zero")


def _fill_sql(backward: bool) -> str:
    order = ", ".join(f"{k} DESC" if backward else k for k in KEY)
    cols = ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING "
                     f"AND CURRENT ROW) AS {c}" for c in FILL)
    return cte("lineitem_fill") + f"SELECT {KEY_SQL}, {cols} FROM lineitem_fill"


@query("impute_ffill", sql=_fill_sql(False))
def impute_ffill(spark, sf):
    return C.impute(derived(spark, sf, "lineitem_fill"), "ffill", FILL, order_by=KEY)


@query("impute_bfill", sql=_fill_sql(True))
def impute_bfill(spark, sf):
    return C.impute(derived(spark, sf, "lineitem_fill"), "bfill", FILL, order_by=KEY)


@query("impute_ffill_by_key", sql=cte("lineitem_fill") + f"""
SELECT {KEY_SQL}, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY {KEY_SQL} "
                             f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in FILL)}
FROM lineitem_fill""")
def impute_ffill_by_key(spark, sf):
    return C.impute(derived(spark, sf, "lineitem_fill"), "ffill", FILL, order_by=KEY, partition_by=["l_suppkey"])


_LI = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
       "l_returnflag, l_linestatus, l_shipdate")


@query("dedup_first", sql=f"""
SELECT {_LI} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(spark, sf):
    return C.drop_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "first",
                             order_by=["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])


@query("dedup_last", sql=f"""
SELECT {_LI} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_last(spark, sf):
    return C.drop_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "last",
                             order_by=["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])


@query("dedup_none", sql=f"""
SELECT {_LI} FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def dedup_none(spark, sf):
    return C.drop_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], False)


@query("dedup_rows", sql=cte("lineitem_repeats") + "SELECT DISTINCT * FROM lineitem_repeats")
def dedup_rows(spark, sf):
    return C.drop_duplicates(derived(spark, sf, "lineitem_repeats"))


_EV = ["event_id", "user_id", "value"]


def _fences(c):
    return (f"(SELECT {q(c, .25)} - 1.5 * ({q(c, .75)} - {q(c, .25)}) FROM events)",
            f"(SELECT {q(c, .75)} + 1.5 * ({q(c, .75)} - {q(c, .25)}) FROM events)")


@query("clip_outliers", sql="SELECT ts, event_type, props, " + ", ".join(
    f"round(least(greatest({d(c)}, {_fences(c)[0]}), {_fences(c)[1]}), 4) AS {c}" for c in _EV) + " FROM events")
def clip_outliers(spark, sf):
    return rounded(C.clip_outliers(table(spark, sf, "events"), _EV))


@query("remove_outliers", sql="SELECT * FROM events WHERE " + " AND ".join(
    f"{d(c)} BETWEEN {_fences(c)[0]} AND {_fences(c)[1]}" for c in _EV))
def remove_outliers(spark, sf):
    return C.remove_outliers(table(spark, sf, "events"), _EV)


@query("drop_columns", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def drop_columns(spark, sf):
    return C.drop_columns(table(spark, sf, "lineitem"), ["l_extendedprice", "l_discount", "l_tax", "l_linestatus",
                                                        "l_shipdate", "no_such_column"])


@query("to_numeric", sql=cte("orders_text") + """
SELECT o_orderkey, TRY_CAST(trim(price_text) AS DOUBLE) AS price_text, TRY_CAST(trim(o_orderstatus) AS DOUBLE) AS o_orderstatus
FROM orders_text""")
def to_numeric(spark, sf):
    df = derived(spark, sf, "orders_text").select("o_orderkey", "price_text", "o_orderstatus")
    return C.to_numeric(df, ["price_text", "o_orderstatus"])


@query("to_datetime", sql=cte("orders_text") + """
SELECT o_orderkey, TRY_CAST(date_text AS TIMESTAMP) AS date_text, TRY_CAST(o_orderpriority AS TIMESTAMP) AS o_orderpriority
FROM orders_text""")
def to_datetime(spark, sf):
    df = derived(spark, sf, "orders_text").select("o_orderkey", "date_text", "o_orderpriority")
    return C.to_datetime(df, ["date_text", "o_orderpriority"])


CHAIN = [
    {"action": "drop_missing", "params": {"columns": ["l_shipdate"]}},
    {"action": "impute", "params": {"strategy": "median", "columns": ["l_extendedprice", "l_tax"]}},
    {"action": "impute", "params": {"strategy": "zero"}},
    {"action": "drop_columns", "params": {"columns": ["l_linestatus"]}},
]


@query("clean_chain", sql=cte("lineitem_gaps") + f"""
, s1 AS (SELECT * FROM lineitem_gaps WHERE l_shipdate IS NOT NULL)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       round(coalesce(l_extendedprice, (SELECT {q('l_extendedprice', .5)} FROM s1)), 4) AS l_extendedprice,
       round(coalesce(l_discount, 0), 4) AS l_discount,
       round(coalesce(l_tax, (SELECT {q('l_tax', .5)} FROM s1)), 4) AS l_tax,
       l_returnflag, l_shipdate
FROM s1""")
def clean_chain(spark, sf):
    return rounded(C.apply_steps(derived(spark, sf, "lineitem_gaps"), CHAIN))


@query("clean_log")
def clean_log(spark, sf):
    return C.step_log(derived(spark, sf, "lineitem_gaps"), CHAIN)

"""Feature-engineering queries."""

from __future__ import annotations

from ..operators import features as Fe
from .common import rounded
from .registry import query
from .sqlgen import corr_sql, d, q, skew_sql, union_all
from .tables import cte, derived, table

LI = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
      "l_returnflag, l_linestatus, l_shipdate")
OR = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _li(spark, sf):
    return table(spark, sf, "lineitem")


@query("date_features", sql=f"""
SELECT {OR}, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month,
       day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_weekday,
       quarter(o_orderdate) AS o_orderdate_quarter,
       CAST(coalesce(isodow(o_orderdate) >= 6, false) AS INTEGER) AS o_orderdate_is_weekend,
       dayofyear(o_orderdate) AS o_orderdate_day_of_year
FROM orders""")
def date_features(spark, sf):
    return Fe.date_features(table(spark, sf, "orders"), ["o_orderdate"])


@query("date_numeric", sql="""
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year,
       CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month, CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day,
       CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek, epoch(o_orderdate) AS o_orderdate_ordinal
FROM orders""")
def date_numeric(spark, sf):
    return Fe.date_numeric(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"),
                           ["o_orderdate"])


@query("interactions", sql=f"""
SELECT {LI}, round({d('l_quantity')} * l_extendedprice, 4) AS l_quantity_x_l_extendedprice,
       round(l_discount * l_tax, 4) AS l_discount_x_l_tax FROM lineitem""")
def interactions(spark, sf):
    return rounded(Fe.interactions(_li(spark, sf), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]))


@query("polynomial", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
       round(pow(l_quantity, 2), 4) AS "l_quantity^2", round(l_quantity * l_discount, 4) AS "l_quantity l_discount",
       round(l_quantity * l_tax, 4) AS "l_quantity l_tax", round(pow(l_discount, 2), 4) AS "l_discount^2",
       round(l_discount * l_tax, 4) AS "l_discount l_tax", round(pow(l_tax, 2), 4) AS "l_tax^2"
FROM lineitem""")
def polynomial(spark, sf):
    df = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(Fe.polynomial(df, ["l_quantity", "l_discount", "l_tax"], 2))


def _qbins_sql(src, c, k):
    e = [f"(SELECT {q(c, i / k)} FROM {src})" for i in range(k + 1)]
    cases = [f"WHEN {d(c)} >= {e[0]} AND {d(c)} <= {e[1]} THEN 0"] + [
        f"WHEN {d(c)} > {e[i - 1]} AND {d(c)} <= {e[i]} THEN {i - 1}" for i in range(2, k + 1)]
    return "CASE " + " ".join(cases) + " END"


@query("bin_quantile", sql=f"SELECT o_orderkey, o_totalprice, {_qbins_sql('orders', 'o_totalprice', 5)} AS o_totalprice_bin FROM orders")
def bin_quantile(spark, sf):
    return Fe.bin_quantile(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5)


@query("bin_uniform", sql="""
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice > lo - (hi - lo) * 0.001 AND o_totalprice <= lo + (hi - lo) / 4 * 1 THEN 'low'
            WHEN o_totalprice > lo + (hi - lo) / 4 * 1 AND o_totalprice <= lo + (hi - lo) / 4 * 2 THEN 'mid'
            WHEN o_totalprice > lo + (hi - lo) / 4 * 2 AND o_totalprice <= lo + (hi - lo) / 4 * 3 THEN 'high'
            WHEN o_totalprice > lo + (hi - lo) / 4 * 3 AND o_totalprice <= hi THEN 'top' END AS o_totalprice_bin
FROM orders, m""")
def bin_uniform(spark, sf):
    return Fe.bin_uniform(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 4,
                          ["low", "mid", "high", "top"])


@query("text_length", sql=r"""
SELECT doc_id, length(coalesce(text, '')) AS text_length,
       length(regexp_extract_all(coalesce(text, ''), '\S+')) AS text_word_count FROM documents""")
def text_length(spark, sf):
    return Fe.text_length(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).drop("text")


@query("log_feature", sql="""
SELECT event_id, value, round(ln(1 + greatest(value, 0)), 4) AS value_log,
       round(ln(1 + greatest(CAST(user_id AS DOUBLE) - 50, 0)), 4) AS centered_log FROM
  (SELECT event_id, value, user_id FROM events)""")
def log_feature(spark, sf):
    from pyspark.sql import functions as F
    df = table(spark, sf, "events").select("event_id", "value", (F.col("user_id") - 50).alias("centered"))
    return rounded(Fe.log_feature(df, ["value", "centered"]).drop("centered"))


@query("sqrt_feature", sql="""
SELECT event_id, value, round(sqrt(greatest(value, 0)), 4) AS value_sqrt FROM events""")
def sqrt_feature(spark, sf):
    return rounded(Fe.sqrt_feature(table(spark, sf, "events").select("event_id", "value"), ["value"]))


@query("ratios", sql=f"""
SELECT {LI}, round(l_extendedprice / NULLIF(l_quantity, 0), 4) AS l_extendedprice_div_l_quantity,
       round(l_discount / NULLIF(l_tax, 0), 4) AS l_discount_div_l_tax FROM lineitem""")
def ratios(spark, sf):
    return rounded(Fe.ratios(_li(spark, sf), [("l_extendedprice", "l_quantity"), ("l_discount", "l_tax")]))


_ARITH_SQL = {
    "add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / NULLIF(b, 0)",
    "power": "pow(a, b)", "modulo": "a - NULLIF(b, 0) * floor(a / NULLIF(b, 0))",
}


def _arith(op):
    expr = _ARITH_SQL[op]

    @query(f"arith_{op}", sql=f"""
SELECT l_orderkey, l_linenumber, a, b, round({expr}, 4) AS a_{op}_b FROM (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) - 25 AS a, CAST(l_linenumber AS DOUBLE) - 3 AS b FROM lineitem)""")
    def run(spark, sf):
        from pyspark.sql import functions as F
        df = _li(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("a"),
                                   (F.col("l_linenumber").cast("double") - 3).alias("b"))
        return rounded(Fe.arithmetic(df, "a", "b", op))
    return run


for _op in _ARITH_SQL:
    _arith(_op)

_RA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RA_LIST = "list_filter([" + ", ".join(d(c) for c in _RA) + "], lambda v: v IS NOT NULL)"
_RA_SQL = {
    "sum": f"coalesce(list_sum({_RA_LIST}), 0.0)",
    "mean": f"list_avg({_RA_LIST})",
    "median": f"list_aggregate({_RA_LIST}, 'quantile_cont', 0.5)",
    "min": f"list_min({_RA_LIST})",
    "max": f"list_max({_RA_LIST})",
    "std": f"list_aggregate({_RA_LIST}, 'stddev_samp')",
}


def _row_agg(how):
    @query(f"row_agg_{how}", sql=cte("lineitem_gaps") + f"""
SELECT l_orderkey, l_linenumber, round({_RA_SQL[how]}, 4) AS row_agg FROM lineitem_gaps""")
    def run(spark, sf):
        df = derived(spark, sf, "lineitem_gaps").select("l_orderkey", "l_linenumber", *_RA)
        return rounded(Fe.row_aggregate(df, _RA, how, "row_agg").drop(*_RA))
    return run


for _h in _RA_SQL:
    _row_agg(_h)


@query("substring", sql="""
SELECT p_partkey, p_name, p_name[3:5] AS p_name_substr_2_5, p_name[-3:] AS p_name_substr_m3_end FROM part""")
def substring(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    df = Fe.substring(df, "p_name", 2, 5, "p_name_substr_2_5")
    return Fe.substring(df, "p_name", -3, None, "p_name_substr_m3_end")


@query("regex_extract", sql="""
SELECT p_partkey, p_name, NULLIF(regexp_extract(p_name, '(r[a-z]+)', 1), '') AS p_name_extracted FROM part""")
def regex_extract(spark, sf):
    return Fe.regex_extract(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "r[a-z]+")


@query("split_column", sql="""
SELECT p_partkey, p_brand, s[1] AS p_brand_part1, s[2] AS p_brand_part2,
       CASE WHEN len(s) >= 3 THEN array_to_string(s[3:], '#') END AS p_brand_part3
FROM (SELECT p_partkey, p_brand, string_split(p_brand, '#') AS s FROM part)""")
def split_column(spark, sf):
    return Fe.split_column(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "#", 2)


@query("concat_columns", sql="""
SELECT p_partkey, p_brand, p_type, p_brand || ' / ' || p_type AS brand_type FROM part""")
def concat_columns(spark, sf):
    return Fe.concat_columns(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"),
                             ["p_brand", "p_type"], " / ", "brand_type")


_COND = {
    "gt": (">=1500", "p_retailprice", "CASE WHEN p_retailprice >= 1500 THEN 'pricey' ELSE 'cheap' END"),
    "contains": ("contains:R[IE]NG", "p_name", "CASE WHEN regexp_matches(p_name, '(?i)R[IE]NG') THEN 'pricey' ELSE 'cheap' END"),
    "startswith": ("startswith:Brand#1", "p_brand", "CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'pricey' ELSE 'cheap' END"),
    "endswith": ("endswith:ring", "p_name", "CASE WHEN ends_with(p_name, 'ring') THEN 'pricey' ELSE 'cheap' END"),
}


def _cond(kind):
    cond, col, sql = _COND[kind]

    @query(f"conditional_{kind}", sql=f"SELECT p_partkey, {col}, {sql} AS flag FROM part")
    def run(spark, sf):
        df = table(spark, sf, "part").select("p_partkey", col)
        return Fe.conditional(df, col, cond, "pricey", "cheap", "flag")
    return run


for _k in _COND:
    _cond(_k)


@query("custom_expr", sql="""
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge FROM lineitem""")
def custom_expr(spark, sf):
    df = _li(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return rounded(Fe.custom_expr(df, "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "charge")
                   .select("l_orderkey", "l_linenumber", "charge"))


FEATURE_STEPS = [
    ("log", {"columns": ["o_totalprice"]}),
    ("arithmetic", {"a": "o_totalprice", "b": "o_custkey", "operation": "divide", "name": "price_per_key"}),
    ("conditional", {"column": "o_orderpriority", "condition": "startswith:1", "if_true": 1, "if_false": 0,
                     "name": "urgent"}),
]


@query("feature_chain", sql="""
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, round(ln(1 + greatest(o_totalprice, 0)), 4) AS o_totalprice_log,
       round(o_totalprice / NULLIF(CAST(o_custkey AS DOUBLE), 0), 4) AS price_per_key,
       CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 0 END AS urgent FROM orders""")
def feature_chain(spark, sf):
    from functools import reduce
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return rounded(reduce(lambda x, s: Fe.FEATURE_ACTIONS[s[0]](x, **s[1]), FEATURE_STEPS, df))


_ENC_COLS = ["c_name", "c_mktsegment"]


@query("encoding_advice", sql=union_all([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, CASE WHEN count(DISTINCT {c}) <= 5 THEN 'one_hot' "
    f"WHEN count(DISTINCT {c}) <= 20 THEN 'ordinal_or_onehot' ELSE 'frequency_encoding' END AS encoding FROM customer"
    for c in _ENC_COLS]))
def encoding_advice(spark, sf):
    return Fe.encoding_advice(table(spark, sf, "customer"), _ENC_COLS)


_TA = ["value", "user_id", "event_id"]


@query("transform_advice", sql=union_all([
    f"SELECT '{c}' AS column_name, round({skew_sql(c)}, 4) AS skewness, CASE WHEN {skew_sql(c)} > 1 AND min({c}) >= 0 "
    f"THEN 'log1p' WHEN {skew_sql(c)} < -1 THEN 'reflect_then_log' WHEN abs({skew_sql(c)}) > 0.5 THEN 'sqrt_or_boxcox' "
    f"ELSE 'standardize' END AS recommendation FROM events" for c in _TA]))
def transform_advice(spark, sf):
    return Fe.transform_advice(table(spark, sf, "events"), _TA)


_IA = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue", "unit_price", "charge"]
_IA_PAIRS = [(a, b) for i, a in enumerate(_IA) for b in _IA[i + 1:]]


@query("interaction_advice", sql=cte("lineitem_metrics") + union_all([
    f"SELECT {k} AS pair_index, '{a}' AS feature_a, '{b}' AS feature_b, round(abs({corr_sql(a, b)}), 4) AS base_correlation, "
    f"coalesce(min(NULLIF({d(b)}, 0)) > 0, false) AS ratio_suggested FROM lineitem_metrics" for k, (a, b) in enumerate(_IA_PAIRS)]))
def interaction_advice(spark, sf):
    return Fe.interaction_advice(derived(spark, sf, "lineitem_metrics").select(*_IA), _IA)


_FR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "unit_price"]


@query("feature_ranking", sql=cte("lineitem_metrics") + "SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS column_name, round(abs({corr_sql(c, 'revenue')}), 4) AS score, round({corr_sql(c, 'revenue')}, 4) AS correlation "
    f"FROM lineitem_metrics" for c in _FR]) + ")")
def feature_ranking(spark, sf):
    return Fe.feature_ranking(derived(spark, sf, "lineitem_metrics").select(*_FR, "revenue"), "revenue", _FR)


@query("datetime_advice", sql=cte("orders_text") + """
SELECT column_name, parse_rate FROM (
  SELECT 'date_text' AS column_name, round(CAST(count(TRY_CAST(date_text AS TIMESTAMP)) AS DOUBLE) / count(date_text), 4) AS parse_rate FROM orders_text
  UNION ALL SELECT 'price_text', round(CAST(count(TRY_CAST(price_text AS TIMESTAMP)) AS DOUBLE) / count(price_text), 4) FROM orders_text
  UNION ALL SELECT 'o_orderstatus', round(CAST(count(TRY_CAST(o_orderstatus AS TIMESTAMP)) AS DOUBLE) / count(o_orderstatus), 4) FROM orders_text
) WHERE parse_rate > 0.8""")
def datetime_advice(spark, sf):
    return Fe.datetime_advice(derived(spark, sf, "orders_text"), ["date_text", "price_text", "o_orderstatus"])

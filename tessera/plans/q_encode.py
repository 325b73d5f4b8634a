"""Scaling and encoding queries."""

from __future__ import annotations

from ..operators import encode as E
from .common import LINEITEM_NUM, rounded
from .q_quality import GAPS
from .registry import query
from .sqlgen import d, q, union_all
from .tables import cte, derived, table

SC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(center, spread) -> str:
    z = {c: f"coalesce({d(c)}, 0.0)" for c in SC}
    sel = []
    for c in GAPS:
        if c in SC:
            sel.append(f"round(({z[c]} - (SELECT {center(z[c])} FROM lineitem_gaps)) / "
                       f"coalesce(NULLIF((SELECT {spread(z[c])} FROM lineitem_gaps), 0), 1.0), 4) AS {c}")
        else:
            sel.append(c)
    return cte("lineitem_gaps") + "SELECT " + ", ".join(sel) + " FROM lineitem_gaps"


@query("scale_standard", sql=_scale_sql(lambda z: f"avg({z})", lambda z: f"stddev_pop({z})"))
def scale_standard(spark, sf):
    return rounded(E.scale(derived(spark, sf, "lineitem_gaps"), SC, "standard"))


@query("scale_minmax", sql=_scale_sql(lambda z: f"min({z})", lambda z: f"max({z}) - min({z})"))
def scale_minmax(spark, sf):
    return rounded(E.scale(derived(spark, sf, "lineitem_gaps"), SC, "minmax"))


@query("scale_robust", sql=_scale_sql(lambda z: f"quantile_cont({z}, 0.5)",
                                      lambda z: f"quantile_cont({z}, 0.75) - quantile_cont({z}, 0.25)"))
def scale_robust(spark, sf):
    return rounded(E.scale(derived(spark, sf, "lineitem_gaps"), SC, "robust"))


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_ST = ["F", "O", "P"]


def _oh_sql(drop_first: bool) -> str:
    cols = []
    for c, vals in [("o_orderstatus", _ST), ("o_orderpriority", _PRI)]:
        for v in (vals[1:] if drop_first else vals):
            cols.append(f"coalesce({c} = '{v}', false) AS \"{c}_{v}\"")
    return "SELECT o_orderkey, o_totalprice, " + ", ".join(cols) + " FROM orders"


@query("one_hot", sql=_oh_sql(False))
def one_hot(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return E.one_hot(df, ["o_orderstatus", "o_orderpriority"])


@query("one_hot_drop_first", sql=_oh_sql(True))
def one_hot_drop_first(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return E.one_hot(df, ["o_orderstatus", "o_orderpriority"], drop_first=True)


@query("one_hot_skip_high_card", sql="SELECT p_partkey, p_name FROM part")
def one_hot_skip_high_card(spark, sf):
    return E.one_hot(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"], on_wide="skip")


@query("label_encode", sql="""
WITH t AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)),
     b AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT p.p_partkey, CAST(t.code AS BIGINT) AS p_type, CAST(b.code AS BIGINT) AS p_brand, p.p_retailprice
FROM part p JOIN t ON p.p_type = t.p_type JOIN b ON p.p_brand = b.p_brand""")
def label_encode(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    return E.label_encode(df, ["p_type", "p_brand"])


@query("ordinal_encode", sql="""
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
       WHEN '2-HIGH' THEN 3 END AS BIGINT) AS o_orderpriority FROM orders""")
def ordinal_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.ordinal_encode(df, ["o_orderpriority"], {"o_orderpriority": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]})


@query("target_encode", sql="""
SELECT p.p_partkey, p.p_brand, p.p_retailprice, round(m.m, 4) AS p_brand_target_enc
FROM part p JOIN (SELECT p_brand, avg(p_retailprice) AS m FROM part GROUP BY p_brand) m ON p.p_brand = m.p_brand""")
def target_encode(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(E.target_encode(df, ["p_brand"], "p_retailprice"))


@query("target_encode_loo", sql="""
SELECT p.p_partkey, p.p_brand, p.p_retailprice, round((m.s - p.p_retailprice) / NULLIF(m.n - 1, 0), 4) AS p_brand_target_enc
FROM part p JOIN (SELECT p_brand, sum(p_retailprice) AS s, count(*) AS n FROM part GROUP BY p_brand) m ON p.p_brand = m.p_brand""")
def target_encode_loo(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(E.target_encode(df, ["p_brand"], "p_retailprice", leave_one_out=True))


@query("frequency_encode", sql="""
SELECT o_orderkey, o_orderpriority, round(CAST(count(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE) / count(*) OVER (), 4)
       AS o_orderpriority_freq FROM orders""")
def frequency_encode(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return rounded(E.frequency_encode(df, ["o_orderpriority"]))


def _clean_sql(c):
    s = f"regexp_replace(regexp_replace(trim({c}), '[$€£¥₹₽¢₩₪₦₨฿₴₸₵₡₢₣₤₧₮₰₲₳₶₷₺₻₼₾₿,% ]', '', 'g'), '^\\((.*)\\)$', '-\\1')"
    return f"TRY_CAST({s} AS DOUBLE)"


@query("clean_numeric", sql=cte("orders_dirty") + f"""
SELECT o_orderkey, {_clean_sql('amount_text')} AS amount_text, {_clean_sql('qty_text')} AS qty_text, flag_text
FROM orders_dirty""")
def clean_numeric(spark, sf):
    return E.clean_numeric(derived(spark, sf, "orders_dirty"), ["amount_text", "qty_text"])


@query("convert_dtype", sql=cte("orders_dirty") + f"""
SELECT o_orderkey, CASE WHEN {_clean_sql('amount_text')} = floor({_clean_sql('amount_text')})
       THEN CAST({_clean_sql('amount_text')} AS BIGINT) END AS amount_text,
       CASE WHEN {_clean_sql('qty_text')} = floor({_clean_sql('qty_text')}) THEN CAST({_clean_sql('qty_text')} AS BIGINT) END AS qty_text,
       flag_text FROM orders_dirty""")
def convert_dtype(spark, sf):
    return E.convert_dtype(derived(spark, sf, "orders_dirty"), ["amount_text", "qty_text"], "int")


@query("convert_loss", sql=cte("orders_dirty") + f"""
SELECT 'flag_text' AS column_name, count(flag_text) AS before,
       count(CASE WHEN lower(trim(flag_text)) IN ('true', 'yes', 'y', '1', 't') THEN true
                  WHEN lower(trim(flag_text)) IN ('false', 'no', 'n', '0', 'f') THEN false END) AS after,
       count(flag_text) - count(CASE WHEN lower(trim(flag_text)) IN ('true', 'yes', 'y', '1', 't') THEN true
                  WHEN lower(trim(flag_text)) IN ('false', 'no', 'n', '0', 'f') THEN false END) AS lost
FROM orders_dirty""")
def convert_loss(spark, sf):
    return E.convert_loss(derived(spark, sf, "orders_dirty"), ["flag_text"], "bool")


def _yj_sql(x, lam):
    return (f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, {lam}) - 1) / {lam} "
            f"ELSE -(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam} END")


@query("yeo_johnson_fixed_lambda", sql=f"""
WITH t AS (SELECT event_id, {_yj_sql('coalesce(value, 0.0)', 0.5)} AS v FROM events)
SELECT event_id, round((v - (SELECT avg(v) FROM t)) / (SELECT stddev_pop(v) FROM t), 4) AS value FROM t""")
def yeo_johnson_fixed_lambda(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(E.yeo_johnson(df, ["value"], {"value": 0.5}))


@query("yeo_johnson")
def yeo_johnson(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "user_id")
    return rounded(E.yeo_johnson(df, ["value", "user_id"]))


@query("transform_chain", sql=f"""
SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) /
       ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 4) AS o_totalprice,
       coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F, coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O,
       coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P FROM orders""")
def transform_chain(spark, sf):
    from functools import reduce
    steps = [("scale", {"columns": ["o_totalprice"], "method": "minmax"}),
             ("one_hot", {"columns": ["o_orderstatus"]})]
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return rounded(reduce(lambda x, s: E.TRANSFORM_ACTIONS[s[0]](x, **s[1]), steps, df))

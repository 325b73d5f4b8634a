"""Domain checks, automatic fixes, clustering coefficients, one-vs-rest AUC, cluster index and stationarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as K
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import timeseries as T
from .q_graph import _CAT
from .q_timeseries import DAILY_SQL, _daily
from .registry import query
from .sqlgen import union_all
from .tables import cte, derived, register_views, table

AS_OF = "1997-06-01 00:00:00"
_CHECKS = """SELECT o_orderstatus, o_totalprice - 20000 AS total_price, o_custkey % 7 AS quantity, o_orderdate,
       CASE WHEN o_custkey % 3 <> 0 THEN o_orderpriority END AS priority, 'x' AS fixed, CAST(NULL AS INT) AS nothing FROM orders"""


def _col(c, check, severity, when, count):
    return (f"SELECT '{check}' AS \"check\", '{severity}' AS severity, '{c}' AS column_name, CAST({count} AS BIGINT) AS count, "
            f"round({count} * 100.0 / count(*), 2) AS pct FROM t HAVING {when}")


_NAMES = ["o_orderstatus", "total_price", "quantity", "o_orderdate", "priority", "fixed", "nothing"]


@query("domain_checks", sql=f"WITH t AS ({_CHECKS})\n" + union_all(
    [_col(c, "high_missing", "warning", f"count(*) - count({c}) > 0.3 * count(*)", f"(count(*) - count({c}))") for c in _NAMES]
    + [_col(c, "negative_values", "error", f"count(*) FILTER ({c} < 0) > 0", f"(count(*) FILTER ({c} < 0))") for c in ("total_price", "quantity")]
    + [_col("o_orderdate", "future_dates", "warning", f"count(*) FILTER (o_orderdate > TIMESTAMP '{AS_OF}') > 0",
            f"(count(*) FILTER (o_orderdate > TIMESTAMP '{AS_OF}'))")]
    + [_col(c, "constant_column", "info", f"(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})))", "count(*)") for c in _NAMES]
    + ["SELECT 'duplicate_rows', 'warning', NULL, CAST(d AS BIGINT), round(d * 100.0 / n, 2) FROM (SELECT (SELECT count(*) FROM t) AS n, "
       "(SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d) WHERE d > 0",
       "SELECT 'class_imbalance', 'warning', 'o_orderstatus', min(n), round(min(n) * 100.0 / sum(n), 2) FROM "
       "(SELECT count(*) AS n FROM t WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus) HAVING count(*) <= 20 AND min(n) * 100.0 / sum(n) < 5"]))
def domain_checks(spark, sf):
    register_views(spark, sf)
    return K.domain_checks(spark.sql(_CHECKS), AS_OF, "o_orderstatus")


@query("auto_fix", sql="""
WITH c AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, CAST(c.code AS BIGINT) AS o_orderpriority, epoch(CAST(o_orderdate AS TIMESTAMP)) AS o_orderdate_ordinal
FROM orders JOIN c USING (o_orderpriority)""")
def auto_fix(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", F.array("o_orderkey").alias("odd"))
    return K.auto_fix(df, "non_numeric_columns", ["o_orderpriority", "o_orderdate", "odd", "not there"])


_EDGES = ("e AS (SELECT * FROM (" + union_all([
    f"SELECT '{a}=' || {a} AS src, '{b}=' || {b} AS dst, CAST(count(*) AS DOUBLE) AS weight FROM order_features "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for i, a in enumerate(_CAT) for b in _CAT[i + 1:]]) + ") WHERE weight >= 2)")


@query("graph_clustering", sql=cte("order_features").rstrip() + f""", {_EDGES},
n AS (SELECT src AS a, dst AS b, weight / (SELECT max(weight) FROM e) AS w FROM e UNION ALL SELECT dst, src, weight / (SELECT max(weight) FROM e) FROM e),
d AS (SELECT a AS id, count(*) AS d FROM n GROUP BY a),
t AS (SELECT x.a AS id, sum(pow(x.w * y.w * z.w, 1.0 / 3)) AS t FROM n x JOIN n y ON x.a = y.a AND x.b < y.b JOIN n z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT id, round(CASE WHEN d > 1 THEN coalesce(t, 0) * 2 / (d * (d - 1)) ELSE 0 END, 4) AS clustering FROM d LEFT JOIN t USING (id)""")
def graph_clustering(spark, sf):
    return G.clustering(G.entity_edges(derived(spark, sf, "order_features"), _CAT, 2))


_OVR = {"F": "sf", "O": "so", "P": "sp"}
_OVR_T = "SELECT status, score AS sf, 1 - score AS so, CAST(o_orderkey % 17 AS DOUBLE) AS sp FROM scored_orders"


def _ovr_sql(c, s):
    return (f"SELECT '{c}' AS class, round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / "
            f"(count(*) FILTER (p) * count(*) FILTER (NOT p)), 4) AS roc_auc, count(*) FILTER (p) AS support FROM (SELECT status = '{c}' AS p, "
            f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS r FROM o)")


@query("roc_auc_ovr", sql=cte("scored_orders").rstrip() + f", o AS ({_OVR_T}), a AS (" + union_all([_ovr_sql(c, s) for c, s in _OVR.items()]) + """)
SELECT * FROM a UNION ALL SELECT '__weighted__', round(sum(roc_auc * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM a""")
def roc_auc_ovr(spark, sf):
    df = derived(spark, sf, "scored_orders").selectExpr("status", "score AS sf", "1 - score AS so", "CAST(o_orderkey % 17 AS DOUBLE) AS sp")
    return E.roc_auc_ovr(df, "status", _OVR)


@query("davies_bouldin", sql=cte("order_features").rstrip() + """,
c AS (SELECT c_mktsegment AS k, avg(o_totalprice) AS x, avg(c_acctbal) AS y FROM order_features GROUP BY 1),
s AS (SELECT k, any_value(x) AS x, any_value(y) AS y, avg(sqrt((o_totalprice - x) ^ 2 + (c_acctbal - y) ^ 2)) AS s
      FROM order_features JOIN c ON c_mktsegment = k GROUP BY k),
w AS (SELECT a.k, max((a.s + b.s) / sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)) AS w FROM s a JOIN s b ON a.k <> b.k GROUP BY a.k)
SELECT count(*) AS n_clusters, round(avg(w), 4) AS davies_bouldin FROM w""")
def davies_bouldin(spark, sf):
    return E.davies_bouldin(derived(spark, sf, "order_features"), ["o_totalprice", "c_acctbal"], "c_mktsegment")


@query("kpss", sql="WITH " + DAILY_SQL + """,
r AS (SELECT value - avg(value) OVER () AS e, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM s WHERE value IS NOT NULL),
c AS (SELECT *, sum(e) OVER (ORDER BY i) AS c FROM r),
a AS (SELECT sum(c * c) / pow(any_value(n), 2) AS eta, sum(e * e) AS v, any_value(n) AS n FROM c),
p AS (SELECT y.i - x.i AS k, sum(x.e * y.e) AS p FROM r x JOIN r y ON y.i > x.i AND y.i <= x.i + 60 GROUP BY 1),
h AS (SELECT v / n + coalesce((SELECT sum(p / (n / 2.0)) FROM p WHERE k <= floor(pow(n, 2.0 / 9))), 0) AS s0,
             coalesce((SELECT sum(k * p / (n / 2.0)) FROM p WHERE k <= floor(pow(n, 2.0 / 9))), 0) AS s1 FROM a),
l AS (SELECT CAST(least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS BIGINT) AS lags FROM h, a),
f AS (SELECT eta / ((v + 2 * coalesce((SELECT sum((1 - k / (lags + 1.0)) * p) FROM p WHERE k <= lags), 0)) / n) AS stat, lags, n FROM a, l)
SELECT round(stat, 4) AS statistic, lags AS lags_used, n AS n_obs, stat < 0.463 AS is_stationary FROM f""")
def kpss(spark, sf):
    return T.kpss(_daily(spark, sf))


@query("stationarity_verdict", sql="""
SELECT a, k, CASE WHEN a AND k THEN 'stationary' WHEN NOT a AND NOT k THEN 'non_stationary' WHEN a AND NOT k THEN 'trend_stationary'
       WHEN NOT a AND k THEN 'difference_stationary' ELSE 'inconclusive' END AS verdict
FROM (SELECT CASE WHEN l_quantity > 40 THEN NULL ELSE l_discount > 0.05 END AS a, CASE WHEN l_quantity < 5 THEN NULL ELSE l_tax > 0.04 END AS k FROM lineitem)""")
def stationarity_verdict(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 40, F.col("l_discount") > 0.05).alias("a"),
                                             F.when(F.col("l_quantity") >= 5, F.col("l_tax") > 0.04).alias("k"))
    return df.withColumn("verdict", T.stationarity_verdict(F.col("a"), F.col("k")))


_ERRORS = """SELECT c_mktsegment AS series, model, mae FROM (
  SELECT c_mktsegment, 'mean' AS model, avg(abs(o_totalprice - m)) AS mae FROM (SELECT c_mktsegment, o_totalprice, avg(o_totalprice) OVER (PARTITION BY c_mktsegment) AS m FROM order_features) GROUP BY 1
  UNION ALL SELECT c_mktsegment, 'zero', avg(abs(o_totalprice)) FROM order_features GROUP BY 1
  UNION ALL SELECT c_mktsegment, 'balance', avg(abs(o_totalprice - c_acctbal)) FROM order_features GROUP BY 1)"""


@query("best_model", sql=cte("order_features").rstrip() + f", x AS ({_ERRORS})\n"
       "SELECT series, arg_min(model, mae) AS model, round(min(mae), 4) AS mae FROM x GROUP BY series")
def best_model(spark, sf):
    derived(spark, sf, "order_features").createOrReplaceTempView("order_features")
    out = T.best_model(spark.sql(_ERRORS), key="series")
    return out.select("series", "model", (F.round(F.col("mae") * 1e4, 0) / 1e4).alias("mae"))

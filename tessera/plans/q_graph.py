"""Graph queries: association measures on orders x customer, entity graph,
and the part-supplier graph for structure algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import profile as P
from .q_quality import _profile_sql, _ORD
from .registry import query
from .sqlgen import corr_sql, union_all
from .tables import cte, derived, table

EDGES = cte("supply_edges")
BOTH = "e2 AS (SELECT src, dst, weight FROM supply_edges UNION ALL SELECT dst, src, weight FROM supply_edges)"
NODES = "nd AS (SELECT DISTINCT src AS id FROM e2)"


def _graph(spark, sf):
    e = derived(spark, sf, "supply_edges")
    n = G.both_directions(e).select(F.col("src").alias("id")).distinct()
    return n, e


@query("graph_schema_nodes", sql=_profile_sql())
def graph_schema_nodes(spark, sf):
    return P.profile_columns(table(spark, sf, "orders").select(*_ORD))


_GC = ["o_totalprice", "c_acctbal", "o_custkey", "c_nationkey"]


@query("graph_corr_edges", sql=cte("order_features") + "SELECT * FROM (" + union_all(
    [f"SELECT '{a}' AS src, '{b}' AS dst, round({corr_sql(a, b)}, 4) AS weight FROM order_features"
     for i, a in enumerate(_GC) for b in _GC[i + 1:]]) + ") WHERE abs(weight) >= 0.3")
def graph_corr_edges(spark, sf):
    return G.corr_edges(derived(spark, sf, "order_features").select(*_GC), 0.3)


_CAT = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _cramers_sql(a, b):
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(chi2, 4) AS chi2,
  round(CASE WHEN n >= 10 AND least(ka, kb) - 1 > 0 THEN sqrt(greatest(chi2, 0) / (n * (least(ka, kb) - 1))) END, 4) AS cramers_v
FROM (SELECT n * (q - 1) AS chi2, n, ka, kb FROM (
  SELECT sum(CAST(o AS DOUBLE) * o / (r * c)) AS q, sum(o) AS n,
         (SELECT count(DISTINCT {a}) FROM order_features WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS ka,
         (SELECT count(DISTINCT {b}) FROM order_features WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS kb
  FROM (SELECT {a}, {b}, count(*) AS o FROM order_features WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) cell
  JOIN (SELECT {a}, count(*) AS r FROM order_features WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) ra USING ({a})
  JOIN (SELECT {b}, count(*) AS c FROM order_features WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) cb USING ({b})))"""


@query("cramers_v", sql=cte("order_features") + union_all([_cramers_sql(a, b) for i, a in enumerate(_CAT) for b in _CAT[i + 1:]]))
def cramers_v(spark, sf):
    df = derived(spark, sf, "order_features")
    from functools import reduce
    return reduce(lambda x, y: x.unionByName(y), [G.cramers_v(df, a, b) for i, a in enumerate(_CAT) for b in _CAT[i + 1:]])


_ETA = [("o_orderpriority", "o_totalprice"), ("c_mktsegment", "c_acctbal"), ("o_orderstatus", "o_totalprice")]


def _eta_sql(c, y):
    return f"""SELECT '{c}' AS categorical, '{y}' AS numeric,
  round(CASE WHEN (SELECT count(*) FROM order_features WHERE {c} IS NOT NULL AND {y} IS NOT NULL) >= 10 AND count(*) >= 2
        THEN least(sum(n * (m - (SELECT avg({y}) FROM order_features WHERE {c} IS NOT NULL AND {y} IS NOT NULL)) ^ 2) /
                   (SELECT var_pop({y}) * count(*) FROM order_features WHERE {c} IS NOT NULL AND {y} IS NOT NULL), 1.0) END, 4) AS eta_squared
FROM (SELECT {c}, count(*) AS n, avg({y}) AS m FROM order_features WHERE {c} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1)"""


@query("eta_squared", sql=cte("order_features") + union_all([_eta_sql(c, y) for c, y in _ETA]))
def eta_squared(spark, sf):
    df = derived(spark, sf, "order_features")
    from functools import reduce
    return reduce(lambda x, y: x.unionByName(y), [G.eta_squared(df, c, y) for c, y in _ETA])


@query("entity_nodes", sql=cte("order_features") + union_all([
    f"SELECT '{c}=' || {c} AS id, '{c}' AS column_name, {c} AS value, count(*) AS frequency FROM order_features "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _CAT]))
def entity_nodes(spark, sf):
    df = derived(spark, sf, "order_features")
    return G.entity_nodes(df, _CAT)


@query("entity_edges", sql=cte("order_features") + "SELECT * FROM (" + union_all([
    f"SELECT '{a}=' || {a} AS src, '{b}=' || {b} AS dst, count(*) AS weight FROM order_features "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for i, a in enumerate(_CAT) for b in _CAT[i + 1:]])
    + ") WHERE weight >= 2")
def entity_edges(spark, sf):
    df = derived(spark, sf, "order_features")
    return G.entity_edges(df, _CAT, 2)


@query("graph_degree", sql=EDGES + f""", {BOTH}, {NODES}
SELECT id, count(*) AS degree, round(CAST(sum(weight) AS DOUBLE), 4) AS weighted_degree,
       round(count(*) / ((SELECT count(*) FROM nd) - 1.0), 4) AS degree_centrality
FROM e2 JOIN nd ON e2.src = nd.id GROUP BY id""")
def graph_degree(spark, sf):
    n, e = _graph(spark, sf)
    return G.degrees(n, e)


@query("graph_density", sql=EDGES + f""", {BOTH}, {NODES}
SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM supply_edges) AS n_edges,
       round(2.0 * (SELECT count(*) FROM supply_edges) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 6) AS density,
       round(2.0 * (SELECT count(*) FROM supply_edges) / (SELECT count(*) FROM nd), 4) AS avg_degree""")
def graph_density(spark, sf):
    n, e = _graph(spark, sf)
    return G.density(n, e)


COMP_SQL = EDGES + f""", {BOTH}, {NODES},
reach(id, root) AS (SELECT id, id FROM nd UNION SELECT e2.dst, reach.root FROM reach JOIN e2 ON reach.id = e2.src),
comp AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


@query("components", sql=COMP_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + "\nSELECT id, component FROM comp")
def components(spark, sf):
    n, e = _graph(spark, sf)
    return G.connected_components(n, e)


@query("modularity", sql=COMP_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
m AS (SELECT sum(weight) AS m FROM supply_edges),
intra AS (SELECT a.component AS c, sum(e.weight) AS L FROM supply_edges e JOIN comp a ON e.src = a.id JOIN comp b ON e.dst = b.id
          WHERE a.component = b.component GROUP BY 1),
dc AS (SELECT component AS c, sum(weight) AS D FROM e2 JOIN comp ON e2.src = comp.id GROUP BY 1)
SELECT round(sum(coalesce(L, 0) / (SELECT m FROM m) - (D / (2.0 * (SELECT m FROM m))) ^ 2), 4) AS modularity,
       count(*) AS n_communities FROM dc LEFT JOIN intra USING (c)""")
def modularity(spark, sf):
    n, e = _graph(spark, sf)
    return G.modularity(e, G.connected_components(n, e))


@query("pagerank", sql=EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {BOTH}, {NODES},
ow AS (SELECT src, sum(weight) AS ow FROM e2 GROUP BY src),
t AS (SELECT e2.src, e2.dst, CAST(e2.weight AS DOUBLE) / ow.ow AS p FROM e2 JOIN ow USING (src)),
pr(it, id, rank) AS (
  SELECT 0, id, 1.0 / (SELECT count(*) FROM nd) FROM nd
  UNION ALL
  SELECT it + 1, t.dst, (1 - 0.85) / (SELECT count(*) FROM nd) + 0.85 * sum(t.p * pr.rank)
  FROM pr JOIN t ON pr.id = t.src WHERE it < 20 GROUP BY it, t.dst)
SELECT id, round(rank, 8) AS rank FROM pr WHERE it = 20""")
def pagerank(spark, sf):
    n, e = _graph(spark, sf)
    r = G.pagerank(n, e, 0.85, rounds=20)
    return r.select("id", (F.round(F.col("rank") * 1e8, 0) / 1e8).alias("rank"))


_SEEDS = "('s1', 's2')"


def _hops_sql(k):
    return EDGES + f""", {BOTH},
h0 AS (SELECT DISTINCT src AS id, 0 AS hop FROM e2 WHERE src IN {_SEEDS}),
h1 AS (SELECT DISTINCT dst AS id, 1 AS hop FROM e2 WHERE src IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT dst AS id, 2 AS hop FROM e2 WHERE src IN (SELECT id FROM h1)
       AND dst NOT IN (SELECT id FROM h0) AND dst NOT IN (SELECT id FROM h1))
SELECT * FROM h0 UNION ALL SELECT * FROM h1""" + (" UNION ALL SELECT * FROM h2" if k >= 2 else "")


def _hops(spark, sf, k):
    n, e = _graph(spark, sf)
    seeds = n.where(F.col("id").isin("s1", "s2"))
    return G.neighbors(n, e, seeds, k)[0]


@query("neighbors_1hop", sql=_hops_sql(1))
def neighbors_1hop(spark, sf):
    return _hops(spark, sf, 1)


@query("neighbors_2hop", sql=_hops_sql(2))
def neighbors_2hop(spark, sf):
    return _hops(spark, sf, 2)


@query("neighbors_2hop_edges", sql=EDGES + f""", {BOTH},
h0 AS (SELECT DISTINCT src AS id FROM e2 WHERE src IN {_SEEDS}),
h1 AS (SELECT DISTINCT dst AS id FROM e2 WHERE src IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT dst AS id FROM e2 WHERE src IN (SELECT id FROM h1)),
ids AS (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2)
SELECT src, dst, weight FROM supply_edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)""")
def neighbors_2hop_edges(spark, sf):
    n, e = _graph(spark, sf)
    seeds = n.where(F.col("id").isin("s1", "s2"))
    return G.neighbors(n, e, seeds, 2)[1].select("src", "dst", "weight")


_KEYS = ["c_nationkey", "o_orderstatus"]
_NUMERIC_NODES = cte("order_features") + """, nodes AS (
SELECT 'c_nationkey=' || CAST(c_nationkey AS VARCHAR) AS id, count(*) AS frequency FROM order_features GROUP BY c_nationkey
UNION ALL SELECT 'o_orderstatus=' || o_orderstatus, count(*) FROM order_features GROUP BY o_orderstatus),
edges AS (SELECT 'c_nationkey=' || CAST(c_nationkey AS VARCHAR) AS src, 'o_orderstatus=' || o_orderstatus AS dst, count(*) AS weight
          FROM order_features GROUP BY c_nationkey, o_orderstatus HAVING count(*) >= 2)
"""


@query("entity_degree_numeric", sql=_NUMERIC_NODES + """
SELECT id, frequency, (SELECT count(*) FROM edges WHERE src = id OR dst = id) AS degree,
       coalesce((SELECT sum(weight) FROM edges WHERE src = id OR dst = id), 0)::DOUBLE AS weighted_degree FROM nodes""")
def entity_degree_numeric(spark, sf):
    """Nodes of an integer key meet their edges: ids are written alike in both tables."""
    df = derived(spark, sf, "order_features")
    n, e = G.entity_nodes(df, _KEYS), G.entity_edges(df, _KEYS, 2)
    return n.select("id", "frequency").join(G.degrees(n, e).select("id", "degree", "weighted_degree"), "id")


@query("communities")
def communities(spark, sf):
    n, e = _graph(spark, sf)
    return G.communities(n, e)


@query("communities_modularity")
def communities_modularity(spark, sf):
    """Modularity of the communities beside that of the connected components."""
    n, e = _graph(spark, sf)
    n, e = n.persist(), e.persist()
    try:
        found = G.modularity(e, G.communities(n, e), "community").withColumn("partition", F.lit("communities"))
        whole = G.modularity(e, G.connected_components(n, e)).withColumn("partition", F.lit("components"))
        return spark.createDataFrame(found.unionByName(whole).toArrow())  # two rows
    finally:
        n.unpersist()
        e.unpersist()

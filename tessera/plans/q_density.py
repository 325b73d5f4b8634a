"""Density clustering of parts by price and size."""

from __future__ import annotations

from ..operators.density import dbscan
from .registry import query
from .tables import table

_EPS, _LEAST = 0.2, 5
_PAIRS = f"""
s AS (SELECT p_partkey, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS x,
             (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS y FROM part),
near AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM s a JOIN s b
         ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_EPS} * {_EPS}),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {_LEAST})"""


def _clusters(spark, sf):
    return dbscan(table(spark, sf, "part"), "p_partkey", ["p_retailprice", "p_size"], _EPS, _LEAST)


@query("dbscan_flags", sql="WITH " + _PAIRS + """
SELECT p_partkey, p_partkey IN (SELECT a FROM core) AS is_core,
       p_partkey NOT IN (SELECT near.a FROM near JOIN core ON near.b = core.a) AS is_noise FROM part""")
def dbscan_flags(spark, sf):
    return _clusters(spark, sf).select("p_partkey", "is_core", "is_noise")


@query("dbscan_clusters", sql="WITH RECURSIVE " + _PAIRS + """,
links AS (SELECT near.a, near.b FROM near JOIN core x ON near.a = x.a JOIN core y ON near.b = y.a),
reach(id, root) AS (SELECT a, a FROM core UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id AND links.b > reach.root),
label AS (SELECT id, min(root) AS cluster FROM reach GROUP BY id),
lowest AS (SELECT l.id, min(least(l.cluster, m.cluster)) AS cluster FROM label l JOIN links ON links.a = l.id JOIN label m ON m.id = links.b GROUP BY l.id)
SELECT near.a AS p_partkey, min(lowest.cluster) AS cluster FROM near JOIN lowest ON near.b = lowest.id
WHERE near.a NOT IN (SELECT a FROM core) OR near.a = near.b GROUP BY near.a""")
def dbscan_clusters(spark, sf):
    return _clusters(spark, sf).where("NOT is_noise").select("p_partkey", "cluster")

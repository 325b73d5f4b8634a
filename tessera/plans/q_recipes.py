"""Domain recipe queries on customer / orders / lineitem / events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recipes as B
from ..operators import timeseries as T
from .registry import query
from .tables import table

REF = "2001-09-01"
_RFM_SQL = f"""r AS (SELECT o_custkey, datediff('day', CAST(max(o_orderdate) AS DATE), DATE '{REF}') AS recency_days,
                     count(*) AS frequency, round(sum(o_totalprice), 4) AS monetary FROM orders GROUP BY o_custkey)"""


def _rfm(spark, sf):
    return B.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice", REF)


@query("rfm", sql=f"WITH {_RFM_SQL} SELECT * FROM r")
def rfm(spark, sf):
    return _rfm(spark, sf)


@query("price_elasticity", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount,
       round(l_extendedprice / NULLIF(l_quantity, 0), 4) AS unit_price,
       round(l_extendedprice / NULLIF(l_quantity, 0) * l_discount, 4) AS price_x_discount,
       round(ln(1 + greatest(l_extendedprice / NULLIF(l_quantity, 0), 0)), 4) AS log_price FROM lineitem""")
def price_elasticity(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    return B.price_features(df, "l_extendedprice", "l_quantity", "l_discount")


def _seg_sql():
    e = [f"(SELECT quantile_cont(monetary, {i / 4}) FROM r)" for i in range(5)]
    labels = ["Low", "Medium", "High", "Premium"]
    cases = [f"WHEN monetary >= {e[0]} AND monetary <= {e[1]} THEN 'Low'"] + [
        f"WHEN monetary > {e[i - 1]} AND monetary <= {e[i]} THEN '{labels[i - 1]}'" for i in range(2, 5)]
    return f"WITH {_RFM_SQL} SELECT o_custkey, recency_days, frequency, monetary, CASE {' '.join(cases)} END AS segment FROM r"


@query("spend_segment", sql=_seg_sql())
def spend_segment(spark, sf):
    return B.spend_segment(_rfm(spark, sf), "monetary")


@query("domain_ratios", sql=f"""WITH {_RFM_SQL}
SELECT c.c_custkey, c.c_acctbal, r.frequency, r.monetary,
       round(c.c_acctbal / NULLIF(r.monetary, 0), 4) AS balance_to_spend,
       round(r.monetary / NULLIF(CAST(r.frequency AS DOUBLE), 0), 4) AS avg_order_value,
       c.c_acctbal > 5000 AS high_balance
FROM customer c JOIN r ON c.c_custkey = r.o_custkey""")
def domain_ratios(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    j = c.join(_rfm(spark, sf), c["c_custkey"] == F.col("o_custkey")).select("c_custkey", "c_acctbal", "frequency", "monetary")
    return B.domain_ratios(j, {"balance_to_spend": ("c_acctbal", "monetary"), "avg_order_value": ("monetary", "frequency")},
                           {"high_balance": "c_acctbal > 5000"})


@query("composite_score", sql=f"""WITH {_RFM_SQL},
m AS (SELECT min(recency_days) AS r0, max(recency_days) - min(recency_days) AS r1, min(frequency) AS f0,
             max(frequency) - min(frequency) AS f1, min(monetary) AS m0, max(monetary) - min(monetary) AS m1 FROM r)
SELECT o_custkey, recency_days, frequency, monetary,
       round(((recency_days - r0) / NULLIF(r1, 0) + (frequency - f0) / NULLIF(f1, 0) + (monetary - m0) / NULLIF(m1, 0)) / 3.0, 4) AS composite
FROM r, m""")
def composite_score(spark, sf):
    return B.composite_score(_rfm(spark, sf), ["recency_days", "frequency", "monetary"])


@query("recency_decay", sql=f"""
SELECT o_orderkey, o_orderdate, datediff('day', CAST(o_orderdate AS DATE), DATE '{REF}') AS days_since,
       round(exp(-0.001 * datediff('day', CAST(o_orderdate AS DATE), DATE '{REF}')), 6) AS decay FROM orders""")
def recency_decay(spark, sf):
    return B.recency_decay(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", REF, 0.001)


@query("prior_visits", sql="""
SELECT o_orderkey, o_custkey, o_orderdate,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS prior_visits FROM orders""")
def prior_visits(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return B.prior_visits(df, "o_custkey", "o_orderdate", "o_orderkey")


@query("rolling_stats", sql="""
WITH b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, CAST(count(value) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
r AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM r),
s AS (SELECT g.event_type, g.ts, coalesce(b.value, 0.0) AS value FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.ts = b.ts)
SELECT event_type, ts, value, round(lag(value, 1) OVER w, 4) AS lag_1, round(lag(value, 6) OVER w, 4) AS lag_6,
       round(lag(value, 24) OVER w, 4) AS lag_24,
       round(avg(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS rolling_mean_24,
       round(max(value) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 4) AS rolling_max_24
FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def rolling_stats(spark, sf):
    s = T.regularize(table(spark, sf, "events"), "ts", "value", "h", key="event_type", agg="count", fill="zero")
    return B.rolling_stats(s, "event_type")


@query("group_stats", sql="""
SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, round(g.md, 4) AS group_median, round(g.mn, 4) AS group_mean,
       round(c.c_acctbal - g.mn, 4) AS diff_from_group_mean
FROM customer c JOIN (SELECT c_nationkey, quantile_cont(c_acctbal, 0.5) AS md, avg(c_acctbal) AS mn FROM customer GROUP BY 1) g
  USING (c_nationkey)""")
def group_stats(spark, sf):
    return B.group_stats(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal")


@query("salary_percentile", sql="""
SELECT c_custkey, c_mktsegment, c_acctbal,
       round(coalesce(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 0.0), 4) AS percent_rank FROM customer""")
def salary_percentile(spark, sf):
    return B.group_percentile(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"),
                              "c_mktsegment", "c_acctbal")


# fixed values: the example holiday calendar
HOLIDAYS = ["2024-01-01", "2024-01-15"]


@query("temporal_flags", sql=f"""
SELECT event_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, isodow(ts) >= 6 AS is_weekend,
       hour(ts) BETWEEN 9 AND 16 AS is_peak_hour, CAST(ts AS DATE) IN ({", ".join(f"DATE '{d}'" for d in HOLIDAYS)}) AS is_holiday
FROM events""")
def temporal_flags(spark, sf):
    hol = spark.createDataFrame([(d,) for d in HOLIDAYS], "d string").select(F.to_date("d").alias("date"))
    return B.temporal_flags(table(spark, sf, "events").select("event_id", "ts"), "ts", hol)

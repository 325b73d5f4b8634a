"""Time-series queries: orders daily totals, events hourly per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as T
from .registry import query
from .tables import cte, derived, table

# daily order totals on the complete day grid (days without orders = 0)
DAILY_SQL = """
b AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 DAY)) AS ts),
s AS (SELECT g.ts, coalesce(b.value, 0.0) AS value FROM g LEFT JOIN b USING (ts))"""


def _daily(spark, sf, fill="zero"):
    return T.regularize(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "D", agg="sum", fill=fill)


HOURLY_SQL = """
b AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, avg(value) AS value FROM events GROUP BY 1, 2),
r AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM r),
s AS (SELECT g.event_type, g.ts, b.value FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.ts = b.ts)"""


def _hourly(spark, sf, fill):
    return T.regularize(table(spark, sf, "events"), "ts", "value", "h", key="event_type", agg="mean", fill=fill)


@query("detect_datetime", sql=cte("orders_text") + """
SELECT * FROM (
  SELECT 'o_orderkey' AS column_name, CASE WHEN min(o_orderkey) > 9.46e8 AND max(o_orderkey) < 2.21e9 THEN 'unix' END AS kind,
         CASE WHEN min(o_orderkey) > 9.46e8 AND max(o_orderkey) < 2.21e9 THEN 1.0 ELSE 0.0 END AS parse_rate FROM orders_text
  UNION ALL SELECT 'o_custkey', CASE WHEN min(o_custkey) > 9.46e8 AND max(o_custkey) < 2.21e9 THEN 'unix' END, 0.0 FROM orders_text
  UNION ALL SELECT c, CASE WHEN r >= 0.8 THEN 'parsed' END, round(r, 4) FROM (
      SELECT 'o_orderstatus' AS c, CAST(count(TRY_CAST(o_orderstatus AS TIMESTAMP)) AS DOUBLE) / greatest(count(o_orderstatus), 1) AS r FROM orders_text
      UNION ALL SELECT 'o_orderpriority', CAST(count(TRY_CAST(o_orderpriority AS TIMESTAMP)) AS DOUBLE) / greatest(count(o_orderpriority), 1) FROM orders_text
      UNION ALL SELECT 'price_text', CAST(count(TRY_CAST(price_text AS TIMESTAMP)) AS DOUBLE) / greatest(count(price_text), 1) FROM orders_text
      UNION ALL SELECT 'date_text', CAST(count(TRY_CAST(date_text AS TIMESTAMP)) AS DOUBLE) / greatest(count(date_text), 1) FROM orders_text)
  UNION ALL SELECT 'o_totalprice', CASE WHEN min(o_totalprice) > 9.46e8 AND max(o_totalprice) < 2.21e9 THEN 'unix' END, 0.0 FROM orders_text
  UNION ALL SELECT 'o_orderdate', 'native', 1.0
) WHERE kind IS NOT NULL""")
def detect_datetime(spark, sf):
    return T.detect_datetime(derived(spark, sf, "orders_text"))


@query("infer_frequency", sql="""
WITH g AS (SELECT event_type, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS us FROM events)
SELECT event_type, round(quantile_cont(us, 0.5) / 1e6, 4) AS median_gap_seconds,
       CASE WHEN quantile_cont(us, 0.5) / 1e6 <= 3600 THEN 'h' WHEN quantile_cont(us, 0.5) / 1e6 <= 86400 THEN 'D'
            WHEN quantile_cont(us, 0.5) / 1e6 <= 604800 THEN 'W' ELSE 'MS' END AS freq
FROM g WHERE us IS NOT NULL GROUP BY event_type""")
def infer_frequency(spark, sf):
    return T.infer_frequency(table(spark, sf, "events"), "ts", "event_type")


@query("regularize", sql="WITH " + DAILY_SQL + "\nSELECT ts, round(value, 4) AS value FROM s")
def regularize(spark, sf):
    return _daily(spark, sf).select("ts", F.round(F.col("value") * 1e4, 0).__truediv__(1e4).alias("value"))


def _r4(df):
    return df.select(*[c for c in df.columns if c != "value"], (F.round(F.col("value") * 1e4, 0) / 1e4).alias("value"))


@query("ts_ffill", sql="WITH " + HOURLY_SQL + """
SELECT event_type, ts, round(v, 4) AS value FROM (
  SELECT event_type, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM s) WHERE v IS NOT NULL""")
def ts_ffill(spark, sf):
    return _r4(_hourly(spark, sf, "ffill"))


@query("ts_bfill", sql="WITH " + HOURLY_SQL + """
SELECT event_type, ts, round(v, 4) AS value FROM (
  SELECT event_type, ts, first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM s) WHERE v IS NOT NULL""")
def ts_bfill(spark, sf):
    return _r4(_hourly(spark, sf, "bfill"))


@query("ts_zero", sql="WITH " + HOURLY_SQL + "\nSELECT event_type, ts, round(coalesce(value, 0.0), 4) AS value FROM s")
def ts_zero(spark, sf):
    return _r4(_hourly(spark, sf, "zero"))


@query("ts_interpolate", sql="WITH " + HOURLY_SQL + """,
k AS (SELECT event_type, ts, value,
        last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
        last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
        first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM s)
SELECT event_type, ts, round(v, 4) AS value FROM (
  SELECT event_type, ts, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
         ELSE pv + (nv - pv) * ((CAST(epoch_us(ts) AS DOUBLE) - epoch_us(pt)) / (CAST(epoch_us(nt) AS DOUBLE) - epoch_us(pt))) END AS v
  FROM k) WHERE v IS NOT NULL""")
def ts_interpolate(spark, sf):
    return _r4(_hourly(spark, sf, "interpolate"))


_SUMMARY_SQL = "WITH " + DAILY_SQL + """,
t AS (SELECT ts, value, count(*) OVER () AS n, greatest(floor(count(*) OVER () / 10), 2) AS w,
             row_number() OVER (ORDER BY ts) AS ru, row_number() OVER (ORDER BY ts DESC) AS rd FROM s),
a AS (SELECT count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
             round(max(value), 4) AS max, round(quantile_cont(value, 0.5), 4) AS median, round(skewness(value), 4) AS skewness,
             round(kurtosis(value), 4) AS kurtosis, min(ts) AS start, max(ts) AS "end", CAST(max(w) AS INTEGER) AS rolling_window,
             avg(value) FILTER (WHERE ru <= w) AS m0, avg(value) FILTER (WHERE rd <= w) AS m1,
             stddev_samp(value) FILTER (WHERE ru <= w) AS s0, stddev_samp(value) FILTER (WHERE rd <= w) AS s1 FROM t)"""


@query("ts_summary", sql=_SUMMARY_SQL + """
SELECT count, mean, std, min, max, median, skewness, kurtosis, start, "end", rolling_window,
       CASE WHEN m1 > m0 THEN 'increasing' ELSE 'decreasing' END AS rolling_mean_trend,
       CASE WHEN s1 > s0 THEN 'increasing' ELSE 'decreasing' END AS rolling_std_trend FROM a""")
def ts_summary(spark, sf):
    return T.ts_summary(_daily(spark, sf)).withColumn("rolling_window", F.col("rolling_window").cast("int"))


@query("ts_trend", sql=_SUMMARY_SQL + """
SELECT rolling_window, CASE WHEN m1 > m0 THEN 'increasing' ELSE 'decreasing' END AS rolling_mean_trend,
       CASE WHEN s1 > s0 THEN 'increasing' ELSE 'decreasing' END AS rolling_std_trend FROM a""")
def ts_trend(spark, sf):
    return T.ts_summary(_daily(spark, sf)).select(F.col("rolling_window").cast("int"), "rolling_mean_trend", "rolling_std_trend")


@query("ts_rolling", sql="WITH " + DAILY_SQL + """
SELECT ts, round(value, 4) AS value,
       round(CASE WHEN row_number() OVER (ORDER BY ts) >= 7 THEN avg(value) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 4) AS rolling_mean,
       round(CASE WHEN row_number() OVER (ORDER BY ts) >= 7 THEN stddev_samp(value) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END, 4) AS rolling_std
FROM s""")
def ts_rolling(spark, sf):
    return _r4(T.rolling(_daily(spark, sf), 7))


@query("acf", sql="WITH " + DAILY_SQL + """,
p AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, value - avg(value) OVER () AS d,
             least(10, floor(count(*) OVER () / 2) - 1) AS L FROM s),
c0 AS (SELECT sum(d * d) AS c0, max(L) AS L FROM p),
k AS (SELECT unnest(range(0, CAST((SELECT L FROM c0) AS BIGINT) + 1)) AS k)
SELECT CAST(k.k AS INTEGER) AS lag, round(sum(a.d * b.d) / (SELECT c0 FROM c0), 4) AS acf
FROM k, p a JOIN p b ON b.i = a.i + k.k GROUP BY k.k""")
def acf(spark, sf):
    return T.acf(_daily(spark, sf), 10).withColumn("lag", F.col("lag").cast("int"))


def _decomp_sql(period: int, mult: bool, fill_src: str) -> str:
    h = period // 2
    if period % 2:
        ma = f"avg(value) OVER (ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    else:
        ma = (f"(sum(value) OVER (ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) - 0.5 * "
              f"(lag(value, {h}) OVER (ORDER BY ts) + lead(value, {h}) OVER (ORDER BY ts))) / {period}")
    det = "value / trend" if mult else "value - trend"
    center = "pm / avg(pm) OVER ()" if mult else "pm - avg(pm) OVER ()"
    resid = "value / (trend * seasonal)" if mult else "value - trend - seasonal"
    return fill_src + f""",
t0 AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, {ma} AS ma FROM s),
t AS (SELECT ts, value, i, CASE WHEN i >= {h} AND i < n - {h} THEN ma END AS trend FROM t0),
ph AS (SELECT i % {period} AS phase, avg({det}) AS pm FROM t GROUP BY 1),
se AS (SELECT phase, {center} AS seasonal FROM ph)
SELECT ts, round(value, 4) AS observed, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round({resid}, 4) AS resid
FROM t JOIN se ON t.i % {period} = se.phase"""


FFILL_DAILY_SQL = """
b AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(ts) FROM b), (SELECT max(ts) FROM b), INTERVAL 1 DAY)) AS ts),
s AS (SELECT g.ts, last_value(b.value IGNORE NULLS) OVER (ORDER BY g.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
      FROM g LEFT JOIN b USING (ts))"""


@query("decompose_add", sql="WITH " + _decomp_sql(7, False, DAILY_SQL))
def decompose_add(spark, sf):
    return T.decompose(_daily(spark, sf), 7, "additive")


@query("decompose_mult", sql="WITH " + _decomp_sql(12, True, FFILL_DAILY_SQL))
def decompose_mult(spark, sf):
    return T.decompose(_daily(spark, sf, "ffill"), 12, "multiplicative")


@query("lag_features", sql="WITH " + DAILY_SQL + """
SELECT * FROM (SELECT ts, round(value, 4) AS y, round(lag(value, 1) OVER (ORDER BY ts), 4) AS lag_1,
       round(lag(value, 2) OVER (ORDER BY ts), 4) AS lag_2, round(lag(value, 3) OVER (ORDER BY ts), 4) AS lag_3,
       isodow(ts) - 1 AS dayofweek, month(ts) AS month, day(ts) AS day, quarter(ts) AS quarter FROM s)
WHERE lag_3 IS NOT NULL""")
def lag_features(spark, sf):
    out = T.lag_features(_daily(spark, sf), 3)
    return out.select("ts", *[(F.round(F.col(c) * 1e4, 0) / 1e4).alias(c) for c in ("y", "lag_1", "lag_2", "lag_3")],
                      "dayofweek", "month", "day", "quarter")

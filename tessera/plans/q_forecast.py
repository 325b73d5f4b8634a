"""Forecast queries: order totals by day, altogether and for each priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import timeseries as T
from .common import rounded
from .q_timeseries import DAILY_SQL, _daily
from .registry import query
from .tables import table


def _by_priority(spark, sf):
    return T.regularize(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "D", key="o_orderpriority", agg="sum", fill="zero")


_ACF = "WITH RECURSIVE " + DAILY_SQL + """,
p AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, value - avg(value) OVER () AS d,
             CAST(least(10, floor(count(*) OVER () / 2) - 1) AS BIGINT) AS L FROM s),
k AS (SELECT unnest(range(0, (SELECT max(L) FROM p) + 1)) AS k),
a AS (SELECT k.k, sum(x.d * y.d) / (SELECT sum(d * d) FROM p) AS r FROM k, p x JOIN p y ON y.i = x.i + k.k GROUP BY k.k),
l AS (SELECT list(r ORDER BY k) AS r, max(k) AS L FROM a),
dl(k, phi, v) AS (
  SELECT 0, []::DOUBLE[], 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - v1 * phi[k + 1 - j]), [v1]), v1
  FROM (SELECT dl.k, phi, (r[dl.k + 2] - coalesce(list_sum(list_transform(range(1, dl.k + 1), lambda j: phi[j] * r[dl.k + 2 - j])), 0))
               / (1 - coalesce(list_sum(list_transform(range(1, dl.k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS v1
        FROM dl, l WHERE dl.k < l.L))
"""


@query("pacf", sql=_ACF + "SELECT CAST(k AS INTEGER) AS lag, round(v, 4) AS pacf FROM dl")
def pacf(spark, sf):
    return FC.pacf(_daily(spark, sf), 10)


# residuals of both sides on the lagged difference and a constant; then a simple regression through the origin
_ADF = "WITH " + DAILY_SQL + """,
z AS (SELECT ts, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS v FROM s WHERE value IS NOT NULL),
dd AS (SELECT ts, v, v - lag(v) OVER (ORDER BY ts) AS dy, lag(v) OVER (ORDER BY ts) AS y1 FROM z),
x AS (SELECT dy, y1, lag(dy) OVER (ORDER BY ts) AS d1 FROM dd),
f AS (SELECT * FROM x WHERE d1 IS NOT NULL),
o AS (SELECT regr_slope(dy, d1) AS s1, regr_intercept(dy, d1) AS i1, regr_slope(y1, d1) AS s2, regr_intercept(y1, d1) AS i2, count(*) AS n FROM f),
e AS (SELECT dy - i1 - s1 * d1 AS ey, y1 - i2 - s2 * d1 AS ex, n FROM f, o),
h AS (SELECT sum(ex * ey) / sum(ex * ex) AS c, sum(ex * ex) AS xx, sum(ey * ey) AS yy, any_value(n) AS n FROM e),
t AS (SELECT c / sqrt((yy - c * c * xx) / (n - 3) / xx) AS stat, n FROM h)
"""
_CRITICAL = ", ".join(f"round({' + '.join(f'({c}) / pow(n, {p})' for p, c in enumerate(v))}, 4) AS critical_{k[:-1]}" for k, v in FC.ADF_CRITICAL.items())


@query("adf", sql=_ADF + f"""SELECT round(stat, 4) AS statistic, 1 AS lags_used, n AS n_obs, {_CRITICAL},
stat < {' + '.join(f'({c}) / pow(n, {p})' for p, c in enumerate(FC.ADF_CRITICAL['5%']))} AS is_stationary FROM t""")
def adf(spark, sf):
    return FC.adf(_daily(spark, sf), lags=1)


@query("stationarity")
def stationarity(spark, sf):
    """Both tests and the verdict on the daily series, lags chosen from the data."""
    return FC.stationarity(_daily(spark, sf))


_TREND = "WITH " + """
b AS (SELECT o_orderpriority, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
r AS (SELECT o_orderpriority, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY 1),
g AS (SELECT o_orderpriority, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM r),
s AS (SELECT g.o_orderpriority, g.ts, coalesce(b.value, 0.0) AS value, (epoch(g.ts) - epoch(r.lo)) / (epoch(r.hi) - epoch(r.lo)) AS t
      FROM g JOIN r USING (o_orderpriority) LEFT JOIN b ON b.o_orderpriority = g.o_orderpriority AND b.ts = g.ts)
"""


@query("trend_fit", sql=_TREND + """SELECT o_orderpriority, count(*) AS n, round(regr_intercept(value, t), 2) AS level, round(regr_slope(value, t), 2) AS slope,
round(sqrt((regr_syy(value, t) - regr_sxy(value, t) * regr_slope(value, t)) / (count(*) - 1)), 2) AS sigma FROM s GROUP BY o_orderpriority""")
def trend_fit(spark, sf):
    """Coefficients of the trend alone, which SQL can fit too."""
    out = FC.fourier_fit(_by_priority(spark, sf), "o_orderpriority", changepoints=0, seasons={})
    return rounded(out.select("o_orderpriority", "n", F.get("coefficients", F.lit(0)).alias("level"), F.get("coefficients", F.lit(1)).alias("slope"), "sigma"), 2)


@query("fourier_forecast")
def fourier_forecast(spark, sf):
    return FC.fourier_forecast(_by_priority(spark, sf), "D", 30, "o_orderpriority", seasons={7 * FC.DAY: 3, 365.25 * FC.DAY: 4})


@query("lag_forecast")
def lag_forecast(spark, sf):
    s = _by_priority(spark, sf)
    fitted, _ = FC.fit_lags(s, "gradient_boosting", 14, key="o_orderpriority", trees=10)
    return FC.lag_forecast(s, fitted, 14, "D", 14, "o_orderpriority")


@query("forecast_errors")
def forecast_errors(spark, sf):
    """Errors of three models on the last fifth of each series."""
    return rounded(FC.auto_forecast(_by_priority(spark, sf), "o_orderpriority", trees=10, changepoints=4)[0])


@query("auto_forecast")
def auto_forecast(spark, sf):
    return rounded(FC.auto_forecast(_by_priority(spark, sf), "o_orderpriority", trees=10, changepoints=4)[1])

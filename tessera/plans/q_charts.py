"""Chart-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as V
from .registry import query
from .sqlgen import corr_sql, d, q, union_all
from .tables import cte, derived, table

_HIST = """
WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END AS width FROM m),
b AS (SELECT {grp}CAST(least(floor((value - lo) / width), {last}) AS INTEGER) AS bin, lo, width FROM events, w WHERE value IS NOT NULL {flt})
SELECT {grp}bin, round(any_value(lo) + bin * any_value(width), 4) AS bin_start,
       round(any_value(lo) + (bin + 1) * any_value(width), 4) AS bin_end, count(*) AS count FROM b GROUP BY {grp}bin"""


@query("histogram", sql=_HIST.format(bins=30, last=29, grp="", flt=""))
def histogram(spark, sf):
    return V.histogram(table(spark, sf, "events"), "value", 30)


@query("histogram_stats", sql="""
SELECT count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
       round(max(value), 4) AS max, round(quantile_cont(value, 0.5), 4) AS median FROM events""")
def histogram_stats(spark, sf):
    return V.histogram_stats(table(spark, sf, "events"), "value")


@query("grouped_histogram", sql=_HIST.format(
    bins=10, last=9, grp="event_type, ", flt=""))
def grouped_histogram(spark, sf):
    return V.histogram(table(spark, sf, "events"), "value", 10, by="event_type")


_BOX = ["value", "user_id"]


def _box_sql(c):
    q1, q3 = q(c, .25), q(c, .75)
    lo, hi = f"(SELECT {q1} - 1.5 * ({q3} - {q1}) FROM events)", f"(SELECT {q3} + 1.5 * ({q3} - {q1}) FROM events)"
    x = d(c)
    return (f"SELECT '{c}' AS column_name, round({q1}, 4) AS q1, round({q(c, .5)}, 4) AS median, round({q3}, 4) AS q3, "
            f"round(min({x}) FILTER (WHERE {x} >= {lo}), 4) AS whisker_low, round(max({x}) FILTER (WHERE {x} <= {hi}), 4) AS whisker_high, "
            f"round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std, "
            f"count(*) FILTER (WHERE {x} < {lo} OR {x} > {hi}) AS n_outliers FROM events")


@query("box_plot", sql=union_all([_box_sql(c) for c in _BOX]))
def box_plot(spark, sf):
    return V.box_plot(table(spark, sf, "events"), _BOX)


@query("scatter_corr", sql=f"""
SELECT '__all__' AS hue, count(*) AS n, round({corr_sql('l_quantity', 'l_extendedprice')}, 4) AS correlation FROM lineitem
UNION ALL
SELECT CAST(l_returnflag AS VARCHAR), count(*), round({corr_sql('l_quantity', 'l_extendedprice')}, 4) FROM lineitem
GROUP BY l_returnflag""")
def scatter_corr(spark, sf):
    return V.scatter_corr(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


_CM = ["l_quantity", "l_extendedprice", "l_discount", "revenue"]


@query("corr_matrix", sql=cte("lineitem_metrics") + union_all(
    [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({corr_sql(a, b)}, 4) AS correlation FROM lineitem_metrics"
     for a in _CM for b in _CM if a != b] + [f"SELECT '{c}', '{c}', 1.0" for c in _CM]))
def corr_matrix(spark, sf):
    return V.corr_matrix(derived(spark, sf, "lineitem_metrics"), _CM)


@query("residuals", sql=cte("lineitem_metrics") + """
SELECT round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(min(e), 4) AS min, round(max(e), 4) AS max, count(e) AS n
FROM (SELECT revenue - l_extendedprice * 0.95 AS e FROM lineitem_metrics)""")
def residuals(spark, sf):
    df = derived(spark, sf, "lineitem_metrics").withColumn("pred", F.col("l_extendedprice") * 0.95)
    return V.residuals(df, "revenue", "pred")

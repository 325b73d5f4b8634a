"""Evaluation queries on classifier / regressor outputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as Ev
from .registry import query
from .tables import cte, derived

SCORED = cte("scored_orders")
PRED = "CASE WHEN score >= 0.5 THEN 1 ELSE 0 END"


def _scored(spark, sf, threshold=0.5):
    return derived(spark, sf, "scored_orders").withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def _per_class_sql(y, p, src="scored_orders") -> str:
    return f"""t AS (SELECT CAST({y} AS VARCHAR) AS y, CAST({p} AS VARCHAR) AS p FROM {src}),
c AS (SELECT y AS class FROM t WHERE y IS NOT NULL UNION SELECT p FROM t WHERE p IS NOT NULL),
s AS (SELECT class, count(*) FILTER (WHERE y = class AND p = class) AS tp,
             count(*) FILTER (WHERE y <> class AND p = class) AS fp,
             count(*) FILTER (WHERE y = class AND p <> class) AS fn,
             count(*) FILTER (WHERE y = class) AS support FROM c, t GROUP BY class),
m AS (SELECT class, tp, fp, fn, support,
             coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision,
             coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS recall FROM s),
pc AS (SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM m)"""


@query("clf_metrics", sql=SCORED + f""", {_per_class_sql('label', PRED)}
SELECT round((SELECT CAST(count(*) FILTER (WHERE y = p) AS DOUBLE) / count(*) FROM t), 4) AS accuracy,
       round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, 'binary' AS average
FROM pc WHERE class = '1'""")
def clf_metrics(spark, sf):
    return Ev.clf_metrics(_scored(spark, sf), "label", "prediction", "1")


@query("clf_metrics_weighted", sql=SCORED + f""", {_per_class_sql('status', 'status_pred')}
SELECT round((SELECT CAST(count(*) FILTER (WHERE y = p) AS DOUBLE) / count(*) FROM t), 4) AS accuracy,
       round(sum(precision * support) / sum(support), 4) AS precision, round(sum(recall * support) / sum(support), 4) AS recall,
       round(sum(f1 * support) / sum(support), 4) AS f1, 'weighted' AS average FROM pc""")
def clf_metrics_weighted(spark, sf):
    return Ev.clf_metrics(derived(spark, sf, "scored_orders"), "status", "status_pred")


@query("confusion_matrix", sql=SCORED + f""", {_per_class_sql('status', 'status_pred')}
SELECT a.class AS actual, b.class AS predicted, (SELECT count(*) FROM t WHERE y = a.class AND p = b.class) AS count
FROM c a, c b""")
def confusion_matrix(spark, sf):
    return Ev.confusion_matrix(derived(spark, sf, "scored_orders"), "status", "status_pred")


@query("per_class_report", sql=SCORED + f""", {_per_class_sql('status', 'status_pred')}
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), sum(support) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4), round(sum(recall * support) / sum(support), 4),
                 round(sum(f1 * support) / sum(support), 4), sum(support) FROM pc""")
def per_class_report(spark, sf):
    return Ev.per_class_report(derived(spark, sf, "scored_orders"), "status", "status_pred")


@query("roc_auc", sql=SCORED + """
, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM scored_orders)
SELECT round((sum(ar) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
             / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label <> 1)), 4) AS roc_auc,
       count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label <> 1) AS negatives FROM r""")
def roc_auc(spark, sf):
    return Ev.roc_auc(derived(spark, sf, "scored_orders"), "label", "score")


_CURVE = SCORED + """
, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM scored_orders GROUP BY score),
cu AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
              (SELECT sum(pos) FROM g) AS P, (SELECT sum(neg) FROM g) AS N FROM g)"""


@query("roc_curve", sql=_CURVE + """
SELECT score AS threshold, round(CAST(fp AS DOUBLE) / N, 4) AS fpr, round(CAST(tp AS DOUBLE) / P, 4) AS tpr FROM cu""")
def roc_curve(spark, sf):
    return Ev.roc_curve(derived(spark, sf, "scored_orders"), "label", "score")


@query("pr_curve", sql=_CURVE + """
SELECT score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 4) AS precision, round(CAST(tp AS DOUBLE) / P, 4) AS recall FROM cu""")
def pr_curve(spark, sf):
    return Ev.pr_curve(derived(spark, sf, "scored_orders"), "label", "score")


@query("reg_metrics", sql=cte("lineitem_metrics") + """
, e AS (SELECT revenue AS y, revenue - l_extendedprice * 0.95 AS err FROM lineitem_metrics)
SELECT round(avg(abs(err)), 4) AS mae, round(avg(err * err), 4) AS mse, round(sqrt(avg(err * err)), 4) AS rmse,
       round(1 - avg(err * err) / var_pop(y), 4) AS r2, round(1 - var_pop(err) / var_pop(y), 4) AS explained_variance,
       round(avg(err), 4) AS residual_mean, round(stddev_pop(err), 4) AS residual_std FROM e""")
def reg_metrics(spark, sf):
    df = derived(spark, sf, "lineitem_metrics").withColumn("pred", F.col("l_extendedprice") * 0.95)
    return Ev.reg_metrics(df, "revenue", "pred")


@query("mape", sql=cte("lineitem_metrics") + """
SELECT round(avg(abs(revenue - l_extendedprice * 0.95) / greatest(abs(revenue), 2.220446049250313e-16)), 4) AS mape
FROM lineitem_metrics""")
def mape(spark, sf):
    df = derived(spark, sf, "lineitem_metrics").withColumn("pred", F.col("l_extendedprice") * 0.95)
    return Ev.mape(df, "revenue", "pred")


_THRESH = {"model_a": 0.4, "model_b": 0.5, "model_c": 0.6}


@query("rank_models", sql=SCORED + ", " + ", ".join(
    f"""{m} AS (SELECT '{m}' AS model, CAST(count(*) FILTER (WHERE label = 1 AND score >= {t}) AS DOUBLE) AS tp,
        count(*) FILTER (WHERE label = 0 AND score >= {t}) AS fp, count(*) FILTER (WHERE label = 1 AND score < {t}) AS fn,
        count(*) FILTER (WHERE (score >= {t}) = (label = 1)) AS ok, count(*) AS n FROM scored_orders)"""
    for m, t in _THRESH.items()) + """
, u AS (SELECT * FROM model_a UNION ALL SELECT * FROM model_b UNION ALL SELECT * FROM model_c),
f AS (SELECT model, round(CAST(ok AS DOUBLE) / n, 4) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM u)
SELECT model, accuracy, f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST, model) AS rank FROM f""")
def rank_models(spark, sf):
    rows = []
    for m, t in _THRESH.items():
        r = Ev.clf_metrics(_scored(spark, sf, t), "label", "prediction", "1").select(
            F.lit(m).alias("model"), "accuracy", "f1")
        rows.append(r)
    return Ev.rank_models(Ev.union_all(rows), "f1")


@query("anomaly_eval", sql="""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
t AS (SELECT CASE WHEN event_type = 'error' THEN '1' ELSE '0' END AS y,
             CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN '1' ELSE '0' END AS p FROM events, q),
s AS (SELECT count(*) FILTER (WHERE y = '1' AND p = '1') AS tp, count(*) FILTER (WHERE y = '0' AND p = '1') AS fp,
             count(*) FILTER (WHERE y = '1' AND p = '0') AS fn, count(*) FILTER (WHERE y = p) AS ok, count(*) AS n FROM t),
m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS pr, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS rc FROM s)
SELECT round(CAST(ok AS DOUBLE) / n, 4) AS accuracy, round(pr, 4) AS precision, round(rc, 4) AS recall,
       round(coalesce(2 * pr * rc / NULLIF(pr + rc, 0), 0.0), 4) AS f1, 'binary' AS average FROM m""")
def anomaly_eval(spark, sf):
    from ..operators.anomaly import iqr_flags
    from .tables import table
    ev = table(spark, sf, "events")
    flagged = iqr_flags(ev, ["value"]).withColumn("y", (F.col("event_type") == "error").cast("int"))
    return Ev.anomaly_eval(flagged, "y", "is_anomaly")

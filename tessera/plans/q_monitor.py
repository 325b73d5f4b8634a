"""Drift, degradation, alert and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from .registry import query
from .tables import cte, derived, table

SPLIT = cte("events_base", "events_cur")


def _halves(spark, sf):
    return derived(spark, sf, "events_base"), derived(spark, sf, "events_cur")


def _ks_sql(c: str) -> str:
    return f"""
ks_{c} AS (
  SELECT d, n1, n2, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * d AS lam FROM (
    SELECT max(abs(ca / n1 - cb / n2)) AS d, any_value(n1) AS n1, any_value(n2) AS n2 FROM (
      SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb,
             sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM (
        SELECT v, sum(a) AS a, sum(b) AS b FROM (
          SELECT CAST({c} AS DOUBLE) AS v, 1.0 AS a, 0.0 AS b FROM events_base WHERE {c} IS NOT NULL
          UNION ALL SELECT CAST({c} AS DOUBLE), 0.0, 1.0 FROM events_cur WHERE {c} IS NOT NULL) GROUP BY v)))),
p_{c} AS (SELECT CASE WHEN any_value(lam) < 0.001 THEN 1.0 ELSE least(greatest(
            sum(2 * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * lam * lam)), 0.0), 1.0) END AS p
          FROM ks_{c}, range(1, 101) r(k))"""


def _ks_row(c: str) -> str:
    return (f"SELECT '{c}' AS feature, 'ks_test' AS method, round(d, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS is_drifted, "
            f"(SELECT round(avg({c}), 4) FROM events_base) AS baseline_mean, (SELECT round(stddev_pop({c}), 4) FROM events_base) AS baseline_std, "
            f"(SELECT round(avg({c}), 4) FROM events_cur) AS current_mean, (SELECT round(stddev_pop({c}), 4) FROM events_cur) AS current_std "
            f"FROM ks_{c}, p_{c}")


KS_COLS = ["value", "user_id"]
KS_SQL = SPLIT + ", " + ", ".join(_ks_sql(c) for c in KS_COLS)

CHI_BODY = """g AS (SELECT v, sum(a) AS e, sum(b) AS o FROM (
          SELECT event_type AS v, 1 AS a, 0 AS b FROM events_base WHERE event_type IS NOT NULL
          UNION ALL SELECT event_type, 0, 1 FROM events_cur WHERE event_type IS NOT NULL) GROUP BY v),
t AS (SELECT sum(CASE WHEN e > 0 THEN e ELSE 1 END) AS te, sum(o) AS tot, count(*) AS k FROM g),
x AS (SELECT sum((o - ee) * (o - ee) / ee) AS stat, any_value(k) - 1 AS dof FROM (
        SELECT o, CASE WHEN e > 0 THEN e ELSE 1 END * (tot / te) AS ee, k FROM g, t)),
pc AS (SELECT exp(-any_value(stat) / 2) * sum(pow(stat / 2, j) / factorial(CAST(j AS INTEGER))) AS p
       FROM x, range(0, CAST(x.dof / 2 AS BIGINT)) r(j))"""
CHI_SQL = SPLIT + ", " + CHI_BODY


@query("drift_ks", sql=KS_SQL + "\n" + "\nUNION ALL\n".join(_ks_row(c) for c in KS_COLS))
def drift_ks(spark, sf):
    b, c = _halves(spark, sf)
    return M.drift_ks(b, c, KS_COLS)


@query("drift_chi2", sql=CHI_SQL + """
SELECT 'event_type' AS feature, 'chi_square' AS method, round(stat, 4) AS statistic, CAST(dof AS BIGINT) AS dof,
       round(p, 4) AS p_value, p < 0.05 AS is_drifted FROM x, pc""")
def drift_chi2(spark, sf):
    b, c = _halves(spark, sf)
    return M.drift_chi2(b, c, ["event_type"])


@query("drift_report", sql=KS_SQL + ", " + CHI_BODY + """
, det AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, 'ks_test' AS method, round(d, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS is_drifted FROM ks_{c}, p_{c}"
    for c in KS_COLS) + """
  UNION ALL SELECT 'event_type', 'chi_square', round(stat, 4), round(p, 4), p < 0.05 FROM x, pc)
SELECT * FROM det
UNION ALL SELECT '__summary__', 'summary', CAST(count(*) FILTER (WHERE is_drifted) AS DOUBLE),
       round(count(*) FILTER (WHERE is_drifted) * 100.0 / greatest(count(*), 1), 1), count(*) FILTER (WHERE is_drifted) > 0 FROM det""")
def drift_report(spark, sf):
    b, c = _halves(spark, sf)
    return M.drift_report(b.select("value", "user_id", "event_type"), c.select("value", "user_id", "event_type"))


def _metrics(df):
    m = df.agg(F.avg("value").alias("avg_value"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("purchase_rate"),
               F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"))
    return m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"))
                                       for k in ("avg_value", "purchase_rate", "error_rate")])))


def _metrics_sql(src):
    return (f"SELECT 'avg_value' AS metric, avg(value) AS value FROM {src} UNION ALL "
            f"SELECT 'purchase_rate', avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) FROM {src} UNION ALL "
            f"SELECT 'error_rate', avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) FROM {src}")


@query("perf_degradation", sql=SPLIT + f"""
, b AS ({_metrics_sql('events_base')}), c AS ({_metrics_sql('events_cur')}),
j AS (SELECT c.metric, c.value AS cv, coalesce(b.value, 0.0) AS bv,
             CASE WHEN c.metric = 'error_rate' THEN -1.0 ELSE 1.0 END AS sgn FROM c LEFT JOIN b ON c.metric = b.metric)
SELECT metric, round(cv, 4) AS metric_value, round(bv, 4) AS baseline_value,
       CASE WHEN bv = 0 THEN 0.0 ELSE round(sgn * (bv - cv) / bv * 100.0, 2) END AS degradation_pct,
       CASE WHEN bv = 0 THEN 0.0 ELSE round(sgn * (bv - cv) / bv * 100.0, 2) END > 5.0 AS is_degraded FROM j""")
def perf_degradation(spark, sf):
    b, c = _halves(spark, sf)
    return M.perf_degradation(_metrics(b), _metrics(c), 5.0, {"error_rate": False})


@query("prediction_summary", sql="""
SELECT 'value' AS column_name, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min,
       round(max(value), 4) AS max, count(value) AS n, count(DISTINCT value) AS n_distinct FROM events
UNION ALL
SELECT 'k', round(avg(k), 4), round(stddev_pop(k), 4), round(min(k), 4), round(max(k), 4), count(k), count(DISTINCT k)
FROM (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")
def prediction_summary(spark, sf):
    df = table(spark, sf, "events").select("value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return M.prediction_summary(df, "value", "k")


# fixed values: the alert rules of the example (rule_id, name, metric, operator, threshold, severity, enabled)
RULES = [
    ("r1", "busy day", "n_events", ">", 75.0, "warning", True),
    ("r2", "low value", "avg_value", "<", 40.0, "critical", True),
    ("r3", "exact volume", "n_events", "==", 66.0, "info", True),
    ("r4", "disabled", "n_events", "!=", 66.0, "info", False),
    ("r5", "high value", "avg_value", ">=", 60.0, "warning", True),
    ("r6", "quiet day", "n_events", "<=", 55.0, "info", True),
]
_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}, '{f}', {str(g).lower()})"
                                     for a, b, c, d, e, f, g in RULES) + \
    ") r(rule_id, name, metric_name, operator, threshold, severity, enabled)"
_ALERT_SQL = f"""
WITH m0 AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(count(*) AS DOUBLE) AS n_events,
                   avg(value) AS avg_value FROM events GROUP BY 1, 2),
m AS (SELECT event_type, day, 'n_events' AS metric_name, n_events AS metric_value FROM m0
      UNION ALL SELECT event_type, day, 'avg_value', avg_value FROM m0),
a AS (SELECT m.event_type, m.day AS alert_time, m.metric_name, round(m.metric_value, 4) AS metric_value, r.rule_id, r.severity,
             CASE WHEN m.day >= TIMESTAMP '2024-01-25 00:00:00' THEN 'active' ELSE 'resolved' END AS status
      FROM m JOIN {_RULES_SQL} ON m.metric_name = r.metric_name
      WHERE r.enabled AND CASE r.operator WHEN '>' THEN m.metric_value > r.threshold WHEN '<' THEN m.metric_value < r.threshold
            WHEN '>=' THEN m.metric_value >= r.threshold WHEN '<=' THEN m.metric_value <= r.threshold
            WHEN '==' THEN abs(m.metric_value - r.threshold) < 1e-6 WHEN '!=' THEN abs(m.metric_value - r.threshold) >= 1e-6
            ELSE false END)"""


def _alert_rows(spark, sf):
    ev = table(spark, sf, "events")
    m0 = ev.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), F.avg("value").alias("avg_value"))
    m = m0.select("event_type", "day", F.inline(F.array(
        F.struct(F.lit("n_events").alias("metric_name"), F.col("n_events").alias("metric_value")),
        F.struct(F.lit("avg_value").alias("metric_name"), F.col("avg_value").alias("metric_value")))))
    rules = spark.createDataFrame(RULES, "rule_id string, name string, metric_name string, operator string, "
                                         "threshold double, severity string, enabled boolean")
    a = M.alerts(m, rules)
    return a.select("event_type", F.col("day").alias("alert_time"), "metric_name",
                    F.round(F.col("metric_value") * 10000.0, 0).__truediv__(10000.0).alias("metric_value"),
                    "rule_id", "severity",
                    F.when(F.col("day") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), "active")
                    .otherwise("resolved").alias("status"))


@query("alerts", sql=_ALERT_SQL + "\nSELECT * FROM a")
def alerts(spark, sf):
    return _alert_rows(spark, sf)


@query("alert_history", sql=_ALERT_SQL + """
SELECT * FROM a WHERE status = 'active'
ORDER BY alert_time DESC, event_type, metric_name, metric_value, rule_id, severity, status LIMIT 25""")
def alert_history(spark, sf):
    return M.alert_history(_alert_rows(spark, sf), "active", 25)


@query("alert_summary", sql=_ALERT_SQL + """
SELECT 'status' AS dimension, status AS value, count(*) AS count FROM a GROUP BY status
UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity
UNION ALL SELECT 'total', 'all', count(*) FROM a""")
def alert_summary(spark, sf):
    return M.alert_summary(_alert_rows(spark, sf))


@query("serving_stats", sql="""
WITH w AS (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS conf FROM events
           WHERE ts >= TIMESTAMP '2024-01-30 23:59:59' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '2024-01-30 23:59:59')
SELECT count(*) AS n_predictions, round(avg(value), 4) AS avg_latency, round(avg(conf), 4) AS avg_confidence,
       min(ts) AS first_prediction, max(ts) AS last_prediction, round(quantile_cont(value, 0.5), 4) AS p50_latency,
       round(quantile_cont(value, 0.95), 4) AS p95_latency, round(quantile_cont(value, 0.99), 4) AS p99_latency FROM w""")
def serving_stats(spark, sf):
    ev = table(spark, sf, "events").withColumn("conf", F.get_json_object("props", "$.k").cast("double") / 100.0)
    return M.serving_stats(ev, "ts", "value", "conf", "2024-01-30 23:59:59", 7)


@query("recent_predictions", sql="SELECT event_id, ts, user_id, value FROM events ORDER BY ts DESC LIMIT 20")
def recent_predictions(spark, sf):
    return M.recent_predictions(table(spark, sf, "events").select("event_id", "ts", "user_id", "value"), "ts", 20)

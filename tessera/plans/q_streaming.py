"""Streaming queries: each runs a Structured Streaming job over the events
file with trigger(availableNow) and returns the sink table; the oracle is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as S
from .registry import query
from .tables import derived, table


def _src(spark, sf):
    # a glob, because a file stream source watches a folder (new files = new micro-batches)
    path = f"{sf.rstrip('/')}/events*.parquet"
    return path, table(spark, sf, "events").schema


def _r4(df, cols):
    return df.select(*[(F.round(F.col(c) * 1e4, 0) / 1e4).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("stream_extract", sql="SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def stream_extract(spark, sf):
    path, schema = _src(spark, sf)
    return S.extract_job(spark, path, schema, ["event_id", "ts", "user_id", "event_type", "value"], "event_type <> 'error'")


@query("stream_tumbling", sql="""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS n, round(avg(value), 4) AS avg_value, round(max(value), 4) AS max_value FROM events GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf):
    path, schema = _src(spark, sf)
    out = S.windowed_stats_job(spark, path, schema, "ts", "event_type", "value", "1 hour", name="tumbling")
    return _r4(out, ["avg_value", "max_value"])


@query("stream_sliding", sql="""
WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start, event_type, value
           FROM events, range(0, 4) r(k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(avg(value), 4) AS avg_value,
       round(max(value), 4) AS max_value FROM w GROUP BY 1, 2, 3""")
def stream_sliding(spark, sf):
    path, schema = _src(spark, sf)
    out = S.windowed_stats_job(spark, path, schema, "ts", "event_type", "value", "1 hour", "15 minutes", name="sliding")
    return _r4(out, ["avg_value", "max_value"])


@query("stream_session", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                  OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT * FROM (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events
               FROM s GROUP BY user_id, sid)""")
def stream_session(spark, sf):
    path, schema = _src(spark, sf)
    return S.session_job(spark, path, schema, "ts", "user_id", "30 minutes", name="session")


@query("stream_zscore", sql="""
WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00')
SELECT event_id, value, round(abs((value - m) / s), 4) AS z, coalesce(abs((value - m) / s) > 3, false) AS is_anomaly FROM events, b""")
def stream_zscore(spark, sf):
    path, schema = _src(spark, sf)
    out = S.zscore_job(spark, path, schema, derived(spark, sf, "events_base"), "event_id", "value")
    return _r4(out, ["z"])


@query("stream_predictions", sql="SELECT event_id, ts, value FROM events")
def stream_predictions(spark, sf):
    path, schema = _src(spark, sf)
    return S.predictions_job(spark, path, schema, ["event_id", "ts", "value"])


@query("stream_running_z", sql="""
SELECT user_id, ts, event_id, round(CASE WHEN var_samp(value) OVER w > 1e-12
         THEN abs(value - avg(value) OVER w) / sqrt(var_samp(value) OVER w) END, 4) AS z
FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def stream_running_z(spark, sf):
    path, schema = _src(spark, sf)
    return _r4(S.running_stats_job(spark, path, schema, "user_id", "ts", "value", "event_id"), ["z"])


_RULES = [(1, "purchase", ">", 90.0, "warning", True), (2, "error", ">=", 50.0, "critical", True),
          (3, "view", "<", 2.0, "info", True), (4, "click", ">", 0.0, "info", False)]
_RULE_ROWS = ", ".join(f"({i}, '{m}', '{op}', {t}, '{s}', {str(on).lower()})" for i, m, op, t, s, on in _RULES)


@query("stream_alerts", sql=f"""
SELECT DISTINCT CAST(rule_id AS BIGINT) AS rule_id, severity, user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket
FROM events JOIN (VALUES {_RULE_ROWS}) r(rule_id, metric_name, op, threshold, severity, enabled) ON event_type = metric_name
WHERE enabled AND CASE op WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '<' THEN value < threshold END""")
def stream_alerts(spark, sf):
    path, schema = _src(spark, sf)
    rules = spark.createDataFrame(_RULES, "rule_id long, metric_name string, operator string, threshold double, severity string, enabled boolean")
    return S.alerts_job(spark, path, schema, rules, "ts", "event_type", "value", "user_id")

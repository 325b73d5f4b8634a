"""Stream jobs whose input arrives in three deliveries, a run of the job after each: state, deduplication and late rows across batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.readers import scratch_path
from ..streaming import jobs as S
from .q_retrain import deliveries
from .q_streaming import _RULES, _r4
from .registry import ORACLE, query
from .tables import table

#: The second cut lies within an hour, so that windows, sessions and alerts go on in the next delivery.
CUTS = ["1970-01-01 00:00:00", "2024-01-10 00:00:00", "2024-01-19 12:30:00", "2100-01-01 00:00:00"]
LATE = f"event_id % 50 = 0 AND ts < TIMESTAMP '{CUTS[1]}'"


def _after_each(spark, sf, name, job, late=False):
    """The table that ``job(source, schema, at)`` has after the last delivery; ``late``: some rows of the first come with the last."""
    base = scratch_path(spark, name)
    events = table(spark, sf, "events")
    when = F.when(F.expr(f"event_id % 50 = 0 AND ts < TIMESTAMP_NTZ '{CUTS[1]}'"), F.lit("2099-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")) \
        if late else F.col("ts")
    out = None
    for _ in deliveries(events.withColumn("arrived", when), CUTS, f"{base}/in", "arrived"):
        out = job(f"{base}/in/*", events.schema, (f"{base}/out", f"{base}/checkpoint"))
    return out


@query("stream_tumbling_deliveries", sql=f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS n, round(avg(value), 4) AS avg_value, round(max(value), 4) AS max_value FROM events WHERE NOT ({LATE}) GROUP BY 1, 2, 3""")
def stream_tumbling_deliveries(spark, sf):
    """Rows that come after their window has closed are dropped, windows cut by a delivery go on."""
    return _r4(_after_each(spark, sf, "tumbling", lambda src, schema, at: S.windowed_stats_job(
        spark, src, schema, "ts", "event_type", "value", "1 hour", at=at), late=True), ["avg_value", "max_value"])


@query("stream_session_deliveries", sql=ORACLE["stream_session"])
def stream_session_deliveries(spark, sf):
    return _after_each(spark, sf, "sessions", lambda src, schema, at: S.session_job(spark, src, schema, "ts", "user_id", "30 minutes", at=at))


@query("stream_running_z_deliveries", sql=ORACLE["stream_running_z"])
def stream_running_z_deliveries(spark, sf):
    """Sums of each key go from batch to batch."""
    return _r4(_after_each(spark, sf, "running", lambda src, schema, at: S.running_stats_job(
        spark, src, schema, "user_id", "ts", "value", "event_id", at=at)), ["z"])


@query("stream_alerts_deliveries", sql=ORACLE["stream_alerts"])
def stream_alerts_deliveries(spark, sf):
    """An alert that was raised in one delivery is not raised again in the next."""
    rules = spark.createDataFrame(_RULES, "rule_id long, metric_name string, operator string, threshold double, severity string, enabled boolean")
    return _after_each(spark, sf, "alerts", lambda src, schema, at: S.alerts_job(spark, src, schema, rules, "ts", "event_type", "value", "user_id", at=at))


@query("stream_predictions_deliveries", sql=ORACLE["stream_predictions"])
def stream_predictions_deliveries(spark, sf):
    return _after_each(spark, sf, "predictions", lambda src, schema, at: S.predictions_job(spark, src, schema, ["event_id", "ts", "value"], *at))

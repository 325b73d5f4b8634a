"""Retraining runs, and streams whose input arrives in three deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators import retrain as R
from ..sources.readers import scratch_path
from ..streaming import jobs as S
from .q_monitor import CHI_BODY, KS_COLS, _ks_sql
from .registry import query
from .tables import DERIVED, derived, table

#: Deliveries of the events after the baseline, by time.
_CUTS = ["2024-01-15 00:00:00", "2024-01-19 00:00:00", "2024-01-24 00:00:00", "2100-01-01 00:00:00"]


def _report_sql(i: int) -> str:
    current = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{_CUTS[i]}' AND ts < TIMESTAMP '{_CUTS[i + 1]}'"
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, 'ks_test' AS method, round(d, 4) AS statistic, round(p, 4) AS p_value, p < 0.05 AS is_drifted FROM ks_{c}, p_{c}"
                              for c in KS_COLS)
    return (f"SELECT {i} AS batch, * FROM (WITH events_base AS ({DERIVED['events_base']}), events_cur AS ({current}), "
            + ", ".join(_ks_sql(c) for c in KS_COLS) + f", {CHI_BODY}, det AS ({rows} UNION ALL SELECT 'event_type', 'chi_square', round(stat, 4), round(p, 4), p < 0.05 FROM x, pc) "
            "SELECT * FROM det UNION ALL SELECT '__summary__', 'summary', CAST(count(*) FILTER (WHERE is_drifted) AS DOUBLE), "
            "round(count(*) FILTER (WHERE is_drifted) * 100.0 / greatest(count(*), 1), 1), count(*) FILTER (WHERE is_drifted) > 0 FROM det)")


def deliveries(df, cuts, folder, ts="ts"):
    """Write one delivery after the other and yield after each: what a scheduled job finds when it runs next."""
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.where((F.col(ts) >= F.lit(a).cast("timestamp_ntz")) & (F.col(ts) < F.lit(b).cast("timestamp_ntz"))).write.parquet(f"{folder}/delivery={i}")
        yield i


@query("stream_drift", sql="\nUNION ALL ".join(_report_sql(i) for i in range(3)))
def stream_drift(spark, sf):
    base = scratch_path(spark, "drift")
    columns = ["value", "user_id", "event_type"]
    baseline = M.DriftBaseline(derived(spark, sf, "events_base").select(*columns), f"{base}/baseline")
    events = table(spark, sf, "events")
    for _ in deliveries(events, _CUTS, f"{base}/in"):
        S.drift_job(S.file_stream(spark, f"{base}/in/*", events.schema).select(*columns), baseline, f"{base}/out", f"{base}/checkpoint")
    return S.read_batches(spark, f"{base}/out").select(F.col("batch").cast("int"), "feature", "method", "statistic", "p_value", "is_drifted")


JOB = R.Job("lineitem-price", "l_extendedprice", ["l_orderkey", "l_linenumber"], features=["l_quantity", "l_discount", "l_tax"], engineer=False)
_LEDGER = """
WITH n AS (SELECT count(*) AS n FROM lineitem_gaps), d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM lineitem_gaps)),
t AS (SELECT count(*) AS t FROM (SELECT DISTINCT * FROM lineitem_gaps) WHERE l_extendedprice IS NOT NULL)
SELECT * FROM (VALUES (0, 'load_data', 'done', (SELECT n FROM n)), (1, 'data_cleaning', 'done', (SELECT d FROM d)),
  (2, 'feature_engineering', 'skipped', (SELECT d FROM d)), (3, 'preprocessing', 'done', (SELECT t FROM t)), (4, 'split_data', 'done', (SELECT t FROM t)),
  (7, 'register_model', 'done', NULL), (8, 'promote', 'done', NULL)) v(position, step, status, n_rows)"""


@query("retrain_run", sql=f"WITH lineitem_gaps AS ({DERIVED['lineitem_gaps']})\nSELECT * FROM ({_LEDGER})")
def retrain_run(spark, sf):
    """The ledger of a run; how many rows train and what the scores are, SQL cannot tell."""
    steps = R.run(derived(spark, sf, "lineitem_gaps"), JOB, "run-0", scratch_path(spark, "retrain"))
    return steps.where("step not in ('train_model', 'evaluate')").select("position", "step", "status", "n_rows")


@query("retrain_scores")
def retrain_scores(spark, sf):
    root = scratch_path(spark, "retrain")
    R.run(derived(spark, sf, "lineitem_gaps"), JOB, "run-0", root)
    return R.registry(spark, root, JOB.name)


@query("stream_retrain", sql="""
SELECT * FROM (VALUES ('value-by-user-00000000'), ('value-by-user-00000001'), ('value-by-user-00000002')) r(run),
(VALUES ('load_data', 'done'), ('data_cleaning', 'done'), ('feature_engineering', 'done'), ('preprocessing', 'done'), ('split_data', 'done'),
        ('train_model', 'done'), ('evaluate', 'done'), ('register_model', 'done'), ('promote', 'done')) s(step, status)""")
def stream_retrain(spark, sf):
    """Three deliveries of events start three runs of the one enabled job."""
    base = scratch_path(spark, "stream-retrain")
    job = R.Job("value-by-user", "value", ["event_id"], features=["user_id"], engineer=True)
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    for _ in deliveries(events, ["1970-01-01 00:00:00", *_CUTS[1:]], f"{base}/in"):
        stream = S.file_stream(spark, f"{base}/in/*", events.schema).select("event_id", "user_id", "value")
        S.retrain_job(stream, [job, R.Job("off", "value", ["event_id"], enabled=False)], f"{base}/models", f"{base}/checkpoint")
    return R.ledger(spark, f"{base}/models").select("run", "step", "status")

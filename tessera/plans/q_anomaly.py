"""Anomaly-detection queries."""

from __future__ import annotations

from ..operators import anomaly as A
from .common import rounded
from .registry import query
from .sqlgen import d, union_all
from .tables import table

COLS = ["value", "user_id"]


def _ev(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "value")


_Z = "abs(({c} - (SELECT avg({c}) FROM events)) / NULLIF((SELECT stddev_samp({c}) FROM events), 0))"


@query("anomaly_zscore", sql=f"""
SELECT event_id, user_id, value, round(greatest({_Z.format(c=d('value'))}, {_Z.format(c=d('user_id'))}), 4) AS max_abs_z,
       coalesce({_Z.format(c=d('value'))} > 3, false) OR coalesce({_Z.format(c=d('user_id'))} > 3, false) AS is_anomaly
FROM events""")
def anomaly_zscore(spark, sf):
    return rounded(A.zscore_flags(_ev(spark, sf), COLS))


@query("anomaly_zscore_stats", sql=union_all([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_Z.format(c=d(c))} > 3) AS outlier_count, "
    f"round(max({_Z.format(c=d(c))}), 4) AS max_zscore, round(avg({_Z.format(c=d(c))}), 4) AS mean_zscore FROM events"
    for c in COLS]))
def anomaly_zscore_stats(spark, sf):
    return A.zscore_stats(_ev(spark, sf), COLS)


def _mz(c):
    med = f"(SELECT quantile_cont({d(c)}, 0.5) FROM events)"
    mad = f"(SELECT quantile_cont(abs({d(c)} - {med}), 0.5) FROM events)"
    return f"abs(0.6745 * ({d(c)} - {med}) / NULLIF({mad}, 0))"


@query("anomaly_mad", sql=f"""
SELECT event_id, user_id, value, round(greatest({_mz('value')}, {_mz('user_id')}), 4) AS max_modified_z,
       coalesce({_mz('value')} > 3.5, false) OR coalesce({_mz('user_id')} > 3.5, false) AS is_anomaly FROM events""")
def anomaly_mad(spark, sf):
    return rounded(A.mad_flags(_ev(spark, sf), COLS))


def _fence(c):
    q1, q3 = f"(SELECT quantile_cont({d(c)}, 0.25) FROM events)", f"(SELECT quantile_cont({d(c)}, 0.75) FROM events)"
    return f"{q1} - 1.5 * ({q3} - {q1})", f"{q3} + 1.5 * ({q3} - {q1})"


@query("anomaly_iqr", sql="SELECT event_id, user_id, value, " + " OR ".join(
    f"coalesce({d(c)} < {_fence(c)[0]} OR {d(c)} > {_fence(c)[1]}, false)" for c in COLS) + " AS is_anomaly FROM events")
def anomaly_iqr(spark, sf):
    return A.iqr_flags(_ev(spark, sf), COLS)


@query("anomaly_iqr_bounds", sql=union_all([
    f"SELECT '{c}' AS column_name, round({_fence(c)[0]}, 4) AS lower_bound, round({_fence(c)[1]}, 4) AS upper_bound, "
    f"count(*) FILTER (WHERE {d(c)} < {_fence(c)[0]} OR {d(c)} > {_fence(c)[1]}) AS outlier_count FROM events" for c in COLS]))
def anomaly_iqr_bounds(spark, sf):
    return A.iqr_bounds(_ev(spark, sf), COLS)


@query("anomaly_consensus", sql=f"""
WITH f AS (SELECT event_id,
  CAST(coalesce({_Z.format(c=d('value'))} > 3, false) OR coalesce({_Z.format(c=d('user_id'))} > 3, false) AS INTEGER) AS a,
  CAST(coalesce({_mz('value')} > 3.5, false) OR coalesce({_mz('user_id')} > 3.5, false) AS INTEGER) AS b,
  CAST({" OR ".join(f"coalesce({d(c)} < {_fence(c)[0]} OR {d(c)} > {_fence(c)[1]}, false)" for c in COLS)} AS INTEGER) AS c
  FROM events)
SELECT event_id, CAST(a + b + c AS BIGINT) AS votes, (a + b + c) * 2 >= 3 AS is_anomaly FROM f""")
def anomaly_consensus(spark, sf):
    ev = _ev(spark, sf)
    return A.consensus({"zscore": A.zscore_flags(ev, COLS), "mad": A.mad_flags(ev, COLS),
                        "iqr": A.iqr_flags(ev, COLS)}, ["event_id"])

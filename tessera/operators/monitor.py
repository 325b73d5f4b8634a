"""Drift tests, metric degradation, alert rules and serving statistics.

Statistics are aggregates; the p-value of one statistic is a scalar function
evaluated on the driver (numbers only, no rows).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_prefix_sums
from ..functions.stats import as_double, numeric_columns, rnd, round_half_away as rh, string_columns


# ---------------------------------------------------------------- distributions
def kolmogorov_sf(d: float, n1: int, n2: int) -> float:
    """Asymptotic two-sample KS p-value: Q_KS((sqrt(en) + 0.12 + 0.11/sqrt(en)) * d)."""
    if n1 == 0 or n2 == 0:
        return float("nan")
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(max(s, 0.0), 1.0)


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: regularised gamma Q(dof/2, x/2)."""
    if dof <= 0:
        return float("nan")
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for P, then Q = 1 - P
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1
            term *= z / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    # continued fraction for Q (Lentz)
    b, c, dd = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = dd
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        dd = an * dd + b
        dd = 1e-300 if abs(dd) < 1e-300 else dd
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        dd = 1 / dd
        delta = dd * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


# ---------------------------------------------------------------- drift
NUMERIC_COUNTS, TEXT_COUNTS = "feature string, v double, n long", "feature string, v string, n long"


def feature_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(feature, v, n): rows of each value of each column as ``kind`` (double or string), nulls left out. Counts of parts add up to those of the whole."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"feature string, v {kind}, n long")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("v")) for c in columns])
    return (df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull())
            .groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")))


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """{column: (count, mean, std with ddof 0)} in one pass."""
    if not columns:
        return {}
    x = [as_double(c) for c in columns]
    row = df.agg(*[e for i, v in enumerate(x) for e in (F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]).first()
    return {c: (row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def _both(baseline: DataFrame, current: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (baseline.select("feature", "v", F.col("n").alias("a"), zero.alias("b"))
            .unionByName(current.select("feature", "v", zero.alias("a"), F.col("n").alias("b")))
            .groupBy("feature", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))


def ks_from_counts(baseline: DataFrame, current: DataFrame, base: dict, cur: dict, threshold: float = 0.05) -> DataFrame:
    """O1 from value counts and moments of both sides: all columns in one grouped pass and one pass of running sums."""
    cols = [c for c in base if base[c][0] >= 2 and cur.get(c, (0,))[0] >= 2]
    spark = baseline.sparkSession
    schema = ("feature string, method string, statistic double, p_value double, is_drifted boolean, "
              "baseline_mean double, baseline_std double, current_mean double, current_std double")
    if not cols:
        return spark.createDataFrame([], schema)
    cum = global_prefix_sums(_both(baseline, current).where(F.col("feature").isin(cols)), [F.col("v").asc()],
                             {"ca": F.col("a"), "cb": F.col("b")}, partition_by=["feature"])
    gap = F.lit(None).cast("double")
    for c in cols:
        gap = F.when(F.col("feature") == c, F.abs(F.col("ca") / F.lit(float(base[c][0])) - F.col("cb") / F.lit(float(cur[c][0])))).otherwise(gap)
    found = {r.feature: r.d for r in cum.groupBy("feature").agg(F.max(gap).alias("d")).collect()}  # one row for each column
    rows = []
    for c in cols:
        p = kolmogorov_sf(found[c], base[c][0], cur[c][0])
        rows.append((c, "ks_test", rh(found[c]), rh(p), p < threshold, rh(base[c][1]), rh(base[c][2]), rh(cur[c][1]), rh(cur[c][2])))
    return spark.createDataFrame(rows, schema)


def chi2_from_counts(baseline: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """O2 from value counts: all columns in one grouped pass."""
    g = _both(baseline, current).withColumn("e", F.when(F.col("a") > 0, F.col("a")).otherwise(1))
    totals = g.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("b").alias("to"), F.count(F.lit(1)).alias("k"), F.sum("a").alias("n1"))
    e = F.col("e") * F.col("to") / F.col("te")
    stats = (g.join(totals.where((F.col("n1") >= 2) & (F.col("to") >= 2)), "feature").groupBy("feature")
             .agg(F.sum((F.col("b") - e) * (F.col("b") - e) / e).alias("stat"), F.max("k").alias("k")).collect())  # one row for each column
    rows = []
    for r in sorted(stats, key=lambda r: r.feature):
        p = chi2_sf(r.stat, r.k - 1)
        rows.append((r.feature, "chi_square", rh(r.stat), r.k - 1, rh(p), p < threshold))
    return baseline.sparkSession.createDataFrame(
        rows, "feature string, method string, statistic double, dof long, p_value double, is_drifted boolean")


def drift_ks(baseline: DataFrame, current: DataFrame, columns: list[str] | None = None,
             threshold: float = 0.05, new_data_null_policy: str = "any") -> DataFrame:
    """O1: two-sample KS statistic, p-value and baseline / current mean and std (ddof 0) per column.

    Rows are reduced to one row per distinct value before the running sums, so
    ties count together (the empirical CDFs jump at each distinct value).
    """
    cols = columns or numeric_columns(baseline)
    if new_data_null_policy == "any":
        current = current.na.drop(how="any")
    return ks_from_counts(feature_counts(baseline, cols, "double"), feature_counts(current, cols, "double"),
                          moments(baseline, cols), moments(current, cols), threshold)


def drift_chi2(baseline: DataFrame, current: DataFrame, columns: list[str] | None = None,
               threshold: float = 0.05, new_data_null_policy: str = "any") -> DataFrame:
    """O2: chi-square of current category counts against baseline counts rescaled to the current total.

    A category unseen in the baseline gets expected count 1 before rescaling; dof = k - 1.
    """
    cols = columns or string_columns(baseline)
    if new_data_null_policy == "any":
        current = current.na.drop(how="any")
    return chi2_from_counts(feature_counts(baseline, cols, "string"), feature_counts(current, cols, "string"), threshold)


def drift_report(baseline: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """O3: KS and chi-square rows plus a summary row (drifted count and %)."""
    ks = drift_ks(baseline, current, threshold=threshold).select("feature", "method", "statistic", "p_value", "is_drifted")
    ch = drift_chi2(baseline, current, threshold=threshold).select("feature", "method", "statistic", "p_value", "is_drifted")
    return _with_summary(ks.unionByName(ch))


def _with_summary(det: DataFrame) -> DataFrame:
    summ = det.agg(F.lit("__summary__").alias("feature"), F.lit("summary").alias("method"),
                   F.count_if("is_drifted").cast("double").alias("statistic"),
                   rnd(F.count_if("is_drifted") * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("p_value"),
                   (F.count_if("is_drifted") > 0).alias("is_drifted"))
    return det.unionByName(summ)


class DriftBaseline:
    """Baseline of a drift monitor: value counts of its columns, written once, and their moments."""

    def __init__(self, df: DataFrame, folder: str, numeric: list[str] | None = None, categorical: list[str] | None = None):
        self.numeric = numeric_columns(df) if numeric is None else numeric
        self.categorical = string_columns(df) if categorical is None else categorical
        self.folder, self.spark = folder, df.sparkSession
        feature_counts(df, self.numeric, "double").write.mode("overwrite").parquet(f"{folder}/numeric")
        feature_counts(df, self.categorical, "string").write.mode("overwrite").parquet(f"{folder}/text")
        self.moments = moments(df, self.numeric)

    def report(self, current: DataFrame, threshold: float = 0.05) -> DataFrame:
        """O3 of ``current`` against the baseline, which is not read again."""
        current = current.na.drop(how="any")
        read = self.spark.read
        ks = ks_from_counts(read.schema(NUMERIC_COUNTS).parquet(f"{self.folder}/numeric"), feature_counts(current, self.numeric, "double"),
                            self.moments, moments(current, self.numeric), threshold)
        chi = chi2_from_counts(read.schema(TEXT_COUNTS).parquet(f"{self.folder}/text"), feature_counts(current, self.categorical, "string"), threshold)
        names = ["feature", "method", "statistic", "p_value", "is_drifted"]
        return _with_summary(ks.select(*names).unionByName(chi.select(*names)))


# ---------------------------------------------------------------- performance
def perf_degradation(baseline: DataFrame, current: DataFrame, threshold_pct: float = 5.0,
                     higher_is_better: dict[str, bool] | None = None) -> DataFrame:
    """Join (metric, value) tables by name; degradation % relative to baseline; flag > threshold."""
    hib = higher_is_better or {}
    sign = F.lit(1.0)
    for m, up in hib.items():
        sign = F.when(F.col("metric") == m, F.lit(1.0 if up else -1.0)).otherwise(sign)
    j = current.alias("c").join(baseline.alias("b"), "metric", "left")
    bv = F.coalesce(F.col("b.value"), F.lit(0.0))
    deg = F.when(bv == 0, F.lit(0.0)).otherwise(rnd(sign * (bv - F.col("c.value")) / bv * 100.0, 2))
    return j.select("metric", rnd("c.value", 4).alias("metric_value"), rnd(bv, 4).alias("baseline_value"),
                    deg.alias("degradation_pct"), (deg > threshold_pct).alias("is_degraded"))


def prediction_summary(df: DataFrame, prediction: str, actual: str | None = None) -> DataFrame:
    """Mean / std (ddof 0) / min / max / distinct of predictions (and actuals)."""
    from .profile import long_agg
    cols = [prediction] + ([actual] if actual else [])
    spec = {c: {"mean": rnd(F.avg(as_double(c)), 4), "std": rnd(F.stddev_pop(as_double(c)), 4),
                "min": rnd(F.min(as_double(c)), 4), "max": rnd(F.max(as_double(c)), 4),
                "n": F.count(F.col(c))} for c in cols}
    from .profile import distinct_counts
    return long_agg(df, spec).join(distinct_counts(df, cols), "column_name")


# ---------------------------------------------------------------- alert rules
OPS = (">", "<", ">=", "<=", "==", "!=")
TOL = 1e-6  # fixed value: equality tolerance of rule thresholds


def rule_condition(value, op, threshold):
    return (F.when(op == ">", value > threshold).when(op == "<", value < threshold)
            .when(op == ">=", value >= threshold).when(op == "<=", value <= threshold)
            .when(op == "==", F.abs(value - threshold) < TOL).when(op == "!=", F.abs(value - threshold) >= TOL)
            .otherwise(F.lit(False)))


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric rows) x (enabled rules of that metric) where the rule condition holds.

    ``metrics`` has (metric_name, metric_value[, other keys]); ``rules`` is a small
    user table (rule_id, name, metric_name, operator, threshold, severity, enabled).
    """
    r = rules.where(F.col("enabled"))
    j = metrics.join(r, "metric_name")
    return j.where(rule_condition(F.col("metric_value"), F.col("operator"), F.col("threshold")))


def alert_history(alert_rows: DataFrame, status: str | None = None, limit: int = 50,
                  time_col: str = "alert_time") -> DataFrame:
    """Filter by status, newest first, at most ``limit`` rows (a top-k)."""
    a = alert_rows if status is None else alert_rows.where(F.col("status") == status)
    return a.orderBy(F.desc(time_col), *[F.asc(c) for c in a.columns if c != time_col]).limit(limit)


def alert_summary(alert_rows: DataFrame) -> DataFrame:
    """Counts by status and severity (long form)."""
    by_status = alert_rows.groupBy(F.lit("status").alias("dimension"), F.col("status").alias("value")).count()
    by_sev = alert_rows.groupBy(F.lit("severity").alias("dimension"), F.col("severity").alias("value")).count()
    total = alert_rows.agg(F.lit("total").alias("dimension"), F.lit("all").alias("value"), F.count(F.lit(1)).alias("count"))
    return by_status.unionByName(by_sev).unionByName(total)


# ---------------------------------------------------------------- serving
def serving_stats(log: DataFrame, ts: str, latency: str, confidence: str, reference_time: str,
                  days: int = 7) -> DataFrame:
    """Prediction count, mean latency / confidence, first / last time, latency p50 / p95 / p99
    over the ``days`` before ``reference_time`` (passed in for determinism)."""
    ref = F.to_timestamp(F.lit(reference_time))
    w = log.where((F.col(ts) >= ref - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= ref))
    lat = as_double(latency)
    return w.agg(F.count(F.lit(1)).alias("n_predictions"), rnd(F.avg(lat), 4).alias("avg_latency"),
                 rnd(F.avg(as_double(confidence)), 4).alias("avg_confidence"),
                 F.min(ts).alias("first_prediction"), F.max(ts).alias("last_prediction"),
                 *[rnd(F.percentile(lat, p), 4).alias(f"p{int(p * 100)}_latency") for p in (0.5, 0.95, 0.99)])


def recent_predictions(log: DataFrame, ts: str, n: int = 20, tie: list[str] | None = None) -> DataFrame:
    """The ``n`` newest rows (a top-k report)."""
    return log.orderBy(F.desc(ts), *[F.asc(c) for c in (tie or [])]).limit(n)

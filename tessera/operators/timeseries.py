"""Time series keyed by ``series_key``: detection, frequency, regularisation, fills,
summary, rolling trend, autocorrelation, classical decomposition, lag features.

Scale notes: raw rows are only touched by aggregates and by equi-joins on a
range-partitioned row number (frequency inference). Windows run after the data
is bucketed to the series frequency, so their size is (#series x #buckets),
bounded by the time span, not by the number of raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.stats import as_double, rnd, sample_kurtosis, sample_skew

# fixed values: frequency code -> (date_trunc unit, spine step)
FREQ = {"h": ("hour", "INTERVAL 1 HOUR"), "D": ("day", "INTERVAL 1 DAY"),
        "W": ("week", "INTERVAL 7 DAYS"), "MS": ("month", "INTERVAL 1 MONTH")}


def _keys(key):
    return [key] if isinstance(key, str) else list(key or [])


# ---------------------------------------------------------------- detection
def detect_datetime(df: DataFrame, share: float = 0.8) -> DataFrame:
    """TS1: per column: native timestamp, text parseable as timestamps (>= 80 %), or unix seconds range."""
    from .profile import long_agg
    spec = {}
    for f in df.schema.fields:
        c, t = f.name, f.dataType.simpleString()
        if t.startswith("timestamp") or t == "date":
            spec[c] = {"kind": F.lit("native"), "rate": F.lit(1.0)}
        elif t == "string":
            rate = F.count_if(F.try_to_timestamp(F.col(c)).isNotNull()) / F.greatest(F.count(F.col(c)), F.lit(1))
            spec[c] = {"kind": F.when(rate >= share, "parsed"), "rate": rate}
        elif t in ("int", "bigint", "double", "float"):
            x = as_double(c)
            ok = (F.min(x) > 9.46e8) & (F.max(x) < 2.21e9)
            spec[c] = {"kind": F.when(ok, "unix"), "rate": F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0))}
    out = long_agg(df, spec)
    return out.where(F.col("kind").isNotNull()).select("column_name", "kind", rnd("rate", 4).alias("parse_rate"))


def infer_frequency(df: DataFrame, ts: str, key=None) -> DataFrame:
    """TS2: median gap between consecutive timestamps per series -> h / D / W / MS."""
    keys = _keys(key)
    base = df.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t"))
    rn = global_row_number(base, [F.col(k) for k in keys] + [F.col("_t")], "_rn")
    nxt = rn.select(*[F.col(k).alias(f"_n_{k}") for k in keys], (F.col("_rn") - 1).alias("_rn"), F.col("_t").alias("_t2"))
    cond = [rn["_rn"] == nxt["_rn"]] + [rn[k] == nxt[f"_n_{k}"] for k in keys]
    gaps = rn.join(nxt, cond).select(*[rn[k] for k in keys],
                                     (F.unix_micros(nxt["_t2"].cast("timestamp")) - F.unix_micros(rn["_t"].cast("timestamp")))
                                     .alias("_us"))
    med = gaps.groupBy(*keys).agg((F.percentile("_us", 0.5) / 1e6).alias("median_gap_seconds"))
    code = (F.when(F.col("median_gap_seconds") <= 3600, "h").when(F.col("median_gap_seconds") <= 86400, "D")
            .when(F.col("median_gap_seconds") <= 7 * 86400, "W").otherwise("MS"))
    return med.select(*keys, rnd("median_gap_seconds", 4).alias("median_gap_seconds"), code.alias("freq"))


# ---------------------------------------------------------------- regularisation and fills
def bucket(df: DataFrame, ts: str, value: str, freq: str, key=None, agg: str = "mean") -> DataFrame:
    """(key, ts, value) with timestamps truncated to the frequency and duplicates aggregated."""
    keys = _keys(key)
    unit, _ = FREQ[freq]
    fn = {"mean": F.avg, "sum": F.sum, "last": F.max, "count": F.count, "min": F.min, "max": F.max}[agg]
    return (df.where(F.col(ts).isNotNull())
            .groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ts"))
            .agg(fn(as_double(value) if agg != "count" else F.col(value)).cast("double").alias("value")))


def spine(b: DataFrame, freq: str, key=None) -> DataFrame:
    """Every bucket between each series' first and last bucket (generated per series, in parallel)."""
    keys = _keys(key)
    _, step = FREQ[freq]
    rng = b.groupBy(*keys).agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    return rng.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias("ts"))


def fill_series(s: DataFrame, method: str, key=None) -> DataFrame:
    """TS4 / TS5: ffill, bfill, zero or linear-in-time interpolation over (key, ts, value)."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("ts")
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    future = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.col("value")
    if method == "ffill":
        e = F.last(v, True).over(past)
    elif method == "bfill":
        e = F.first(v, True).over(future)
    elif method == "zero":
        e = F.coalesce(v, F.lit(0.0))
    elif method == "interpolate":
        known = F.when(v.isNotNull(), F.struct(F.col("ts").alias("t"), v.alias("v")))
        prev, nxt = F.last(known, True).over(past), F.first(known, True).over(future)
        sec = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
        frac = F.try_divide(sec(F.col("ts")) - sec(prev["t"]), sec(nxt["t"]) - sec(prev["t"]))
        e = (F.when(v.isNotNull(), v).when(prev.isNull(), F.lit(None))
             .when(nxt.isNull(), prev["v"]).otherwise(prev["v"] + (nxt["v"] - prev["v"]) * frac))
    elif method == "none":
        e = v
    else:
        raise ValueError(f"unknown fill method {method!r}")
    return s.select(*keys, "ts", e.alias("value"))


def regularize(df: DataFrame, ts: str, value: str, freq: str = "D", key=None, agg: str = "mean",
               fill: str = "ffill") -> DataFrame:
    """TS3: bucket, complete the grid of buckets per series, fill, drop what stays empty."""
    keys = _keys(key)
    b = bucket(df, ts, value, freq, keys, agg)
    grid = spine(b, freq, keys).join(b, keys + ["ts"], "left")
    return fill_series(grid, fill, keys).where(F.col("value").isNotNull())


# ---------------------------------------------------------------- summaries
def ts_summary(s: DataFrame, key=None) -> DataFrame:
    """TS6 + TS7 trend: count, mean, std, min, max, median, skew, kurtosis, span, and whether the
    first vs last rolling mean / std (window max(n // 10, 2)) goes up."""
    keys = _keys(key)
    s = s.where(F.col("value").isNotNull())
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    win = F.greatest(F.floor(n / 10), F.lit(2))
    r_up = F.row_number().over(w.orderBy("ts"))
    r_dn = F.row_number().over(w.orderBy(F.desc("ts")))
    t = s.select(*keys, "ts", "value", n.alias("_n"), win.alias("_w"), r_up.alias("_ru"), r_dn.alias("_rd"))
    head, tail = F.col("_ru") <= F.col("_w"), F.col("_rd") <= F.col("_w")
    g = t.groupBy(*keys).agg(
        F.count("value").alias("count"), rnd(F.avg("value"), 4).alias("mean"), rnd(F.stddev_samp("value"), 4).alias("std"),
        rnd(F.min("value"), 4).alias("min"), rnd(F.max("value"), 4).alias("max"),
        rnd(F.percentile("value", 0.5), 4).alias("median"), rnd(sample_skew("value"), 4).alias("skewness"),
        rnd(sample_kurtosis("value"), 4).alias("kurtosis"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.max("_w").alias("rolling_window"),
        F.avg(F.when(head, F.col("value"))).alias("_m0"), F.avg(F.when(tail, F.col("value"))).alias("_m1"),
        F.stddev_samp(F.when(head, F.col("value"))).alias("_s0"), F.stddev_samp(F.when(tail, F.col("value"))).alias("_s1"))
    up = lambda a, b: F.when(F.col("count") >= 10, F.when(F.col(b) > F.col(a), "increasing").otherwise("decreasing"))
    return g.select(*keys, "count", "mean", "std", "min", "max", "median", "skewness", "kurtosis", "start", "end",
                    F.when(F.col("count") >= 10, F.col("rolling_window")).alias("rolling_window"),
                    up("_m0", "_m1").alias("rolling_mean_trend"), up("_s0", "_s1").alias("rolling_std_trend"))


def rolling(s: DataFrame, window: int, key=None) -> DataFrame:
    """TS7: rolling mean / std (ddof 1) over the last ``window`` rows, NULL until the window is full."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("ts")
    frame = w.rowsBetween(-(window - 1), 0)
    full = F.row_number().over(w) >= window
    return s.select(*keys, "ts", "value", rnd(F.when(full, F.avg("value").over(frame)), 4).alias("rolling_mean"),
                    rnd(F.when(full, F.stddev_samp("value").over(frame)), 4).alias("rolling_std"))


def acf(s: DataFrame, nlags: int = 40, key=None) -> DataFrame:
    """TS8: biased autocorrelation r_k = sum (x_t - m)(x_t+k - m) / sum (x_t - m)^2 for k = 0..L,
    L = min(nlags, n // 2 - 1); lagged pairs come from an equi-join on (key, position)."""
    return autocorrelations(s, nlags, key).select(*_keys(key), "lag", rnd("r", 4).alias("acf"))


def autocorrelations(s: DataFrame, nlags: int, key=None) -> DataFrame:
    """(key.., lag, r), not rounded."""
    keys = _keys(key)
    single = not keys
    if single:  # one series: give it a constant key so every join below stays an equi-join on it
        keys, s = ["_series"], s.withColumn("_series", F.lit(0))
    s = s.where(F.col("value").isNotNull())
    w = Window.partitionBy(*keys)
    pos = s.select(*keys, (F.row_number().over(w.orderBy("ts")) - 1).alias("_i"),
                   (F.col("value") - F.avg("value").over(w)).alias("_d"),
                   F.least(F.lit(nlags), F.floor(F.count(F.lit(1)).over(w) / 2) - 1).alias("_L"))
    den = pos.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_d")).alias("_c0"), F.max("_L").alias("_L"))
    lagged = pos.select(*keys, "_d", "_i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_L"), F.lit(0)))).alias("_k"))
    later = pos.select(*keys, F.col("_i").alias("_j"), F.col("_d").alias("_d2"))
    prod = lagged.join(later, [*[lagged[k] == later[k] for k in keys], lagged["_i"] + lagged["_k"] == later["_j"]])
    num = prod.groupBy(*[lagged[k] for k in keys], "_k").agg(F.sum(F.col("_d") * F.col("_d2")).alias("_ck"))
    out = (num.join(den, keys).where(F.col("_k") <= F.col("_L"))
           .select(*keys, F.col("_k").alias("lag"), F.try_divide(F.col("_ck"), F.col("_c0")).alias("r")))
    return out.drop("_series") if single else out


def decompose(s: DataFrame, period: int, model: str = "additive", key=None) -> DataFrame:
    """TS10: classical decomposition: centred moving average trend (2 x MA for even periods),
    seasonal = phase means of the detrended series centred to 0 (additive) or 1 (multiplicative)."""
    keys = _keys(key)
    s = s.where(F.col("value").isNotNull())
    w = Window.partitionBy(*keys).orderBy("ts")
    h = period // 2
    n_all = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(w) - 1
    if period % 2:
        ma = F.avg("value").over(w.rowsBetween(-h, h))
    else:
        inner = F.sum("value").over(w.rowsBetween(-h, h))
        ends = F.lag("value", h).over(w) + F.lead("value", h).over(w)
        ma = (inner - 0.5 * ends) / period
    t = s.select(*keys, "ts", "value", i.alias("_i"), n_all.alias("_n"))
    t = t.withColumn("trend", F.when((F.col("_i") >= h) & (F.col("_i") < F.col("_n") - h), ma))
    mult = model.startswith("mult")
    det = (F.col("value") / F.col("trend")) if mult else (F.col("value") - F.col("trend"))
    t = t.withColumn("_phase", F.pmod(F.col("_i"), F.lit(period))).withColumn("_det", det)
    ph = t.groupBy(*keys, "_phase").agg(F.avg("_det").alias("_pm"))
    wk = Window.partitionBy(*keys)
    ph = ph.withColumn("seasonal", (F.col("_pm") / F.avg("_pm").over(wk)) if mult else (F.col("_pm") - F.avg("_pm").over(wk)))
    out = t.join(ph.select(*keys, "_phase", "seasonal"), keys + ["_phase"])
    resid = (F.col("value") / (F.col("trend") * F.col("seasonal"))) if mult else (F.col("value") - F.col("trend") - F.col("seasonal"))
    return out.select(*keys, "ts", rnd("value", 4).alias("observed"), rnd("trend", 4).alias("trend"),
                      rnd("seasonal", 4).alias("seasonal"), rnd(resid, 4).alias("resid"))


def lag_features(s: DataFrame, n_lags: int = 3, key=None) -> DataFrame:
    """TS14: y, lag_1..lag_n and calendar parts; rows without a full set of lags are dropped."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy("ts")
    lags = [F.lag("value", k).over(w).alias(f"lag_{k}") for k in range(1, n_lags + 1)]
    out = s.select(*keys, "ts", F.col("value").alias("y"), *lags,
                   F.weekday("ts").alias("dayofweek"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"),
                   F.quarter("ts").alias("quarter"))
    return out.na.drop(subset=["y"] + [f"lag_{k}" for k in range(1, n_lags + 1)])


def best_model(errors: DataFrame, key=None) -> DataFrame:
    """TS19: lowest-MAE model per series from (key, model, mae) rows."""
    keys = _keys(key)
    return errors.groupBy(*keys).agg(F.min_by(F.struct("model", "mae"), F.struct("mae", "model")).alias("b")) \
        .select(*keys, "b.model", "b.mae")


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)


# Critical values of the KPSS statistic for a constant level.
KPSS_CRITICAL = {"10%": 0.347, "5%": 0.463, "2.5%": 0.574, "1%": 0.739}


def kpss(s: DataFrame, lags: int | None = None) -> DataFrame:
    """TS12: KPSS statistic of one series (ts, value) for a constant level, with the lag number chosen from the data.

    Residuals are numbered and summed up over several ranges; autocovariances are a join of the numbered rows
    with themselves at each lag, so nothing needs the whole series in one task.
    """
    from ..functions.ranking import global_prefix_sums
    mean, n = s.agg(F.avg("value"), F.count("value")).first()
    if not n:
        raise ValueError("the series has no values")
    r = s.where(F.col("value").isNotNull()).select("ts", (F.col("value") - F.lit(mean)).alias("e"))
    run = global_prefix_sums(r, [F.col("ts")], {"i": F.lit(1), "c": F.col("e")})
    eta, var = run.agg(F.sum(F.col("c") * F.col("c")) / F.lit(float(n) ** 2), F.sum(F.col("e") * F.col("e"))).first()

    def products(most: int) -> dict[int, float]:
        if most < 1:
            return {}
        ahead = run.select(F.col("e").alias("e2"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag"), F.col("i").alias("j"))
        pairs = ahead.withColumn("i", F.col("j") - F.col("lag")).join(run.select("i", "e"), "i")
        return {x.lag: x.p for x in pairs.groupBy("lag").agg(F.sum(F.col("e") * F.col("e2")).alias("p")).collect()}

    if lags is None:
        short = products(int(n ** (2 / 9)))
        s0 = var / n + sum(p / (n / 2) for p in short.values())
        s1 = sum(k * p / (n / 2) for k, p in short.items())
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    longrun = (var + 2 * sum((1 - k / (lags + 1)) * p for k, p in products(lags).items())) / n
    stat = eta / longrun if longrun else None
    out = s.sparkSession.createDataFrame([(stat, lags, n)], "statistic double, lags_used long, n_obs long")
    return out.select(rnd("statistic", 4).alias("statistic"), "lags_used", "n_obs",
                      (F.col("statistic") < KPSS_CRITICAL["5%"]).alias("is_stationary"))


def stationarity_verdict(adf_stationary, kpss_stationary):
    """TS13: the verdict from the two tests' flags (columns)."""
    a, k = F.coalesce(adf_stationary.cast("int"), F.lit(-1)), F.coalesce(kpss_stationary.cast("int"), F.lit(-1))
    return (F.when((a == 1) & (k == 1), "stationary").when((a == 0) & (k == 0), "non_stationary")
            .when((a == 1) & (k == 0), "trend_stationary").when((a == 0) & (k == 1), "difference_stationary").otherwise("inconclusive"))

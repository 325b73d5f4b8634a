"""Partial autocorrelation, unit-root test, and forecasts of many series at once.

Series are rows (key.., ts, value) on a regular grid of buckets, as ``timeseries.regularize`` makes them. Fits are global: one
design matrix for all series whose normal equations are summed up by key in partial aggregates, or one model on the lag
frames of all series. What is solved or rolled forward afterwards is a table of one small row for each series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.stats import rnd
from ..session import ensure_checkpoint_dir
from .timeseries import FREQ, _keys, best_model, lag_features

# Response surface of the Dickey-Fuller critical values with a constant, by 1 / n to the powers 0, 1, 2, 3.
ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040),
                "10%": (-2.56677, -1.5384, -2.809, 0.0)}
DAY = 86400.0


# ---------------------------------------------------------------- PACF
def _levinson(r: Column) -> Column:
    """Partial autocorrelations at 0..L from autocorrelations r[0..L], by the Durbin-Levinson recursion as a fold."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state, k):
        phi = state["phi"]
        last = F.try_divide(F.get(r, k) - dot(phi, F.reverse(F.slice(r, F.lit(2), k - 1))), F.lit(1.0) - dot(phi, F.slice(r, F.lit(2), k - 1)))
        rest = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(F.concat(rest, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step, lambda s: s["out"])


def pacf(s: DataFrame, nlags: int = 40, key=None) -> DataFrame:
    """TS9: partial autocorrelation (Yule-Walker on biased autocorrelations) for lags 0..L, L = min(nlags, n // 2 - 1) as for ``acf``."""
    from .timeseries import autocorrelations
    keys = _keys(key)
    r = autocorrelations(s, nlags, keys)
    listed = r.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "r"))), lambda x: x["r"]).alias("r"))  # L + 1 entries a series
    out = listed.where(F.size("r") > 1).select(*keys, F.posexplode(_levinson(F.col("r"))).alias("lag", "p"))
    return out.select(*keys, "lag", rnd("p", 4).alias("pacf"))


# ---------------------------------------------------------------- ADF
def _cross_products(rows: DataFrame, lags: int, block: int = 1 << 16) -> tuple[np.ndarray, int]:
    """Gram matrix of (difference, level before, ``lags`` earlier differences, 1) over all t that have them, and their number.

    ``rows`` is (i, v), numbered from 1. A block of rows gets the ``lags + 2`` rows before it too, so no window crosses blocks.
    """
    width = lags + 3
    own = F.floor((F.col("i") - 1) / block)
    reach = F.floor((F.col("i") + lags) / block)
    spread = rows.select("i", "v", F.explode(F.sequence(own, F.greatest(own, reach))).alias("b"))

    def products(key, part):
        part = part.sort_values("i")
        i, v = part["i"].to_numpy(), part["v"].to_numpy()
        d = np.diff(v)
        at = np.arange(lags, len(d))
        at = at[i[at + 1] > key[0] * block]
        x = np.column_stack([d[at], v[at], *[d[at - k] for k in range(1, lags + 1)], np.ones(len(at))])
        gram = x.T @ x
        j, k = np.indices(gram.shape).reshape(2, -1)
        return pd.DataFrame({"j": j, "k": k, "g": gram.ravel()})

    out = np.zeros((width, width))
    for r in spread.groupBy("b").applyInPandas(products, "j int, k int, g double").groupBy("j", "k").agg(F.sum("g").alias("g")).collect():
        out[r.j, r.k] = r.g
    return out, round(out[-1, -1])


def _least_squares(gram: np.ndarray, lags: int) -> tuple[float, float]:
    """t-ratio of the level before, and the residual sum of squares, with the first ``lags`` differences."""
    take = [1, *range(2, 2 + lags), len(gram) - 1]
    xx, xy, n = gram[np.ix_(take, take)], gram[take, 0], gram[-1, -1]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    rss = max(gram[0, 0] - beta @ xy, 0.0)
    variance = rss / (n - len(take)) * inverse[0, 0] if n > len(take) else 0.0
    return (beta[0] / math.sqrt(variance) if variance > 0 else math.nan), rss


def adf(s: DataFrame, lags: int | None = None) -> DataFrame:
    """TS11: augmented Dickey-Fuller test of one series (ts, value) with a constant; ``lags`` by AIC up to 12 (n / 100)^(1/4) if not given.

    All regressions come from one Gram matrix of lagged differences, summed up over blocks of the numbered series.
    """
    ensure_checkpoint_dir(s.sparkSession)
    x = s.where(F.col("value").isNotNull()).select("ts", F.col("value").cast("double").alias("v"))
    n, mean, std = x.agg(F.count(F.lit(1)), F.avg("v"), F.stddev_pop("v")).first()
    schema = "statistic double, lags_used long, n_obs long, critical_1 double, critical_5 double, critical_10 double, is_stationary boolean"
    if n < 4 or not std:
        return s.sparkSession.createDataFrame([(None, 0, n, None, None, None, None)], schema)
    rows = global_row_number(x.select("ts", ((F.col("v") - mean) / std).alias("v")), [F.col("ts")], "i").select("i", "v").checkpoint()
    if lags is None:
        most = max(min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2), 0)
        gram, m = _cross_products(rows, most)
        aic = [m * math.log(max(_least_squares(gram, k)[1], 1e-300) / m) + 2 * (k + 2) for k in range(most + 1)]
        lags = aic.index(min(aic))
    gram, m = _cross_products(rows, lags)
    stat, _ = _least_squares(gram, lags)
    critical = [sum(c / m ** p for p, c in enumerate(ADF_CRITICAL[level])) for level in ("1%", "5%", "10%")]
    flag = None if math.isnan(stat) else bool(stat < critical[1])
    out = s.sparkSession.createDataFrame([(None if flag is None else float(stat), lags, m, *critical, flag)], schema)
    return out.select(*[rnd(f, 4).alias(f) if f.startswith(("stat", "crit")) else F.col(f) for f in out.columns])


def stationarity(s: DataFrame) -> DataFrame:
    """TS13: both tests on the series, and the verdict."""
    from .timeseries import kpss, stationarity_verdict
    a, k = adf(s).first(), kpss(s).first()
    out = s.sparkSession.createDataFrame([(a.statistic, a.lags_used, a.is_stationary, k.statistic, k.lags_used, k.is_stationary)],
                                         "adf double, adf_lags long, adf_stationary boolean, kpss double, kpss_lags long, kpss_stationary boolean")
    return out.withColumn("verdict", stationarity_verdict(F.col("adf_stationary"), F.col("kpss_stationary")))


# ---------------------------------------------------------------- trend and Fourier terms
def _design(changepoints: int, seasons: dict[float, int]) -> Column:
    """1, time, hinges over the first 80 % of the fitted span, and sine / cosine pairs; needs ts, lo and hi."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    t = (seconds("ts") - seconds("lo")) / F.greatest(seconds("hi") - seconds("lo"), F.lit(1.0))
    hinges = [F.greatest(t - 0.8 * (j + 1) / (changepoints + 1), F.lit(0.0)) for j in range(changepoints)]
    waves = [f(seconds("ts") * (2 * math.pi * k / period)) for period, order in seasons.items() for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return F.array(F.lit(1.0), t, *hinges, *waves)


def fourier_fit(s: DataFrame, key=None, changepoints: int = 8, seasons: dict[float, int] | None = None, ridge: float = 0.1) -> DataFrame:
    """TS18: (key.., lo, hi, n, coefficients, sigma) of a piecewise linear trend with Fourier seasons (periods in seconds -> order;
    a week with 3 by default). ``ridge`` shrinks the hinges, times the variance of the values, as a prior on changes of slope.

    Each task adds up the normal equations of the series it sees, batch by batch; they are summed up by key and entry, and solved one
    small system a row. A series of any length is no single task's work.
    """
    keys = _keys(key)
    if not keys:  # one series: a constant key keeps the joins below equi-joins
        return fourier_fit(s.withColumn("_series", F.lit(0)), "_series", changepoints, seasons, ridge)
    seasons = {7 * DAY: 3} if seasons is None else seasons
    p = 2 + changepoints + 2 * sum(seasons.values())
    x = s.where(F.col("value").isNotNull())
    span = x.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.avg("value").alias("mean"))
    span = span.withColumn("_k", F.to_json(F.struct(*keys))).withColumnsRenamed({k: f"_m_{k}" for k in keys})
    joined = x.join(span, [x[k].eqNullSafe(F.col(f"_m_{k}")) for k in keys])
    frame = joined.select("_k", _design(changepoints, seasons).alias("x"), (F.col("value") - F.col("mean")).alias("y"))

    def partial(batches):
        for batch in batches:
            features = np.column_stack([batch.column("x").flatten().to_numpy().reshape(batch.num_rows, p), batch.column("y").to_numpy()])
            codes, at = np.unique(batch.column("_k").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for j, name in enumerate(codes):
                rows = features[at == j]
                gram = (rows.T @ rows).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(gram)), pa.array(np.arange(len(gram)), pa.int32()), pa.array(gram)],
                                                 names=["_k", "at", "g"])

    summed = (frame.mapInArrow(partial, "_k string, at int, g double").groupBy("_k", "at").agg(F.sum("g").alias("g"))
              .groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "g"))), lambda e: e["g"]).alias("gram")))  # (p + 1)^2 entries a series
    shrunk = np.array([0.0, 0.0, *[ridge] * changepoints, *[0.0] * (p - 2 - changepoints)])

    def solve(batches):
        for batch in batches:
            beta, sigma = [], []
            for gram in batch.column("gram").to_pylist():
                g = np.array(gram).reshape(p + 1, p + 1)
                n = g[0, 0]
                xx, xy, yy = g[:p, :p], g[:p, p], g[p, p]
                b = np.linalg.pinv(xx + np.diag(shrunk) * n, hermitian=True) @ xy
                beta.append(b.tolist())
                sigma.append(math.sqrt(max(yy - 2 * b @ xy + b @ xx @ b, 0.0) / max(n - 1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(batch.column("n")), pa.array(beta, pa.list_(pa.float64())), pa.array(sigma)],
                                             names=["_k", "n", "beta", "sigma"])

    solved = summed.withColumn("n", F.get("gram", F.lit(0))).mapInArrow(solve, "_k string, n double, beta array<double>, sigma double")
    shifted = F.concat(F.array(F.get("beta", F.lit(0)) + F.col("mean")), F.slice("beta", 2, p - 1))
    return span.join(solved, "_k").select(*[F.col(f"_m_{k}").alias(k) for k in keys], "lo", "hi", F.col("n").cast("long").alias("n"), shifted.alias("coefficients"), "sigma")


def _fourier_values(rows: DataFrame, model: DataFrame, keys: list[str], changepoints: int, seasons: dict[float, int] | None) -> DataFrame:
    model = model.withColumnsRenamed({k: f"_m_{k}" for k in keys})
    joined = rows.join(model, [rows[k].eqNullSafe(F.col(f"_m_{k}")) for k in keys])
    features = _design(changepoints, {7 * DAY: 3} if seasons is None else seasons)
    return joined.withColumn("yhat", F.aggregate(F.zip_with(features, "coefficients", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))


def future(last: DataFrame, freq: str, steps: int, keys: list[str]) -> DataFrame:
    """(key.., step, ts): the ``steps`` buckets after each series' ``hi``."""
    step = F.expr(FREQ[freq][1])
    times = F.sequence(F.col("hi") + step, F.col("hi") + step * steps, step)
    return last.select(*keys, F.posexplode(times).alias("step", "ts")).withColumn("step", F.col("step") + 1)


def fourier_forecast(s: DataFrame, freq: str = "D", steps: int = 30, key=None, changepoints: int = 8, seasons: dict[float, int] | None = None,
                     ridge: float = 0.1, z: float = 1.96) -> DataFrame:
    """TS18: (key.., step, ts, yhat, lower, upper) for the ``steps`` buckets after each series."""
    keys = _keys(key)
    if not keys:
        return fourier_forecast(s.withColumn("_series", F.lit(0)), freq, steps, "_series", changepoints, seasons, ridge, z).drop("_series")
    model = fourier_fit(s, key, changepoints, seasons, ridge)
    out = _fourier_values(future(model, freq, steps, keys), model, keys, changepoints, seasons)
    return out.select(*keys, "step", "ts", rnd("yhat", 4).alias("yhat"), rnd(F.col("yhat") - z * F.col("sigma"), 4).alias("lower"),
                      rnd(F.col("yhat") + z * F.col("sigma"), 4).alias("upper"))


# ---------------------------------------------------------------- chronological split and errors
def chronological(s: DataFrame, test_ratio: float = 0.2, key=None) -> DataFrame:
    """Adds ``is_test``: the last ``test_ratio`` of the rows of each series."""
    keys = _keys(key)
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    return s.withColumn("is_test", F.row_number().over(w.orderBy("ts")) > F.floor(n * (1 - test_ratio) + 1e-9))


def forecast_errors(scored: DataFrame, key=None) -> DataFrame:
    """(key.., mae, rmse, r2, mape, n_test) from rows (key.., y, yhat)."""
    e = F.col("y") - F.col("yhat")
    return scored.groupBy(*_keys(key)).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"), F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(2.0 ** -52))).alias("mape"),
        F.count(F.lit(1)).alias("n_test"))


# ---------------------------------------------------------------- models on lags
CALENDAR = ["dayofweek", "month", "day", "quarter"]


def _regressor(model: str, trees: int):
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    made = {"gradient_boosting": lambda: GBTRegressor(maxIter=trees, maxDepth=5, seed=42),
            "random_forest": lambda: RandomForestRegressor(numTrees=trees, maxDepth=10, seed=42), "linear": lambda: LinearRegression()}
    if model not in made:
        raise ValueError(f"unknown model {model!r}")
    return made[model]().setLabelCol("y").setPredictionCol("yhat")


def fit_lags(s: DataFrame, model: str = "gradient_boosting", n_lags: int = 14, test_ratio: float = 0.2, key=None, trees: int = 50):
    """TS15: (fitted pipeline, scored test rows key.., ts, y, yhat): one model for all series on their lags and calendar parts, trained on the
    first rows of each series and scored on its last ``test_ratio``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    frame = chronological(lag_features(s, n_lags, key), test_ratio, key)
    inputs = [*[f"lag_{k}" for k in range(1, n_lags + 1)], *CALENDAR]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_x"), _regressor(model, trees).setFeaturesCol("_x")])
    fitted = pipe.fit(frame.where("NOT is_test"))
    scored = fitted.transform(frame.where("is_test")).select(*_keys(key), "ts", "y", "yhat")
    return fitted, scored


def lag_forecast(s: DataFrame, fitted, n_lags: int = 14, freq: str = "D", steps: int = 30, key=None, every: int = 5) -> DataFrame:
    """TS15: (key.., step, ts, yhat), each step fed back as the next one's lag.

    The state is one row a series (its last ``n_lags`` values); a step is a projection of it, checkpointed every few steps.
    """
    ensure_checkpoint_dir(s.sparkSession)
    keys = _keys(key)
    state = _latest(s, n_lags, keys).where(F.size("lags") == n_lags).withColumn("path", F.array().cast("array<double>")).checkpoint()
    step = F.expr(FREQ[freq][1])
    for i in range(1, steps + 1):
        at = F.col("hi") + step * i
        ready = state.select("*", *[F.get("lags", F.lit(k - 1)).alias(f"lag_{k}") for k in range(1, n_lags + 1)], F.weekday(at).alias("dayofweek"),
                             F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.quarter(at).alias("quarter"))
        state = fitted.transform(ready).select(*keys, "hi", F.slice(F.concat(F.array("yhat"), "lags"), 1, n_lags).alias("lags"),
                                               F.concat("path", F.array("yhat")).alias("path"))
        if i % every == 0:
            state = state.checkpoint()
    out = state.select(*keys, "hi", F.posexplode("path").alias("at", "yhat"))
    return out.select(*keys, (F.col("at") + 1).alias("step"), (F.col("hi") + step * (F.col("at") + 1)).alias("ts"), rnd("yhat", 4).alias("yhat"))


def _latest(s: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(key.., hi, lags): the last ``n`` values of each series, newest first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    tail = s.where(F.col("value").isNotNull()).withColumn("_r", rank).where(F.col("_r") <= n)
    return tail.groupBy(*keys).agg(F.max("ts").alias("hi"), F.transform(F.sort_array(F.collect_list(F.struct("_r", "value"))), lambda e: e["value"]).alias("lags"))


def auto_forecast(s: DataFrame, key=None, models=("linear", "gradient_boosting", "fourier"), n_lags: int = 14, test_ratio: float = 0.2,
                  trees: int = 20, changepoints: int = 8, seasons: dict[float, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """TS19: (errors, best): each model's errors on the last ``test_ratio`` of each series, and the one of smallest MAE."""
    keys = _keys(key)
    if not keys:
        errors, best = auto_forecast(s.withColumn("_series", F.lit(0)), "_series", models, n_lags, test_ratio, trees, changepoints, seasons)
        return errors.drop("_series"), best.drop("_series")
    parts = []
    for model in models:
        if model == "fourier":
            split = chronological(s.where(F.col("value").isNotNull()), test_ratio, key)
            fit = fourier_fit(split.where("NOT is_test"), key, changepoints, seasons)
            scored = _fourier_values(split.where("is_test"), fit, keys, changepoints, seasons).select(*[split[k] for k in keys], F.col("value").alias("y"), "yhat")
        else:
            _, scored = fit_lags(s, model, n_lags, test_ratio, key, trees)
        parts.append(forecast_errors(scored, key).withColumn("model", F.lit(model)))
    errors = parts[0]
    for part in parts[1:]:
        errors = errors.unionByName(part)
    errors = errors.checkpoint()
    return errors, best_model(errors, key)

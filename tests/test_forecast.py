"""PACF, ADF and forecasts against numpy on made series."""

import datetime as dt
import math

import numpy as np
import pytest

from tessera.operators import forecast as FC

START = dt.datetime(2021, 3, 1)


def frame(spark, **series):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")


def walk(n, phi, seed=1):
    rng = np.random.default_rng(seed)
    out = [0.0]
    for _ in range(n - 1):
        out.append(phi * out[-1] + rng.normal())
    return out


def test_pacf_solves_yule_walker(spark):
    series = {"a": walk(200, 0.7), "b": walk(90, -0.4, 2)}
    got = {(r.k, r.lag): r.pacf for r in FC.pacf(frame(spark, **series), 6, "k").collect()}
    for k, v in series.items():
        d = np.array(v) - np.mean(v)
        r = [float(d[: len(d) - j] @ d[j:]) / float(d @ d) for j in range(7)]
        for lag in range(1, 7):
            phi = np.linalg.solve([[r[abs(i - j)] for j in range(lag)] for i in range(lag)], r[1: lag + 1])
            assert got[k, lag] == pytest.approx(phi[-1], abs=1e-4)


def plain_adf(v, lags):
    v = np.array(v)
    d = np.diff(v)
    t = np.arange(lags, len(d))
    x = np.column_stack([v[t], *[d[t - k] for k in range(1, lags + 1)], np.ones(len(t))])
    b, *_ = np.linalg.lstsq(x, d[t], rcond=None)
    e = d[t] - x @ b
    return b[0] / math.sqrt(e @ e / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0]), len(t)


@pytest.mark.parametrize("lags,block", [(0, 1 << 16), (3, 37)])
def test_adf_against_least_squares(spark, monkeypatch, lags, block):
    v = walk(300, 0.9)
    monkeypatch.setattr(FC._cross_products, "__defaults__", (block,))
    r = FC.adf(frame(spark, a=v).drop("k"), lags).first()
    stat, n = plain_adf(v, lags)
    assert (r.n_obs, r.lags_used) == (n, lags) and r.statistic == pytest.approx(stat, abs=1e-4)


def test_adf_tells_noise_from_a_walk(spark):
    noise, drift = FC.adf(frame(spark, a=walk(300, 0.1)).drop("k")).first(), FC.adf(frame(spark, a=np.cumsum(walk(300, 0.0))).drop("k")).first()
    assert noise.is_stationary and not drift.is_stationary and drift.critical_5 == pytest.approx(-2.87, abs=0.01)
    assert FC.adf(frame(spark, a=[1.0] * 50).drop("k")).first().statistic is None


def test_fourier_fit_is_least_squares_and_forecasts_go_on(spark):
    days = np.arange(400)
    wave = 5 + 0.03 * days + 2 * np.sin(2 * np.pi * (days + 18687) / 7)  # 18687 days from 1970 to the start
    rng = np.random.default_rng(0)
    noisy = wave + rng.normal(size=400) * 0.1
    s = frame(spark, a=wave, b=noisy)
    seasons = {7 * FC.DAY: 2}
    model = {r.k: r for r in FC.fourier_fit(s, "k", changepoints=3, seasons=seasons, ridge=0.0).collect()}
    sec = (days + 18687) * FC.DAY
    t = days / 399
    x = np.column_stack([np.ones(400), t, *[np.maximum(t - 0.8 * (j + 1) / 4, 0) for j in range(3)],
                         *[f(sec * 2 * np.pi * k / (7 * FC.DAY)) for k in (1, 2) for f in (np.sin, np.cos)]])
    for k, v in (("a", wave), ("b", noisy)):
        beta, *_ = np.linalg.lstsq(x, v, rcond=None)
        assert np.allclose(model[k].coefficients, beta, atol=1e-5) and model[k].n == 400
    out = {(r.k, r.step): r for r in FC.fourier_forecast(s, "D", 20, "k", 3, seasons, ridge=0.0).collect()}
    later = np.arange(400, 420)
    want = 5 + 0.03 * later + 2 * np.sin(2 * np.pi * (later + 18687) / 7)
    assert all(out["a", i + 1].yhat == pytest.approx(w, abs=1e-2) for i, w in enumerate(want))
    assert all(out["b", i].lower < out["b", i].yhat < out["b", i].upper for i in range(1, 21))
    assert out["a", 20].ts == START + dt.timedelta(days=419) and len(out) == 40
    assert FC.fourier_forecast(s.where("k = 'a'").drop("k"), "D", 3, None, 3, seasons).columns == ["step", "ts", "yhat", "lower", "upper"]


def test_lag_forecast_feeds_steps_back_and_split_is_chronological(spark):
    days = np.arange(150)
    s = frame(spark, a=10 + np.sin(2 * np.pi * days / 7), b=20 + 3 * np.sin(2 * np.pi * days / 7))
    fitted, scored = FC.fit_lags(s, "linear", 7, key="k")
    rows = scored.collect()
    assert min(r.ts for r in rows) == START + dt.timedelta(days=7 + 114) and len(rows) == 2 * 29
    assert all(abs(r.y - r.yhat) < 1e-3 for r in rows)
    out = {(r.k, r.step): r for r in FC.lag_forecast(s, fitted, 7, "D", 9, "k").collect()}
    for i in range(1, 10):
        assert out["b", i].yhat == pytest.approx(20 + 3 * math.sin(2 * math.pi * (149 + i) / 7), abs=0.02)
        assert out["a", i].ts == START + dt.timedelta(days=149 + i)
    errors, best = FC.auto_forecast(s, "k", ("linear", "fourier"), n_lags=7, changepoints=0, seasons={365 * FC.DAY: 1})
    assert {(r.k, r.model) for r in best.collect()} == {("a", "linear"), ("b", "linear")} and errors.count() == 4

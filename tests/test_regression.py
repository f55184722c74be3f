"""Regressions against numpy's least squares, group by group."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidepanel.functions.linear import moments, with_slopes
from tidepanel.operators import regression as R


def panel(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for day in range(9):
        n = [40, 25, 12, 11, 3, 30, 30, 1, 60][day]
        x = rng.normal(size=(n, 4)) * [1, 100, 0.01, 1] + [0, 1e6, 5, 0]
        x[:, 3] = x[:, 0] * 2 - 3 if day == 5 else 7.0 if day == 6 else x[:, 3]
        y = x @ [1.0, 0.02, 30.0, -2.0] + rng.normal(size=n)
        for k in range(n):
            v = [None if rng.random() < 0.05 else float(a) for a in (y[k], *x[k])]
            rows.append((k, dt.date(2024, 1, 1 + day), *v))
    return rows


SCHEMA = "ticker long, date date, value double, a double, b double, c double, d double"


@pytest.mark.parametrize("factors", [["a"], ["a", "b"], ["d", "a", "b", "c"], ["a", "a", "d"]])
def test_residuals_equal_least_squares_per_date(spark, factors):
    df = pd.DataFrame(panel(), columns=["ticker", "date", "y", "a", "b", "c", "d"])
    want = {}
    for date, g in df.groupby("date"):
        ok = g[["y", *factors]].notna().all(axis=1)
        for t, y in zip(g.ticker, g.y, strict=True):
            want[t, date] = y
        if ok.sum() >= max(10, len(factors) + 2):
            x = g.loc[ok, factors].to_numpy()
            x = np.column_stack([np.ones(len(x)), x - x.mean(axis=0)])
            res = g.loc[ok, "y"].to_numpy() - x @ np.linalg.lstsq(x, g.loc[ok, "y"].to_numpy(), rcond=1e-9)[0]
            want |= {(t, date): math.nan for t in g.ticker} | dict(zip(((t, date) for t in g.loc[ok, "ticker"]), res, strict=True))
    got = R.factor_neutral(spark.createDataFrame(panel(), SCHEMA).withColumnRenamed("value", "y").withColumnRenamed("ticker", "_b_ticker").withColumnRenamed("_b_ticker", "ticker"), "y", factors).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["ticker"], r["date"]]
        assert (r["value"] is None and (w is None or math.isnan(w))) or abs(r["value"] - w) < 1e-6 * max(1, abs(w))


def test_neutral_edge_cases(spark):
    df = spark.createDataFrame(panel()[:4], SCHEMA)
    assert [r["value"] for r in R.factor_neutral(df, "a", []).collect()] == [r["a"] for r in df.collect()]
    assert sorted(R.factor_neutral(df.limit(0), "value", ["a"]).columns) == sorted(df.columns)
    assert R.factor_neutral(df.limit(0), "value", ["a"]).collect() == []
    assert with_slopes(moments(df.limit(0), ["date"], ["a", "b"]), "b", ["a"]).collect() == []


def test_pooled_volatility_slopes(spark):
    rng = np.random.default_rng(4)
    v = rng.uniform(0.1, 1, 300)
    pdf = pd.DataFrame({"rvol_21d": v, "f": 3 * v + rng.normal(size=300), "g": rng.normal(size=300), "vol_regime": v * 2})
    pdf.loc[5, "f"], pdf.loc[6, "rvol_21d"], pdf.loc[60:, "g"] = None, 0.0, None
    got = R.neutral_to_volatility(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "rvol_21d double, f double, g double, vol_regime double"), ["f", "g", "vol_regime"], "rvol_21d").toPandas()
    ok = pdf.f.notna() & (pdf.rvol_21d != 0)
    slope = np.cov(pdf.f[ok], pdf.rvol_21d[ok], ddof=0)[0, 1] / pdf.rvol_21d[ok].var(ddof=0)
    assert np.allclose(sorted(got.f.dropna()), sorted((pdf.f - slope * pdf.rvol_21d).dropna()))
    assert sorted(got.g.dropna()) == sorted(pdf.g.dropna()) and sorted(got.vol_regime) == sorted(pdf.vol_regime)


def newey_west(y, x):
    x = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    n, k = x.shape
    lags = int(np.floor(n ** (1 / 3) + 1e-12))
    s = x * e[:, None]
    meat = s.T @ s
    for j in range(1, lags + 1):
        g = s[j:].T @ s[:-j]
        meat += (1 - j / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    err = np.sqrt(np.diag(inv @ meat @ inv))
    return beta, err, beta / err, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())), n, lags


def test_factor_model_equals_numpy(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for s, n in (("p", 400), ("q", 64), ("short", 59)):
        x = rng.normal(size=(n, 3)) * [0.01, 0.02, 0.005] + [0.001, 0, 0.1]
        e = np.convolve(rng.normal(size=n + 4), np.ones(5) / 5, "valid") * 0.01
        y = 0.0004 + x @ [1.1, -0.3, 0.7] + e
        rows += [(s, dt.date(2020, 1, 1) + dt.timedelta(k), float(y[k]), *map(float, x[k])) for k in range(n)]
        want[s] = newey_west(y, x)
    rows += [("p", dt.date(2019, 1, 1), None, 1.0, 1.0, 1.0), ("p", dt.date(2019, 1, 2), 1.0, math.nan, 1.0, 1.0)]
    got = R.factor_model(spark.createDataFrame(rows, "strategy_id string, date date, ret double, m double, s double, h double").repartition(3), ["m", "s", "h"]).collect()
    assert {r["strategy_id"] for r in got} == {"p", "q"}
    for r in got:
        beta, err, t, r2, n, lags = want[r["strategy_id"]]
        k = ["alpha", "m", "s", "h"].index(r["term"])
        assert np.allclose([r["coefficient"], r["error"], r["t"], r["r2"]], [beta[k], err[k], t[k], r2], rtol=1e-8, atol=1e-12)
        assert (r["n"], r["lags"]) == (n, lags)


def test_student_tail():
    for t, v in ((0.0, 5), (1.0, 3), (2.5, 30), (-4.0, 200), (12.0, 7)):
        x = np.concatenate([np.linspace(abs(t), 60, 400_001), np.geomspace(60, 1e6, 200_000)])
        f = np.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi) * (1 + x * x / v) ** (-(v + 1) / 2)
        assert abs(R.two_sided(t, v) - 2 * np.trapezoid(f, x)) < 1e-7
    assert math.isnan(R.two_sided(math.nan, 4)) and math.isnan(R.two_sided(1.0, 0))

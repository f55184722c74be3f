"""Principal components against numpy on weeks made by pandas, and no look-ahead."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.operators import components as C

START = dt.date(2021, 1, 1)
COLS = ["a", "b", "c", "d"]


def curve(n=500, seed=1, late=0.0):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=(n, 3)) @ rng.normal(size=(3, 4)) + rng.normal(size=(n, 4)) * 0.1, axis=0)
    x[400:] += late * rng.normal(size=(n - 400, 4))
    days = [START + dt.timedelta(k) for k in range(n) if (START + dt.timedelta(k)).weekday() < 5]
    rows = [(d, *[None if rng.random() < 0.05 else float(v) for v in x[(d - START).days]]) for d in days]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, a double, b double, c double, d double").repartition(3)


def test_weeks_and_components_equal_numpy(spark):
    rows = curve()
    df = pd.DataFrame(rows, columns=["date", *COLS]).set_index("date").astype(float)
    df.index = pd.to_datetime(df.index)
    weekly = df.ffill().resample("W-FRI").last().diff().dropna()
    got = C.weekly_changes(frame(spark, rows), COLS).orderBy("date").toPandas()
    assert list(pd.to_datetime(got.date)) == list(weekly.index)
    assert np.allclose(got[COLS].to_numpy(), weekly.to_numpy())
    cut = dt.date(2021, 12, 31)
    train = weekly[weekly.index <= pd.Timestamp(cut)]
    values, vectors = np.linalg.eigh(np.cov(train.to_numpy().T))
    changes = C.weekly_changes(frame(spark, rows), COLS)
    fit = C.loadings(changes, COLS, F.lit(cut)).collect()[0]
    for k in range(4):
        v = vectors[:, ::-1].T[k]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        assert np.allclose(fit["vectors"][k], v, atol=1e-9)
    assert np.allclose(fit["share"], values[::-1] / values.sum())
    s = C.scores(changes, COLS, C.loadings(changes, COLS, F.lit(cut)), 1).orderBy("date").toPandas()
    assert np.allclose(s.score, (weekly - train.mean()).to_numpy() @ np.array(fit["vectors"][1]))
    assert C.loadings(changes, COLS, F.lit(dt.date(2021, 3, 1))).collect() == []


def test_later_rows_do_not_move_earlier_values(spark):
    cut = dt.date(2021, 12, 31)
    rng = np.random.default_rng(5)
    rows = curve()
    bars = spark.createDataFrame([(t, r[0], float(rng.normal())) for t in range(4) for r in rows], "ticker long, date date, ret double")
    out = []
    for late in (0.0, 50.0):
        b = C.component_beta(bars, frame(spark, curve(late=late)), COLS, F.lit(cut), window=120, least=20)
        out.append({(r["ticker"], r["date"]): r["beta"] for r in b.collect()})
    early = [k for k in out[0] if k[1] <= cut]
    assert len(out[0]) == bars.count() and sum(out[0][k] is not None for k in early) > 100
    assert all(out[0][k] == out[1][k] for k in early)
    assert any(out[0][k] != out[1][k] for k in out[0])
    # the betas themselves, at the last date, by numpy
    changes = C.weekly_changes(frame(spark, rows), COLS)
    w = C.scores(changes, COLS, C.loadings(changes, COLS, F.lit(cut)), 1).toPandas().set_index("date").score.sort_index()
    days = sorted({r[0] for r in rows})
    daily = w.reindex(sorted({*w.index, *days})).ffill().reindex(days).diff().to_numpy()
    r = {(x["ticker"], x["date"]): x["ret"] for x in bars.collect()}
    y, x = np.array([r[2, d] for d in days])[-120:], daily[-120:]
    assert abs(out[0][2, days[-1]] - ((x * y).mean() - x.mean() * y.mean()) / x.var(ddof=1)) < 1e-9

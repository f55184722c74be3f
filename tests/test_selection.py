"""Funnel, choice of names that move apart, carried-over names and weights against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import selection as K

DAY = dt.date(2024, 3, 1)
PANEL = "ticker long, date date, score double, quality double, first_date date, earnings double, traded double, vol double, sector string"


def panel(seed=1):
    rng = random.Random(seed)
    rows = []
    for d, n in enumerate((120, 70, 30, 11, 90)):
        for t in range(n):
            v = [round(rng.random(), 2), round(rng.random(), 2), DAY - dt.timedelta(rng.randrange(700)), round(rng.random(), 2), float(rng.randrange(1, 40) * 500_000), round(rng.random(), 2)]
            v = [x if rng.random() > 0.04 else None for x in v]
            rows.append((t, DAY + dt.timedelta(31 * d), *v, rng.choice(["a", "b", "c", None])))
    return rows


def pct(x):
    s = sorted(x.values())
    return {k: (sum(a < v for a in s) + (sum(a == v for a in s) + 1) / 2) / len(s) for k, v in x.items()}


def funnel_loop(rows, n, pool):
    out = {}
    for date in {r[1] for r in rows}:
        g = {r[0]: r for r in rows if r[1] == date}
        alive = {t for t, r in g.items() if r[2] is not None}
        out |= {(t, date): 0 for t in g if t not in alive}
        if len(alive) < 2 * n:
            out |= {(t, date): 0 for t in g}
            continue
        rank = lambda: pct({t: g[t][2] for t in alive})  # noqa: B023,E731
        known = lambda: sorted((t for t in alive if g[t][6] is not None), key=lambda t: (-g[t][6], t))  # noqa: B023,E731
        steps = [
            lambda: {t for t, p in rank().items() if p > 0.2},
            lambda: {t for t in alive if g[t][3] is not None and g[t][3] > 0.5},  # noqa: B023
            lambda: {t for t in alive if g[t][4] is not None and g[t][4] <= date - dt.timedelta(270)},  # noqa: B023
            lambda: {t for t, p in rank().items() if g[t][5] is None or g[t][5] < 0.9 or p >= 0.99},  # noqa: B023
            lambda: set(known()[:pool]) if len(known()) > pool else alive,  # noqa: B023
            lambda: {t for t in alive if g[t][6] is not None and g[t][6] >= 5e6},  # noqa: B023
            lambda: {t for t in alive if g[t][7] is not None and g[t][7] <= 0.6},  # noqa: B023
        ]
        for k, (step, times) in enumerate(zip(steps, (3, 3, 3, 3, 2, 2, 2), strict=True), 1):
            passed = step()
            if len(passed) >= times * n:
                out |= {(t, date): k for t in alive - passed}
                alive = passed
        out |= {(t, date): None for t in alive}
    return out


@pytest.mark.parametrize(("n", "pool"), [(3, 20), (8, 1500), (12, 25)])
def test_funnel_equals_a_loop(spark, n, pool):
    rows = panel()
    got = K.funnel(spark.createDataFrame(rows, PANEL).withColumn("_alive_", F.lit(1)), n=n, pool=pool).collect()
    assert {(r["ticker"], r["date"]): r["dropped_by"] for r in got} == funnel_loop(rows, n, pool)
    assert K.funnel(spark.createDataFrame(rows, PANEL).limit(0), n=n).collect() == []


def walks(seed=2, days=60, names=14):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(days, 3))
    out = {}
    for t in range(names):
        x = common[:, t % 3] * (0.9 if t < 9 else 0.2) + rng.normal(size=days) * 0.4
        out[t] = [None if rng.random() < 0.1 else float(v) for v in x]
    out[13] = [0.0] * days
    return out


def test_choice_equals_a_loop_on_every_date(spark):
    series, back, n, most = walks(), 20, 5, 0.6
    day = lambda k: DAY + dt.timedelta(k)
    rng = random.Random(4)
    cand = [(day(d), t, float(p)) for d in (5, 19, 20, 40, 59, 75) for p, t in enumerate(rng.sample(range(14), 12))] + [(day(40), 99, 3.5), (day(40), 98, None)]
    cand += cand[:2]
    rets = [(t, day(k), v) for t, x in series.items() for k, v in enumerate(x)]
    got = K.uncorrelated(spark.createDataFrame(cand, "date date, ticker long, place double"), spark.createDataFrame(rets, "ticker long, date date, ret double").repartition(3), n, 10, most, back).collect()
    table = pd.DataFrame(series, dtype=float)
    for d in (5, 19, 20, 40, 59, 75):
        order = [t for _, t in sorted({(p, t) for x, t, p in cand if x == day(d) and p is not None})][:10]
        want = order[:n]
        if 20 <= d < 60:
            corr = table.iloc[d - back : d].reindex(columns=order).corr().abs()
            want = []
            for t in order:
                if len(want) < n and all(not corr.loc[t, u] > most for u in want):
                    want.append(t)
        assert [r["ticker"] for r in sorted(got, key=lambda r: r["picked"]) if r["date"] == day(d)] == want


def test_carried_over_names(spark):
    scores = spark.createDataFrame([(DAY, t, 10.0 - t) for t in range(10)] + [(DAY + dt.timedelta(1), 1, 1.0)], "date date, ticker long, score double")
    picks = spark.createDataFrame([(DAY, 2, 1), (DAY, 0, 2), (DAY, 5, 3), (DAY, 6, 4), (DAY + dt.timedelta(1), 1, 1)], "date date, ticker long, picked int")
    held = spark.createDataFrame([(DAY, 9), (DAY, 5), (DAY, 8), (DAY, 77)], "date date, ticker long")
    got = [(r["date"], r["ticker"]) for r in K.carry_over(picks, scores, held, 4, 0.5).orderBy("date", "slot").collect()]
    assert got == [(DAY, 5), (DAY, 8), (DAY, 2), (DAY, 0), (DAY + dt.timedelta(1), 1)]


def test_weights_fit_their_bounds(spark):
    book = spark.createDataFrame([(DAY, t, float(t % 4), 0.1 * t, 1e6 * (t + 1)) for t in range(12)] + [(DAY + dt.timedelta(1), 1, 1.0, None, None)], "date date, ticker long, score double, vol double, traded double")
    for kind in ("equal", "signal", "inverse_vol"):
        got = K.book_weights(book, kind, 2.0, vol="vol", traded="traded").toPandas()
        assert np.allclose(got.groupby("date").weight.sum(), 1)
    with pytest.raises(ValueError, match="no such weighting"):
        K.book_weights(book, "other")


def test_overlay_holds_the_last_value(spark):
    w = spark.createDataFrame([(DAY + dt.timedelta(k), 1, 1.0) for k in range(4)], "date date, ticker long, weight double")
    s = lambda rows: spark.createDataFrame([(DAY + dt.timedelta(k), v) for k, v in rows], "date date, value double")
    got = [r["weight"] for r in K.credit_overlay(w, s([(1, 0.5), (2, -1.0)]), s([(0, 0.01), (3, 0.06)])).orderBy("date").collect()]
    assert got == [1.0, 0.5, 1.0, 0.5]
    assert [r["weight"] for r in K.credit_overlay(w, None, None).collect()] == [1.0] * 4

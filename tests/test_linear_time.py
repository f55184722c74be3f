"""Sums, means and quantiles of sliding windows against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import linear_time as L
from tidepanel.functions.columns import rank_pct

DAY = dt.date(2024, 1, 1)
SCHEMA = "ticker long, date date, x double, y double"


def rows(seed=1):
    rng = random.Random(seed)
    return [(t, DAY + dt.timedelta(k), None if rng.random() < 0.1 else round(rng.gauss(0, 2), 3), float(k)) for t, n in ((1, 50), (2, 7), (None, 12), (4, 1)) for k in range(n)]


def by_ticker(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0] or 0, r[1])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("window", [1, 2, 7, 12, 60])
def test_rolling_sums(spark, window):
    data = rows()
    df = L.with_rolling_sums(spark.createDataFrame(data, SCHEMA).repartition(3).withColumn("_s", F.lit(1)), {"sum": F.col("x"), "n": F.col("x").isNotNull().cast("int"), "big": F.col("x") + 1e9}, window)
    got = {(r["ticker"], r["date"]): r for r in df.collect()}
    for t, g in by_ticker(data).items():
        for k, r in enumerate(g):
            seen = [v[2] for v in g[max(0, k - window + 1) : k + 1] if v[2] is not None]
            q = got[t, r[1]]
            assert abs(q["sum"] - sum(seen)) < 1e-9 and q["n"] == len(seen) and abs(q["big"] - sum(v + 1e9 for v in seen)) < 1e-4
    assert L.with_rolling_sums(df.select("ticker", "date", "x").limit(0), {"s": F.col("x")}, 3).collect() == []


def test_exponential_means_and_quantiles(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    df = L.with_ewm(df, {"adj": ("x", 0.3, True), "raw": ("x", 0.3, False)})
    got = {(r["ticker"], r["date"]): r for r in L.with_quantiles(df, {"q": ("x", 9, 0.1, 4), "x2": ("y", 5, 0.5, 1)}).collect()}
    assert len(got) == len(data)
    for t, g in by_ticker(data).items():
        for k, r in enumerate(g):
            q, seen = got[t, r[1]], [v[2] for v in g[: k + 1] if v[2] is not None]
            if r[2] is None:
                assert q["adj"] is None and q["raw"] is None
            else:
                w = np.array([0.7**a for a in range(len(seen))][::-1])
                assert abs(q["adj"] - (w * seen).sum() / w.sum()) < 1e-12
                w = w * np.array([1.0] + [0.3] * (len(seen) - 1))
                assert abs(q["raw"] - (w * seen).sum()) < 1e-12
            near = [v[2] for v in g[max(0, k - 8) : k + 1] if v[2] is not None]
            assert (q["q"] is None and len(near) < 4) or abs(q["q"] - np.percentile(near, 10)) < 1e-12
            assert q["x2"] == np.median([v[3] for v in g[max(0, k - 4) : k + 1]])
    ranks = {(r["ticker"], r["date"]): r["p"] for r in L.with_sliding_ranks(spark.createDataFrame([(*r[:2], r[2] and round(r[2]) * 1.0, r[3]) for r in data], SCHEMA), {"p": ("x", 9, 3)}).collect()}
    for t, g in by_ticker(data).items():
        for k, r in enumerate(g):
            near = [round(v[2]) for v in g[max(0, k - 8) : k + 1] if v[2] is not None]
            want = None if r[2] is None or len(near) < 3 else (sum(v < near[-1] for v in near) + (near.count(near[-1]) + 1) / 2) / len(near)
            assert ranks[t, r[1]] == want
    assert L.with_ewm(spark.createDataFrame([], SCHEMA), {"e": ("x", 0.1, True)}).collect() == []


def test_many_ranks_take_one_shuffle(spark):
    df = spark.createDataFrame(rows(), SCHEMA).select("*", *[rank_pct(c).alias(f"r_{c}") for c in ("x", "y")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    g = {}
    for r in df.collect():
        g.setdefault(r["date"], []).append((r["x"], r["r_x"]))
    for pairs in g.values():
        known = [x for x, _ in pairs if x is not None]
        for x, p in pairs:
            assert p is None if x is None else abs(p - (sum(v < x for v in known) + (sum(v == x for v in known) + 1) / 2) / len(known)) < 1e-12


def test_rolling_moments_and_slopes():
    rng = random.Random(4)
    n, window, least = 90, 12, 5
    x = np.array([np.nan if rng.random() < 0.2 else rng.choice([0.1, 0.1, rng.gauss(5, 1)]) for _ in range(n)])
    x[30:60] = 0.1
    y = np.array([np.nan if rng.random() < 0.2 else rng.gauss(0, 1) for _ in range(n)])
    mean, var = L.rolling(x, window, least)
    slope = L.rolling_slope(y, x, window, least)
    for k in range(n):
        at = slice(max(0, k - window + 1), k + 1)
        seen = x[at][~np.isnan(x[at])]
        if len(seen) < least:
            assert np.isnan(mean[k]) and np.isnan(var[k])
            continue
        assert abs(mean[k] - seen.mean()) < 1e-12
        # a frame of equal values has no variance at all, so that a division by it is null
        assert var[k] == 0.0 if len(set(seen)) == 1 else abs(var[k] - seen.var(ddof=1)) < 1e-10
        both = ~np.isnan(x[at]) & ~np.isnan(y[at])
        a, b = x[at][both], y[at][both]
        if len(a) < least or len(set(a)) == 1:
            assert np.isnan(slope[k])
        else:
            assert abs(slope[k] - np.cov(a, b)[0, 1] / a.var(ddof=1)) < 1e-9
    assert all(len(v) == 0 for v in L.rolling(np.array([]), 3)) and np.isnan(L.rolling(np.full(3, np.nan), 2)[0]).all()


def test_ranks_of_a_date_as_windows_give_them(spark):
    rng = random.Random(8)
    data = [(k, DAY + dt.timedelta(k % 3), rng.choice([None, 1.0, 2.0, -0.0, 0.0, float("nan"), float("inf")]), rng.choice([None, 3.0])) for k in range(60)] + [(99, DAY + dt.timedelta(9), None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    ranked = L.with_ranks(df, {"rx": "x", "ry": "y"})
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    want = {r["ticker"]: (r["rx"], r["ry"]) for r in df.withColumns({"rx": rank_pct("x"), "ry": rank_pct("y")}).collect()}
    assert {r["ticker"]: (r["rx"], r["ry"]) for r in ranked.collect()} == want
    assert "Window" not in plan and plan.count("Sort [") == 1  # a window would sort a date's rows twice for each rank


def test_rolling_sums_sort_a_ticker_once(spark):
    df = L.with_rolling_sums(spark.createDataFrame(rows(), SCHEMA), {f"s{k}": F.col("x") * k for k in range(8)}, 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1

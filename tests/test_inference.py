"""Deflated ratios, block resampling and permutations against plain loops over the same draws."""

from __future__ import annotations

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest

from tidepanel.operators import inference as I  # noqa: E741

DAY = dt.date(2024, 1, 1)


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def draw(seed, *numbers):
    out = mix(seed)
    for n in numbers:
        out = mix(out ^ mix(n % 2**64))
    return out


def test_draws_equal_plain_integers():
    got = I.draws(7, np.arange(5)[:, None], 19_000, np.array([-3, 0, 12])[None, :])
    assert got.tolist() == [[draw(7, p, 19_000, t) for t in (-3, 0, 12)] for p in range(5)]


def series(n=120, seed=3):
    return np.random.default_rng(seed).normal(0.001, 0.01, n)


def test_deflated_sharpe(spark):
    r = series()
    df = spark.createDataFrame([("a", DAY + dt.timedelta(k), float(x)) for k, x in enumerate(r)] + [("b", DAY, 0.1), ("b", DAY, None)], "strategy_id string, date date, ret double")
    got = {x["strategy_id"]: x for x in I.deflated_sharpe(df, 50).collect()}
    n, sr = len(r), r.mean() / r.std(ddof=1)
    z = (r - r.mean()) / r.std()
    skew = math.sqrt(n * (n - 1)) / (n - 2) * (z**3).mean()
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((z**4).mean() - 3) + 6)
    root = math.sqrt(2 * math.log(50))
    hurdle = (root - (0.5772156649015329 + math.log(math.log(50))) / root) / math.sqrt(n - 1)
    want = NormalDist().cdf((sr - hurdle) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt + 2) / 4 * sr * sr))
    assert abs(got["a"]["probability"] - want) < 1e-9 and abs(got["a"]["sharpe"] - sr * math.sqrt(252)) < 1e-9 and abs(got["a"]["hurdle"] - hurdle * math.sqrt(252)) < 1e-9
    assert got["b"]["probability"] is None


@pytest.mark.parametrize("parts", [1, 5])
def test_block_draws_equal_a_plain_loop(spark, parts):
    r, sims = series(50), 70
    rows = [("a", DAY + dt.timedelta(k), float(x)) for k, x in enumerate(r)] + [("a", DAY + dt.timedelta(99), None), ("one", DAY, 0.5), ("none", DAY, None)]
    df = spark.createDataFrame(rows, "strategy_id string, date date, ret double").repartition(3)
    span = {"span": lambda x: x.max(axis=1) - x.min(axis=1)}
    got = {(x["strategy_id"], x["measure"], x["sim"]): x["value"] for x in I.block_draws(df, I.MEASURES | span, sims, parts=parts).collect()}
    assert {k[0] for k in got} == {"a", "one"} and len(got) == 2 * 5 * (sims + 1)
    for sim in range(sims):
        starts = [draw(42, sim, block) % 44 for block in range(8)]
        sample = [x for s in starts for x in r[s : s + 7]][:50]
        assert abs(got["a", "mean", sim] - np.mean(sample) * 252) < 1e-12
        assert abs(got["a", "sharpe", sim] - np.mean(sample) / np.std(sample, ddof=1) * math.sqrt(252)) < 1e-9
        assert abs(got["a", "span", sim] - (max(sample) - min(sample))) < 1e-12
    assert abs(got["a", "growth", -1] - (np.prod(1 + r) ** (252 / 50) - 1)) < 1e-9
    b = {(x["strategy_id"], x["measure"]): x for x in I.bootstrap(df, sims=sims, parts=parts).collect()}
    values = [got["a", "sharpe", s] for s in range(sims)]
    assert abs(b["a", "sharpe"]["p5"] - np.percentile(values, 5)) < 1e-9 and abs(b["a", "sharpe"]["std"] - np.std(values)) < 1e-9
    assert b["a", "sharpe"]["observed"] == got["a", "sharpe", -1] and b["a", "sharpe"]["positive"] == np.mean(np.array(values) > 0)


def rank(x):
    return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]


def test_permutations_equal_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(6):
        n = [15, 12, 9, 20, 12, 11][d]
        for t in range(n):
            s = float(round(rng.normal(), 1)) if d != 4 else 1.0
            rows.append((t * 7 - 20, DAY + dt.timedelta(d), s if rng.random() > 0.05 else None, float(rng.normal() + (s or 0) / 3)))
    df = spark.createDataFrame(rows, "ticker long, date date, s double, f double")
    means = {}
    for p in range(-1, 40):
        ics = []
        for d in range(6):
            day = DAY + dt.timedelta(d)
            g = sorted((t, s, f) for t, x, s, f in rows if x == day and s is not None)
            if len(g) < 10 or len({s for _, s, _ in g}) == 1:
                continue
            a, b = rank([s for _, s, _ in g]), rank([f for _, _, f in g])
            if p >= 0:
                number = (day - dt.date(1970, 1, 1)).days
                order = sorted(range(len(g)), key=lambda k: draw(42, p, number, g[k][0]))
                a = [a[k] for k in order]
            ics.append(np.corrcoef(a, b)[0, 1])
        means[p] = np.mean(ics)
    rest = np.array([means[p] for p in range(40)])
    for parts in (1, 7):
        got = I.permutation_test(df.repartition(parts), "s", "f", 40).collect()[0]
        assert abs(got["true_ic"] - means[-1]) < 1e-12 and abs(got["z"] - (means[-1] - rest.mean()) / rest.std()) < 1e-9
        assert got["p"] == (rest >= means[-1]).mean() and got["significant"] == (got["p"] < 0.05)
    assert I.permutation_test(df.limit(0), "s", "f", 5).collect()[0]["true_ic"] is None

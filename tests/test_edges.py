"""Small hand-made cases of the panel operators: nulls, ties, single rows, empty tables."""

from __future__ import annotations

import datetime as dt

import pytest

from tidepanel.functions.columns import rank_pct, zscore
from tidepanel.operators import joins, windows

DAY = dt.date(2024, 1, 1)
BARS = "ticker long, date date, close double, volume double, ret double"


def test_rank_averages_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, DAY, 5.0), (2, DAY, 5.0), (3, DAY, None), (4, DAY, 9.0)], "ticker long, date date, x double")
    got = {r["ticker"]: r["r"] for r in df.withColumn("r", rank_pct("x")).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: 1.0}


def test_zscore_without_spread_is_null(spark):
    df = spark.createDataFrame([(1, DAY, 2.0), (2, DAY, 2.0)], "ticker long, date date, x double")
    assert [r["z"] for r in df.withColumn("z", zscore("x")).collect()] == [None, None]


def test_zero_price_gives_null(spark):
    rows = [(1, DAY + dt.timedelta(k), c, 1.0, None) for k, c in enumerate([0.0, 1.0, 2.0])]
    got = windows.momentum_signal(spark.createDataFrame(rows, BARS), 1).orderBy("date").collect()
    assert [r["value"] for r in got] == [None, None, None]


def test_as_of_takes_fact_of_the_same_day_and_none_before(spark):
    panel = spark.createDataFrame([(1, DAY + dt.timedelta(k)) for k in range(4)], "ticker long, date date")
    facts = spark.createDataFrame([(1, DAY, 7.0), (1, DAY + dt.timedelta(2), 8.0)], "ticker long, date date, f double")
    got = joins.as_of(panel, facts, "f", 1).orderBy("date").collect()
    assert [r["f"] for r in got] == [None, 7.0, 7.0, 8.0]


@pytest.mark.parametrize("op", [windows.momentum_signal, windows.rsi, windows.tail_risk, windows.market_beta])
def test_empty_bars(spark, op):
    assert op(spark.createDataFrame([], BARS)).collect() == []


def test_normal_functions_against_the_standard_library(spark):
    from statistics import NormalDist

    from tidepanel.functions.columns import norm_cdf, norm_ppf

    rows = [(k / 1000, k / 125 - 4) for k in range(1, 1000)] + [(1e-9, -9.5), (1 - 1e-9, 9.5), (0.0001, -7.0), (0.9999, 7.2)]
    for p, x, ppf, cdf in spark.createDataFrame(rows, "p double, x double").select("p", "x", norm_ppf("p"), norm_cdf("x")).collect():
        assert abs(ppf - NormalDist().inv_cdf(p)) < 1e-9
        assert abs(cdf - NormalDist().cdf(x)) < 1e-13
    assert spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(norm_ppf("p").alias("v")).filter("v is not null").count() == 0

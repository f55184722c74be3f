"""Queries of regressions and tests of significance, and SQL where it can say the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import lag
from tidepanel.operators import components as P
from tidepanel.operators import inference as I  # noqa: E741
from tidepanel.operators import macro_signals as M
from tidepanel.operators import regression as G
from tidepanel.plans import sql as S
from tidepanel.plans.cross import DAILY, PANEL, daily, panel, rounded
from tidepanel.sources import tables

TD = ["ticker", "date"]
FACTORS = {"f1": "1-URGENT", "f2": "2-HIGH", "f3": "3-MEDIUM", "f4": "4-NOT SPECIFIED", "f5": "5-LOW"}


def r8(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.factor_neutral(panel(s, d), "mom", ["vol", "size", "ret"]), TD, ["value"])


def _slope(y: str, x: str) -> str:
    return f"coalesce(regr_slope(CASE WHEN ok THEN {y} END, CASE WHEN ok THEN {x} END) OVER (PARTITION BY date), 0)"


def _centre(x: str) -> str:
    return f"{x} - avg(CASE WHEN ok THEN {x} END) OVER (PARTITION BY date)"


#: One factor after the other, each less what those before explain.
R8_SQL = f"""WITH {S.MONTHLY}, {PANEL}, a AS (SELECT *, mom IS NOT NULL AND vol IS NOT NULL AND size IS NOT NULL AND ret IS NOT NULL AS ok FROM panel),
b AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY date) AS n, {_centre('mom')} AS y, {_centre('vol')} AS x1, {_centre('size')} AS x2, {_centre('ret')} AS x3 FROM a),
c AS (SELECT *, x2 - {_slope('x2', 'x1')} * x1 AS z2 FROM b),
e AS (SELECT *, x3 - {_slope('x3', 'x1')} * x1 - {_slope('x3', 'z2')} * z2 AS z3 FROM c),
f AS (SELECT ticker, date, n, ok, mom, y - {_slope('y', 'x1')} * x1 - {_slope('y', 'z2')} * z2 - {_slope('y', 'z3')} * z3 AS v FROM e)
SELECT ticker, date, round(CASE WHEN n < 10 THEN mom WHEN ok THEN v END, 6) + 0.0 AS value FROM f"""


def r9(s: SparkSession, d: str) -> DataFrame:
    b = panel(s, d).withColumnRenamed("vol", "rvol_6m").withColumn("max_ret_1", F.col("high"))
    out = G.neutral_to_volatility(b, ["mom", "size", "ret", "max_ret_1"], "rvol_6m")
    return rounded(out, TD, ["mom", "size", "ret", "max_ret_1"])


def _pooled(x: str) -> str:
    return f"CASE WHEN (SELECT count(*) FROM panel WHERE {x} IS NOT NULL AND vol <> 0) >= 100 THEN {x} - (SELECT regr_slope({x}, vol) FROM panel WHERE vol <> 0) * vol ELSE {x} END AS {x}"


def factor_returns(s: SparkSession, d: str) -> DataFrame:
    """Daily returns of each sector beside the relative changes of five series, a fiftieth of them."""
    held = M.on_calendar(tables.bars(s, d), tables.macro(s, d), FACTORS)
    change = held.select("date", *[((F.try_divide(F.col(c), lag(c)) - 1) / 50).alias(c) for c in FACTORS])
    return daily(s, d).join(change, "date")


def x15(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.factor_model(factor_returns(s, d), list(FACTORS)), ["strategy_id", "term", "n", "lags"], ["coefficient", "error", "t", "p", "r2"], 8)


def x13(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.deflated_sharpe(daily(s, d), 50), ["strategy_id", "n"], ["sharpe", "hurdle", "probability"])


ROOT = math.sqrt(2 * math.log(50))
HURDLE = (ROOT - (0.5772156649015329 + math.log(math.log(50))) / ROOT) * math.sqrt(252)
#: The normal distribution as a series around 0, in powers of z; sums of 150 terms hold to about 6 in size, beyond that it is 0 or 1.
PHI = "CASE WHEN z > 6 THEN 1 WHEN z < -6 THEN 0 ELSE 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * (SELECT sum(z * t) FROM (SELECT list_reduce(list_transform(range(k + 1), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE z * z / (2 * i + 1) END), lambda a, b: a * b) AS t FROM range(150) r(k))) END"


def x16(s: SparkSession, d: str) -> DataFrame:
    return rounded(I.bootstrap(daily(s, d), sims=400), ["strategy_id", "measure"], ["observed", "p5", "p25", "p50", "p75", "p95", "std", "positive"])


def x18(s: SparkSession, d: str) -> DataFrame:
    out = I.bootstrap(daily(s, d), measures={"sharpe": I.MEASURES["sharpe"]}, sims=1000)
    return rounded(out, ["strategy_id"], ["observed", "p5", "p50", "p95", "positive"])


def x19(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True).withColumn("signal", F.col("close") / F.lag("close", 3).over(Window.partitionBy("ticker").orderBy("date")) - 1).withColumn("forward", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date")))
    return rounded(I.permutation_test(b, "signal", "forward"), ["significant"], ["true_ic", "shuffled_mean", "shuffled_std", "z", "p"])


def m4(s: SparkSession, d: str) -> DataFrame:
    """Five series as the points of a curve; vectors from the weeks up to the middle of 1998."""
    bars = tables.bars(s, d).select(*TD, "ret")
    curve = M.on_calendar(bars, tables.macro(s, d), FACTORS)
    return rounded(P.component_beta(bars, curve, list(FACTORS), F.lit("1998-06-30").cast("date")), TD, ["beta", "value"])


TABLE = {
    "M4_component_beta": (m4, None),
    "R8_factor_neutral": (r8, R8_SQL),
    "R9_volatility_neutral": (r9, f"WITH {S.MONTHLY}, {PANEL} SELECT ticker, date, {S.rounded('mom', 'size', 'ret', 'max_ret_1')} FROM (SELECT ticker, date, high AS max_ret_1, {_pooled('mom')}, {_pooled('size')}, {_pooled('ret')} FROM panel)"),
    "X13_deflated_sharpe": (
        x13,
        f"""WITH {S.DAILY}, {DAILY}, m AS (SELECT strategy_id, count(*) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, skewness(ret) AS g, kurtosis(ret) AS k FROM daily GROUP BY 1),
a AS (SELECT *, mu / nullif(sd, 0) AS sr, {HURDLE!r} / sqrt(n - 1) AS hurdle FROM m), b AS (SELECT *, (sr - hurdle / sqrt(252)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - g * sr + (k + 2) / 4 * sr * sr)) AS z FROM a),
c AS (SELECT strategy_id, n, sr * sqrt(252) AS sharpe, hurdle, {PHI} AS probability FROM b) SELECT strategy_id, n, {S.rounded('sharpe', 'hurdle', 'probability')} FROM c""",
    ),
    # what draws, inverts matrices or hashes is held against plain Python in tests
    "X15_factor_model": (x15, None),
    "X16_bootstrap_measures": (x16, None),
    "X18_sharpe_interval": (x18, None),
    "X19_permutation_test": (x19, None),
}

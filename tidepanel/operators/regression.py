"""Regressions: residuals on any number of factors, and factor models with errors robust to serial correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.linear import fitted, moments, with_slopes

#: Names that stand for volatility itself and are not made neutral to it.
VOLATILITY_NAMES = ("rvol_", "rank_rvol", "idiovol_", "rank_idiovol", "vol_of_vol", "rank_vol_of_vol", "tail_risk", "rank_tail_risk", "vol_reversal", "rank_vol_reversal", "z_rvol_", "z_idiovol_", "max_ret_", "rank_max_effect", "vol_regime", "rank_vol_regime", "vol_spike")
FACTOR_SCHEMA = "strategy_id {kind}, term string, coefficient double, error double, t double, p double, n long, lags int, r2 double"


def factor_neutral(panel: DataFrame, y: str, factors: list[str], by: str = "date", least: int | None = None) -> DataFrame:
    """``panel`` with ``value``: y less its least-squares fit on all factors within a group.

    Rows with a null or NaN in y or a factor take no part and have none. Groups with fewer rows than ``least``
    (default: 10, or two more than there are factors) keep y in every row. Collinear factors, a constant one too, leave
    the fit of the others. Without factors, y is returned. Groups are aggregated before anything is
    shuffled, and only k means and slopes for each come back to its rows.
    """
    if not factors:
        return panel.withColumn("value", F.col(y))
    xs, z = [f"_x{k}" for k in range(len(factors))], "_y"
    need = max(10, len(factors) + 2) if least is None else least
    b = panel.select("*", *[F.col(c).cast("double").alias(n) for c, n in zip([*factors, y], [*xs, z], strict=True)])
    groups = with_slopes(moments(b, [by], [*xs, z]), z, xs).filter(F.col("_n") >= need)
    out = b.join(groups.select(F.col(by).alias("_by"), "_b_", *[f"_b_{x}" for x in xs]), F.col(by).eqNullSafe(F.col("_by")), "left")
    ok = F.col(z).isNotNull() & ~F.isnan(z)
    for x in xs:
        ok = ok & F.col(x).isNotNull() & ~F.isnan(x)
    value = F.when(F.col("_b_").isNull(), F.col(z)).when(ok, F.col(z) - fitted(xs))
    return out.select(*[F.col(c) for c in panel.columns if c != "value"], value.alias("value"))


def neutral_to_volatility(table: DataFrame, columns: list[str], volatility: str, least: int = 100) -> DataFrame:
    """``table`` with each column less its pooled slope on volatility times volatility, under the column's own name.

    Rows whose volatility is null, NaN or 0 don't count in the slope. Columns named for volatility, and those with
    fewer than ``least`` pairs, stay. One aggregation serves all columns.
    """
    free = [c for c in columns if not c.startswith(VOLATILITY_NAMES)]
    if not free:
        return table
    v = F.when(~F.isnan(volatility) & (F.col(volatility) != 0), F.col(volatility))
    parts = []
    for c in free:
        x = F.when(v.isNotNull() & ~F.isnan(c), F.col(c))
        w = F.when(x.isNotNull(), v)
        slope = F.covar_pop(x, w) * F.count(x) / F.greatest(F.var_pop(w) * F.count(x), F.lit(1e-10))
        parts.append(F.when(F.count(x) >= least, slope).otherwise(0.0).alias(f"_s_{c}"))
    slopes = table.agg(*parts)
    b = table.crossJoin(F.broadcast(slopes))  # one row
    change = {c: F.when(F.col(f"_s_{c}") == 0, F.col(c)).otherwise(F.col(c) - F.col(f"_s_{c}") * F.col(volatility)) for c in free}
    return b.select(*[change[c].alias(c) if c in change else F.col(c) for c in table.columns])


def _beta_part(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for f in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + f * d
            c = 1 + f / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def two_sided(t: float, freedom: float) -> float:
    """Probability that Student's t is at least so large in size."""
    if not math.isfinite(t) or freedom <= 0:
        return math.nan
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_part(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_part(b, a, 1 - x) / b


def factor_model(returns: DataFrame, factors: list[str], least: int = 60) -> DataFrame:
    """``(strategy_id, term, coefficient, error, t, p, n, lags, r2)``: each strategy's excess return on the factors, a row per factor and one for ``alpha``.

    ``returns(strategy_id, date, ret, *factors)``, one row a date. Errors allow for unequal variance and for serial
    correlation up to the cube root of the number of dates, with weights that fall to zero there. Rows with a null or NaN in any
    column are left out before lags are counted; strategies with fewer than ``least`` rows give none. Where factors
    are collinear the errors are those of the shortest solution.

    The normal equations are aggregated; for the lags, each date's scores are dealt to the dates that follow it, so
    a task holds no series. Only one small matrix per strategy goes through numpy.
    """
    kind = returns.schema["strategy_id"].dataType.simpleString()
    xs = [f"_x{k}" for k in range(len(factors))]
    b = returns.select("strategy_id", "date", F.col("ret").cast("double").alias("_y"), *[F.col(f).cast("double").alias(x) for f, x in zip(factors, xs, strict=True)])
    m = with_slopes(moments(b, ["strategy_id"], [*xs, "_y"]), "_y", xs).filter(F.col("_n") >= least)
    ok = F.lit(True)
    for c in ("_y", *xs):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    at = F.row_number().over(Window.partitionBy("strategy_id").orderBy("date"))
    # the tiny addition keeps cubes such as 64 from falling under their root
    rows = b.filter(ok).withColumn("_t", at).join(m, "strategy_id").withColumn("_lags", F.floor(F.pow(F.col("_n").cast("double"), 1 / 3) + 1e-12).cast("int"))
    scores = rows.withColumn("_e", F.col("_y") - fitted(xs))
    names = ["_s", *[f"_s{x}" for x in xs]]
    scores = scores.select("strategy_id", "_t", "_lags", F.col("_e").alias("_s"), *[(F.col("_e") * F.col(x)).alias(f"_s{x}") for x in xs])
    later = scores.select("*", F.explode(F.sequence(F.lit(0), "_lags")).alias("_j")).withColumn("_w", F.when(F.col("_j") == 0, 0.5).otherwise(1 - F.col("_j") / (F.col("_lags") + 1)))
    past = later.groupBy("strategy_id", (F.col("_t") + F.col("_j")).alias("_t")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(f"_p{c}") for c in names])
    both = scores.join(past, ["strategy_id", "_t"])
    meat = both.groupBy("strategy_id").agg(F.array(*[F.sum(F.col(a) * F.col(f"_p{c}")) for a in names for c in names]).alias("meat"), F.sum(F.col("_s") * F.col("_s")).alias("sse"), F.max("_lags").alias("lags"))
    pairs = [F.col(f"_v_{xs[min(i, j)]}_{xs[max(i, j)]}") for i in range(len(xs)) for j in range(len(xs))]
    small = m.join(meat, "strategy_id").select("strategy_id", F.col("_n").alias("n"), "lags", "sse", F.col("_v__y__y").alias("vy"), "meat", F.array(*[F.col(f"_m_{x}") for x in xs]).alias("mean"), F.array(*pairs).alias("cov"), F.array("_b_", *[F.col(f"_b_{x}") for x in xs]).alias("beta"))
    terms = ["alpha", *factors]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(terms)
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                mean, cov = np.array(r.mean), np.array(r.cov).reshape(k - 1, k - 1)
                xx = np.empty((k, k))
                xx[0, 0], xx[0, 1:], xx[1:, 0] = 1.0, mean, mean
                xx[1:, 1:] = cov + np.outer(mean, mean)
                scale = 1 / np.sqrt(np.maximum(np.diag(xx), 1e-300))
                inverse = np.linalg.pinv(xx * np.outer(scale, scale), rcond=1e-12, hermitian=True) * np.outer(scale, scale) / r.n
                half = np.array(r.meat).reshape(k, k)
                errors = np.sqrt(np.maximum(np.diag(inverse @ (half + half.T) @ inverse), 0.0))
                r2 = 1 - r.sse / (r.vy * r.n) if r.vy > 0 else math.nan
                for term, b, e in zip(terms, r.beta, errors, strict=True):
                    t = b / e if e > 0 else math.nan
                    out.append((r.strategy_id, term, b, e, t, two_sided(t, r.n - k), r.n, r.lags, r2))
            yield pd.DataFrame(out, columns=["strategy_id", "term", "coefficient", "error", "t", "p", "n", "lags", "r2"])

    return small.mapInPandas(solve, FACTOR_SCHEMA.format(kind=kind))

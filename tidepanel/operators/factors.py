"""Exposure to several factors at once, momentum of the factors carried to the names, and regimes of a market series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, div, std, zscore
from tidepanel.functions.linear_time import with_rolling_sums, with_sliding_ranks


def rolling_betas(bars: DataFrame, factors: DataFrame, columns: list[str], window: int = 252, least: int = 126) -> DataFrame:
    """``bars`` with the factors of the date and ``beta_x`` for each: covariance with the ticker's return over the factor's variance, over the last ``window`` rows with both, ``least`` of them at least.

    ``factors(date, *columns)`` is one row a date. All betas share one pass of running sums. No variance gives null.
    """
    b = bars.join(factors.select("date", *columns), "date")
    sums = {}
    for c in columns:
        r, x = F.when(F.col(c).isNotNull(), F.col("ret")), F.when(F.col("ret").isNotNull(), F.col(c))
        sums |= {f"_n_{c}": (r * x).isNotNull().cast("int"), f"_r_{c}": r, f"_x_{c}_": x, f"_xy_{c}": r * x, f"_xx_{c}": x * x}
    b = with_rolling_sums(b, sums, window)
    out = []
    for c in columns:
        n = F.col(f"_n_{c}")
        cov = F.col(f"_xy_{c}") - F.col(f"_r_{c}") * F.col(f"_x_{c}_") / n
        var = F.col(f"_xx_{c}") - F.col(f"_x_{c}_") * F.col(f"_x_{c}_") / n
        out.append(F.when(n >= least, div(cov, F.when(var > 1e-18, var))).alias(f"beta_{c}"))
    return b.select(*bars.columns, *columns, *out)


def factor_momentum(factors: DataFrame, columns: list[str], window: int = 252, least: int = 126) -> DataFrame:
    """``(date, mom_x)``: the sum of each factor's returns over the last ``window`` dates, from ``least`` returns on. One row a date."""
    frame = Window.orderBy("date").rowsBetween(1 - window, 0)
    return factors.select("date", *[F.when(F.count(c).over(frame) >= least, F.sum(c).over(frame)).alias(f"mom_{c}") for c in columns])


def momentum_signals(betas: DataFrame, momentum: DataFrame, columns: list[str], bound: float = 2.0) -> DataFrame:
    """``(ticker, date, value, value_x)``: the standard score on its date of the sum of beta times momentum over all factors, and of each factor's own product.

    A factor without beta or momentum adds nothing; a row without any has no value. Scores lie within the bound.
    """
    b = betas.join(momentum, "date")
    parts = {c: F.col(f"beta_{c}") * F.col(f"mom_{c}") for c in columns}
    b = b.select("ticker", "date", *[x.alias(f"_p_{c}") for c, x in parts.items()])
    known = F.coalesce(*[F.col(f"_p_{c}") for c in columns]).isNotNull()
    total = sum((F.coalesce(f"_p_{c}", F.lit(0.0)) for c in columns), F.lit(0.0))
    b = b.withColumn("_all", F.when(known, total))
    return b.select("ticker", "date", zscore("_all", bound).alias("value"), *[zscore(f"_p_{c}", bound).alias(f"value_{c}") for c in columns])


def volatility_regime(market: DataFrame, short: int = 21, window: int = 252, least: int = 63, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``(date, vol, rank, regime)`` of ``market(date, ret)``: low_vol or high_vol where the yearly volatility of the last ``short`` returns ranks low or high among those of the last ``window`` dates, else med_vol, also while that is unknown.

    Ranks look back only.
    """
    m = market.select(F.lit(0).alias("ticker"), "date", "ret").withColumn("vol", std("ret", short, short) * TRADING_DAYS**0.5)
    m = with_sliding_ranks(m, {"rank": ("vol", window, least)})
    regime = F.when(F.col("rank") <= low, "low_vol").when(F.col("rank") >= high, "high_vol").otherwise("med_vol")
    return m.select("date", "vol", "rank", regime.alias("regime"))


def strategy_beta(returns: DataFrame, market: DataFrame, window: int = 126) -> DataFrame:
    """``(strategy_id, date, beta)``: rolling beta of each strategy to ``market(date, mkt)`` over dates that both have, from half a window on; dates without one are left out."""
    b = returns.filter("ret is not null").join(market.filter("mkt is not null"), "date").withColumnRenamed("strategy_id", "ticker")
    sums = {"_n": F.lit(1), "_y": F.col("ret"), "_x": F.col("mkt"), "_xy": F.col("ret") * F.col("mkt"), "_xx": F.col("mkt") * F.col("mkt")}
    b = with_rolling_sums(b, sums, window)
    var = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n")
    beta = div(F.col("_xy") - F.col("_y") * F.col("_x") / F.col("_n"), F.when(var > 1e-18, var))
    return b.select(F.col("ticker").alias("strategy_id"), "date", F.when(F.col("_n") >= window // 2, beta).alias("beta")).filter("beta is not null")

"""Signals from a ticker's own history; each takes bars and returns them with the column ``value``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_date, by_ticker, TRADING_DAYS, change, clip, div, lag, mean, momentum, rank_pct, rolling, std, total, zscore
from tidepanel.functions.linear_time import per_ticker, ratio, rolling as rolling_moments, rolling_slope, running_total, values, with_ewm, with_quantiles, with_ranks, with_rolling_sums

YEAR = math.sqrt(TRADING_DAYS)


def _value(bars: DataFrame, x: Column) -> DataFrame:
    return bars.withColumn("value", x)


def _market(bars: DataFrame) -> DataFrame:
    """Adds the equal-weight market return ``mkt`` and the excess ``excess``."""
    m = F.avg("ret").over(by_date())
    return bars.withColumn("mkt", m).withColumn("excess", F.col("ret") - F.col("mkt"))


def momentum_signal(bars: DataFrame, window: int = 21) -> DataFrame:
    return _value(bars, momentum("close", window))


def short_momentum(bars: DataFrame) -> DataFrame:
    return _value(bars, (momentum("close", 5) + momentum("close", 10) + momentum("close", 21)) / 3)


def long_momentum(bars: DataFrame) -> DataFrame:
    return _value(bars, (momentum("close", 63, 21) + momentum("close", 126, 21)) / 2)


def zscore_reversion(bars: DataFrame, window: int = 20) -> DataFrame:
    return _value(bars, -div(F.col("close") - mean("close", window), std("close", window)))


def rolling_rank(bars: DataFrame, column: str = "close", lookback: int = 252, least: int = 60) -> DataFrame:
    """Percentile rank of the current value in its own last rows, ties averaged."""
    frame = F.collect_list(column).over(by_ticker().rowsBetween(1 - lookback, 0))
    x = F.col(column)
    b = bars.withColumn("_frame", frame)
    below = F.size(F.filter("_frame", lambda v: v < x))
    ties = F.size(F.filter("_frame", lambda v: v == x))
    return _value(b, F.when(x.isNotNull() & (F.size("_frame") >= least), (below + (ties + 1) / 2) / F.size("_frame"))).drop("_frame")


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    b = bars.withColumn("_d", F.col("close") - lag("close"))
    b = b.withColumn("_gain", F.greatest(F.col("_d"), F.when(F.col("_d").isNotNull(), 0.0))).withColumn("_loss", F.greatest(-F.col("_d"), F.when(F.col("_d").isNotNull(), 0.0)))
    b = b.withColumn("_seen", F.count("_d").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) >= window)
    b = with_ewm(b, {"_g": ("_gain", 1 / window, False), "_l": ("_loss", 1 / window, False)})
    return _value(b, F.when(F.col("_seen"), 50 - (100 - 100 / (1 + div("_g", "_l"))))).drop("_d", "_gain", "_loss", "_g", "_l", "_seen")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, span: int = 9) -> DataFrame:
    b = with_ewm(bars, {"_fast": ("close", 2 / (fast + 1), False), "_slow": ("close", 2 / (slow + 1), False)}).withColumn("_macd", F.col("_fast") - F.col("_slow"))
    return _value(with_ewm(b, {"_line": ("_macd", 2 / (span + 1), False)}), F.col("_macd") - F.col("_line")).drop("_fast", "_slow", "_macd", "_line")


def ema_smooth(bars: DataFrame, column: str = "ret", halflife: float = 5.0) -> DataFrame:
    alpha = 1 - 0.5 ** (1 / halflife)
    return with_ewm(bars, {"value": (column, alpha, True)})


def fill_forward(bars: DataFrame, column: str = "close", limit: int = 180) -> DataFrame:
    """The last non-null value, carried at most ``limit`` rows."""
    return _value(bars, F.last(column, ignorenulls=True).over(by_ticker().rowsBetween(-limit, 0)))


def realized_volatility(bars: DataFrame, window: int = 21) -> DataFrame:
    return _value(bars, std("ret", window) * YEAR)


def volatility_regime(bars: DataFrame, short: int = 10, long: int = 60) -> DataFrame:
    return _value(bars, -div(std("ret", short), std("ret", long)))


def price_to_high(bars: DataFrame, window: int = 252) -> DataFrame:
    b = bars.withColumn("_p", lag("close"))
    return _value(b, div("_p", rolling(F.max, "_p", window))).drop("_p")


def max_return(bars: DataFrame, window: int = 21) -> DataFrame:
    b = bars.withColumn("_r", change("close")).withColumn("_r", lag("_r"))
    return _value(b, -rolling(F.max, "_r", window)).drop("_r")


def amihud(bars: DataFrame, window: int = 21) -> DataFrame:
    b = bars.withColumn("_i", div(F.abs("ret"), F.col("close") * F.col("volume")))
    return _value(b, mean("_i", window)).drop("_i")


def idiosyncratic_volatility(bars: DataFrame, window: int = 21) -> DataFrame:
    return _value(_market(bars), -std("excess", window))


def volume_spike(bars: DataFrame, window: int = 20) -> DataFrame:
    return _value(bars, div("volume", mean("volume", window)))


def volume_price_trend(bars: DataFrame, window: int = 20) -> DataFrame:
    b = bars.withColumn("_v", change("close") * F.col("volume")).withColumn("_t", total("_v", window))
    return _value(b, div(F.col("_t") - mean("_t", 3 * window, window), std("_t", 3 * window, window))).drop("_v", "_t")


def market_beta(bars: DataFrame, window: int = 63) -> DataFrame:
    """Minus (E[xy] - E[x]E[y]) / var(m): the covariance is of degree 0, the variance of degree 1."""
    b = _market(bars).withColumn("_xy", F.col("ret") * F.col("mkt"))
    return _value(b, -div(mean("_xy", window) - mean("ret", window) * mean("mkt", window), rolling(F.var_samp, "mkt", window))).drop("_xy")


def obv(bars: DataFrame, window: int = 20) -> DataFrame:
    b = bars.withColumn("_s", F.coalesce(F.signum("ret") * F.col("volume"), F.lit(0.0))).withColumn("_o", F.sum("_s").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    return _value(b, div(F.col("_o") - mean("_o", 3 * window, window), std("_o", 3 * window, window))).drop("_s", "_o")


def bollinger(bars: DataFrame, window: int = 20, n_std: float = 2.0) -> DataFrame:
    ma, sd = mean("close", window), std("close", window)
    return _value(bars, -div(F.col("close") - (ma - n_std * sd), 2 * n_std * sd))


def residual_momentum(bars: DataFrame, window: int = 21) -> DataFrame:
    b = _market(bars).withColumn("_x", lag("excess"))
    return _value(b, total("_x", window)).drop("_x")


def price_acceleration(bars: DataFrame, window: int = 21) -> DataFrame:
    return _value(bars, momentum("close", window) - momentum("close", window, 1 + window))


def volume_trend(bars: DataFrame, window: int = 21) -> DataFrame:
    b = bars.withColumn("_m", mean("volume", window)).withColumn("_g", change("_m", window))
    return _value(b, div(F.col("_g") - mean("_g", 3 * window, window), std("_g", 3 * window, window))).drop("_m", "_g")


def efficiency_ratio(bars: DataFrame, window: int = 21) -> DataFrame:
    b = bars.withColumn("_d", F.abs(F.col("close") - lag("close")))
    return _value(b, div(F.abs(F.col("close") - lag("close", window)), total("_d", window))).drop("_d")


def ma_distance(bars: DataFrame, window: int = 50) -> DataFrame:
    return _value(bars, -div(F.col("close") - mean("close", window), mean("close", window)))


def vol_of_vol(bars: DataFrame, short: int = 5, long: int = 21) -> DataFrame:
    return _value(bars.withColumn("_v", std("ret", short)), -std("_v", long)).drop("_v")


def tail_risk(bars: DataFrame, window: int = 21, share: float = 0.05) -> DataFrame:
    b = bars.withColumn("_r", lag("ret"))
    return _value(b, -rolling(lambda x: F.percentile(x, share), "_r", window)).drop("_r")


def short_reversal(bars: DataFrame, window: int = 5) -> DataFrame:
    b = bars.withColumn("_r", lag("ret"))
    return _value(b, -total("_r", window, 1)).drop("_r")


def volume_reversal(bars: DataFrame, window: int = 20) -> DataFrame:
    b = bars.withColumn("_a", mean("volume", window))
    return _value(b, -lag("ret") * clip(div(lag("volume"), lag("_a")), 0.5, 3.0)).drop("_a")


def sector_relative_momentum(bars: DataFrame, sectors: DataFrame, window: int = 63, least: int = 3) -> DataFrame:
    """Rolling lagged return less that of the sector's mean; absolute in sectors of fewer than ``least`` tickers."""
    by_day = Window.partitionBy("date", "sector")
    sizes = sectors.groupBy("sector").agg(F.count("*").alias("_n"))
    b = bars.join(sectors.select("ticker", "sector"), "ticker").join(sizes, "sector").withColumn("_r", lag("ret"))
    b = b.withColumn("_s", F.avg("_r").over(by_day))
    own = total("_r", window)
    return _value(b, F.when(F.col("_n") >= least, own - total("_s", window)).otherwise(own)).drop("_r", "_s", "_n", "sector")


def hurst(bars: DataFrame, window: int = 63, n: int = 10) -> DataFrame:
    def work(t):
        x = values(t, "_l")
        sums = running_total(np.column_stack([np.nan_to_num(x), ~np.isnan(x)]), n)
        ten = np.where(sums[:, 1] >= n, sums[:, 0], np.nan)
        return [ratio(rolling_moments(ten, window)[1], n * rolling_moments(x, window)[1])]

    b = bars.withColumn("_l", F.ln(div("close", lag("close"))))
    b = per_ticker(b, ["_q"], work, ["_l"], bars.columns)
    return _value(b, clip(0.5 * F.log2(F.when(F.col("_q").isNotNull(), F.greatest("_q", F.lit(1e-6)))), 0.0, 1.0)).drop("_q")


def realized_skewness(bars: DataFrame, window: int = 21) -> DataFrame:
    b = bars.withColumn("_2", F.col("ret") ** 2).withColumn("_3", F.col("ret") ** 3)
    return _value(b, -div(mean("_3", window), F.pow(mean("_2", window), F.lit(1.5)))).drop("_2", "_3")


def signed_jumps(bars: DataFrame, window: int = 21, threshold: float = 4.0) -> DataFrame:
    b = bars.withColumn("_s", std("ret", window))
    jump = F.coalesce(F.abs("ret") > threshold * F.col("_s"), F.lit(False))
    return _value(b.withColumn("_j", F.when(F.col("ret").isNotNull(), F.when(jump, F.signum("ret") * F.col("ret") ** 2).otherwise(0.0))), total("_j", window)).drop("_s", "_j")


def down_up_ratio(bars: DataFrame, window: int = 63) -> DataFrame:
    b = bars.withColumn("_d", F.when(F.col("ret") < 0, F.col("ret") ** 2).when(F.col("ret").isNotNull(), 0.0)).withColumn("_u", F.when(F.col("ret") > 0, F.col("ret") ** 2).when(F.col("ret").isNotNull(), 0.0))
    return _value(b, div(F.sqrt(total("_d", window)), F.sqrt(total("_u", window)))).drop("_d", "_u")


def tail_dependence(bars: DataFrame, window: int = 126, q: float = 0.1) -> DataFrame:
    """Days on which ticker and market are both in their lower tails, against the number expected of full dependence."""
    b = _market(bars)
    b = with_quantiles(b, {"_i": ("ret", window, q, window // 2), "_m": ("mkt", window, q, window // 2)})
    joint = F.when((F.col("ret") <= F.col("_i")) & (F.col("mkt") <= F.col("_m")), 1.0).otherwise(0.0)
    return _value(b.withColumn("_j", joint), total("_j", window) / (q * window)).drop("_i", "_m", "_j")


def rolling_covariance_beta(bars: DataFrame, window: int = 126, least: int = 60) -> DataFrame:
    """Sample covariance with the market over its sample variance."""
    return per_ticker(_market(bars), ["value"], lambda t: [rolling_slope(values(t, "ret"), values(t, "mkt"), window, least)], ["ret", "mkt"])


def coskewness(bars: DataFrame, window: int = 126) -> DataFrame:
    """Minus E[e m2] / (sd(r) var(m)) of deviations from rolling means."""

    def work(t):
        r, m = values(t, "ret"), values(t, "mkt")
        (r_mean, r_var), (m_mean, m_var) = rolling_moments(r, window), rolling_moments(m, window)
        return [-ratio(rolling_moments((r - r_mean) * (m - m_mean) ** 2, window)[0], np.sqrt(r_var) * m_var)]

    return per_ticker(_market(bars), ["value"], work, ["ret", "mkt"])


def semi_betas(bars: DataFrame, window: int = 126) -> DataFrame:
    """The concordant and mixed semi-betas n, p, mp, mn, each a share of the market's second moment."""
    b = _market(bars)
    neg, pos = lambda x: F.least(F.col(x), F.lit(0.0)), lambda x: F.greatest(F.col(x), F.lit(0.0))
    parts = {"n": neg("ret") * neg("mkt"), "p": pos("ret") * pos("mkt"), "mn": -neg("ret") * pos("mkt"), "mp": -pos("ret") * neg("mkt")}
    sums = {f"_{name}": F.when(F.col("ret").isNotNull(), x) for name, x in {**parts, "m2": F.col("mkt") ** 2}.items()}
    b = with_rolling_sums(b, sums | {"_seen": F.col("ret").isNotNull().cast("int")}, window)
    b = b.select("*", *[F.when(F.col("_seen") >= window // 2, div(f"_{p}", "_m2")).alias(f"beta_{p}") for p in parts])
    return _value(b, F.col("beta_n") - F.col("beta_mn")).drop(*sums, "_seen")


def factor_momentum(series: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Compound return of ``ret`` over lookback less skip rows, skip rows ago."""
    n = lookback - skip
    b = series.withColumn("_l", F.log1p("ret")).withColumn("_s", total("_l", n, n))
    return _value(b, F.expm1(lag("_s", skip))).drop("_l", "_s")


def drawdown(bars: DataFrame, column: str = "close") -> DataFrame:
    return _value(bars, div(column, F.max(column).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))) - 1)


def rolling_sharpe(bars: DataFrame, window: int = 126) -> DataFrame:
    return _value(bars, div(mean("ret", window, window), std("ret", window, window)) * YEAR)


def wealth(bars: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Cumulative product of 1 + ret, floored so that a total loss stays near zero."""
    growth = F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999999))
    b = bars.withColumn("_g", F.log1p(growth))
    return _value(b, initial * F.exp(F.sum("_g").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))).drop("_g")


def change_rank(bars: DataFrame, column: str = "volume", lookback: int = 5) -> DataFrame:
    """Rank on its date of the change of log1p(column), to nine decimals so that equal changes tie."""
    b = bars.withColumn("_c", F.round(F.log1p(column) - F.log1p(lag(column, lookback)), 9))
    return _value(b, rank_pct("_c")).drop("_c")


def momentum_rank(bars: DataFrame, window: int = 252, skip: int = 21) -> DataFrame:
    return _value(bars.withColumn("_m", momentum("close", window - skip, skip)), rank_pct("_m")).drop("_m")


def leave_one_out_sector(bars: DataFrame, sectors: DataFrame, window: int = 63) -> DataFrame:
    """Mean rolling return of the others in the ticker's sector on that date."""
    b = bars.join(sectors.select("ticker", "sector"), "ticker").withColumn("_s", total("ret", window))
    group = Window.partitionBy("date", "sector")
    return _value(b, div(F.sum("_s").over(group) - F.col("_s"), F.count("_s").over(group) - 1)).drop("_s", "sector")


def forward_return(bars: DataFrame, window: int = 5) -> DataFrame:
    """Sum of the next ``window`` returns; null on the last rows."""
    frame = by_ticker().rowsBetween(1, window)
    return _value(bars, F.when(F.count("ret").over(frame) == window, F.sum("ret").over(frame)))


def dollar_volume(bars: DataFrame, window: int = 30, least: int = 10) -> DataFrame:
    return _value(bars.withColumn("_d", F.col("close") * F.col("volume")), mean("_d", window, least)).drop("_d")


def trend_regime(bars: DataFrame, window: int = 200) -> DataFrame:
    """1 above the moving average, -1 below, 0 while that is unknown."""
    ma = mean("close", window, window // 2)
    return _value(bars, F.when(ma.isNull(), 0).when(F.col("close") > ma, 1).otherwise(-1))


def spells(bars: DataFrame, state: str = "value") -> DataFrame:
    """Runs of equal state per ticker: first and last date and length."""
    b = bars.withColumn("_new", (~F.col(state).eqNullSafe(lag(state))).cast("int")).withColumn("_run", F.sum("_new").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("ticker", "_run", state).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("length")).drop("_run")


def month_season(bars: DataFrame, first: int = 1, last: int = 4) -> DataFrame:
    """Mean return of the same calendar month in earlier years of a monthly table, two at least."""
    past = [lag("ret", 12 * k) for k in range(first, last + 1)]
    n = sum((p.isNotNull().cast("int") for p in past), F.lit(0))
    return _value(bars, F.when(n >= 2, sum((F.coalesce(p, F.lit(0.0)) for p in past), F.lit(0.0)) / n))


def lottery(bars: DataFrame, window: int = 21) -> DataFrame:
    """Minus (z of idiosyncratic volatility + z of idiosyncratic skew - z of price), per date."""
    b = _market(bars).withColumn("_2", F.col("excess") ** 2).withColumn("_3", F.col("excess") ** 3)
    b = b.withColumn("_v", std("excess", window)).withColumn("_k", div(mean("_3", window), F.pow(mean("_2", window), F.lit(1.5))))
    return _value(b, -(zscore("_v", None) + zscore("_k", None) - zscore("close", None))).drop("_2", "_3", "_v", "_k")


def mean_reversion(bars: DataFrame) -> DataFrame:
    """Mean of the ranks of the reversion score and the RSI."""
    b = zscore_reversion(bars).withColumnRenamed("value", "_z")
    b = with_ranks(rsi(b).withColumnRenamed("value", "_r"), {"_zr": "_z", "_rr": "_r"}, kept=bars.columns)
    return _value(b, (F.col("_zr") + F.col("_rr")) / 2).drop("_zr", "_rr")



"""Signals from option summaries ``(ticker, date, ret, iv7 ... iv365, slope, ...)``: a projection each, ranked on the date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, div, std
from tidepanel.functions.linear_time import with_ranks


def forward_volatility(near: str, near_days: int, far: str, far_days: int) -> Column:
    """Volatility between two tenors; a negative forward variance counts as zero."""
    variance = (F.col(far) ** 2 * far_days - F.col(near) ** 2 * near_days) / (far_days - near_days)
    return F.when(F.col(near).isNotNull() & F.col(far).isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))))


def realized(window: int) -> Column:
    """Yearly volatility of the last ``window`` returns, all of them known."""
    return std("ret", window, window) * F.sqrt(F.lit(float(TRADING_DAYS)))


#: Name to the value whose rank is the signal; high ranks are the favoured ones.
SIGNALS: dict[str, Callable[[], Column]] = {
    "smile_slope": lambda: F.col("slope"),
    "call_put_spread": lambda: F.col("cp_spread"),
    "realized_less_implied": lambda: realized(21) - F.col("iv30"),
    "variance_premium": lambda: realized(21) ** 2 - F.col("iv30") ** 2,
    "term_slope": lambda: F.col("iv60") - F.col("iv30"),
    "term_convexity": lambda: -(F.col("iv30") - 2 * F.col("iv60") + F.col("iv90")),
    "short_slope": lambda: F.col("iv30") - F.col("iv7"),
    "long_slope": lambda: F.col("iv365") - F.col("iv90"),
    "implied_move": lambda: -F.col("implied_move"),
    "implied_skew": lambda: F.col("implied_skew"),
    "implied_kurtosis": lambda: F.col("implied_kurt"),
    "forward_slope": lambda: -(forward_volatility("iv60", 60, "iv90", 90) - forward_volatility("iv30", 30, "iv60", 60)),
    "realized_less_forward": lambda: realized(30) - forward_volatility("iv30", 30, "iv60", 60),
    "long_forward_premium": lambda: -(forward_volatility("iv90", 90, "iv180", 180) - F.col("iv30")),
    "risk_reversal": lambda: -(F.col("call25") - F.col("put25")),
    "crash_risk": lambda: F.col("put5") - F.col("iv30"),
    "call_share": lambda: div("call_oi", F.col("call_oi") + F.col("put_oi")),
    "event_premium": lambda: -(F.col("iv30") - F.col("event_free_iv30")),
}


def signal(panel: DataFrame, name: str) -> DataFrame:
    """One signal as ``value``."""
    return with_ranks(panel.withColumn("_x", F.round(SIGNALS[name](), 9)), {"value": "_x"}, kept=[c for c in panel.columns if c != "value"])


def signals(panel: DataFrame, names: list[str]) -> DataFrame:
    """Several signals, a column each; the ticker's windows share one exchange, the date's ranks another."""
    raw = panel.withColumns({f"_{n}": F.round(SIGNALS[n](), 9) for n in names})
    return with_ranks(raw, {n: f"_{n}" for n in names}, kept=["ticker", "date"])

"""Formulas of costs, option volatilities and taxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.columns import clip, col, div


def tiered_cost(notional: Column | str, adv: Column | str, slippage_bps: float = 0.2) -> Column:
    """Cost of a trade by tiers of average daily dollar volume; unknown volume counts as the third tier."""
    a = col(adv)
    bps = F.when(a.isNull() | (a <= 0), 8.0).when(a >= 20e6, 1.0).when(a >= 5e6, 3.0).when(a >= 1e6, 8.0).otherwise(20.0)
    return F.abs(col(notional)) * (bps + slippage_bps) / 10_000


def liquidity_cost(notional: Column | str, adv: Column | str, base_bps: float = 10.0) -> Column:
    """Cost whose spread falls with the root of dollar volume in millions, 1 to 50 basis points."""
    bps = clip(base_bps * 5 / F.sqrt(F.greatest(col(adv) / 1e6, F.lit(1e-6))), 1.0, 50.0)
    return F.abs(col(notional)) * bps / 10_000


def forward_volatility(short: Column | str, long: Column | str, t_short: float, t_long: float) -> Column:
    """Volatility between two maturities; null where the variance would be negative."""
    v = (col(long) ** 2 * t_long - col(short) ** 2 * t_short) / (t_long - t_short)
    return F.when(v >= 0, F.sqrt(v))


def variance_time(t1: Column | str, v1: Column | str, t2: Column | str, v2: Column | str, t: float) -> Column:
    """Volatility at t, linear in total variance between two maturities; the known one where the other is missing."""
    a, b, x, y = col(t1), col(t2), col(v1), col(v2)
    w = div(F.lit(t) - a, b - a)
    total = x**2 * a + w * (y**2 * b - x**2 * a)
    return F.when(x.isNull(), y).when(y.isNull() | (a == b), x).otherwise(F.when(total >= 0, F.sqrt(total / t)))


def call_delta(delta: Column | str, kind: Column | str) -> Column:
    return F.when(col(kind) == "p", 1 + col(delta)).otherwise(col(delta))


def mid_price(bid: Column | str, ask: Column | str) -> Column:
    return F.when((col(bid) > 0) & (col(ask) > 0), (col(bid) + col(ask)) / 2)


def defer_sale(gain: Column | str, days_held: Column | str, value: Column | str, st: float = 0.328, lt: float = 0.188, decay: float = 0.0002) -> Column:
    """Whether waiting for the long-term rate, at most 60 days, saves more tax than the decay costs."""
    wait = 365 - col(days_held)
    return (wait > 0) & (wait <= 60) & (col(gain) > 0) & (col(gain) * (st - lt) > col(value) * decay * wait)

"""Column expressions for panels keyed by date and ticker: rolling windows of a ticker, cross-sections of a date.

Missing values are NULL, as in the inputs; a rolling value needs a minimum of non-null rows in its frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_ticker() -> WindowSpec:
    """A ticker's rows in date order; made on call, for a window needs a running session."""
    return Window.partitionBy("ticker").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: Column | str, n: int = 1) -> Column:
    """The ticker's value n rows back; negative n looks ahead."""
    return F.lag(col(x), n).over(by_ticker()) if n >= 0 else F.lead(col(x), -n).over(by_ticker())


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def rolling(f: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the ticker's last n rows, null with fewer than ``least`` (default n // 2) values."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(col(x)).over(frame) >= (n // 2 if least is None else least), f(col(x)).over(frame))


def mean(x: Column | str, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, x, n, least)


def std(x: Column | str, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp, x, n, least)


def total(x: Column | str, n: int, least: int | None = None) -> Column:
    return rolling(F.sum, x, n, least)


def clip(x: Column | str, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def change(x: Column | str, n: int = 1) -> Column:
    """Relative change against n rows back."""
    return div(x, lag(x, n)) - 1


def momentum(x: Column | str, n: int, skip: int = 1) -> Column:
    """Change over n rows that ended ``skip`` rows ago."""
    return div(lag(x, skip), lag(x, skip + n)) - 1


def rank_pct(x: Column | str, by: str | list[str] = "date") -> Column:
    """Rank among the non-null values of a date, ties averaged, divided by their number; null stays null.

    The mean of the ranks from either end; every window is by the same key, so any number of ranks takes one shuffle.
    """
    group = Window.partitionBy(*([by] if isinstance(by, str) else by))
    n = F.count(col(x)).over(group)
    up, down = F.rank().over(group.orderBy(F.asc_nulls_last(col(x)))), F.rank().over(group.orderBy(F.desc_nulls_last(col(x))))
    return F.when(col(x).isNotNull(), (up + n + 1 - down) / 2 / n)


def zscore(x: Column | str, bound: float | None = 4.0, by: str | list[str] = "date") -> Column:
    """Standard score within a date, within +-bound; null where the date has no spread."""
    group = Window.partitionBy(*([by] if isinstance(by, str) else by))
    z = div(col(x) - F.avg(col(x)).over(group), F.stddev_samp(col(x)).over(group))
    return z if bound is None else clip(z, -bound, bound)


def demean(x: Column | str, by: str | list[str] = "date") -> Column:
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*([by] if isinstance(by, str) else by)))


def residual(y: Column | str, x: Column | str, least: int = 10, strength: float = 1.0, by: str = "date") -> Column:
    """y less ``strength`` times its line on x within a date; y itself where fewer than ``least`` pairs exist."""
    group = Window.partitionBy(by)
    both = col(x).isNotNull() & col(y).isNotNull()
    slope, level = F.regr_slope(col(y), col(x)).over(group), F.regr_intercept(col(y), col(x)).over(group)
    fitted = col(y) - strength * (level + slope * col(x))
    return F.when((F.count(F.when(both, 1)).over(group) >= least) & slope.isNotNull() & both, fitted).otherwise(col(y))


def _polynomial(x: Column, *factors: float) -> Column:
    """Horner's form, the highest power's factor first."""
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def norm_cdf(x: Column | str) -> Column:
    """Standard normal distribution function: Hart's rational form, and a continued fraction in the tails; exact to about 1e-15."""
    z = F.abs(col(x))
    # fixed values of that formula
    over = _polynomial(z, 0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    under = _polynomial(z, 0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    tail = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    upper = F.exp(-z * z / 2) * F.when(z < 7.07106781186547, over / under).otherwise(1 / (tail * 2.506628274631))
    return F.when(col(x) >= 0, 1 - upper).otherwise(upper)


def norm_ppf(p: Column | str) -> Column:
    """Inverse of the standard normal distribution function: Acklam's rational form and one step of Halley's method; exact to about 1e-14."""
    q = col(p)
    # fixed values of that formula
    r = (q - 0.5) * (q - 0.5)
    middle = (q - 0.5) * _polynomial(r, -39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    middle = middle / _polynomial(r, -54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    t = F.sqrt(-2 * F.ln(F.least(q, 1 - q)))
    tail = _polynomial(t, -0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    tail = tail / _polynomial(t, 0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    start = F.when(q < 0.02425, tail).when(q > 1 - 0.02425, -tail).otherwise(middle)
    off = (norm_cdf(start) - q) * 2.5066282746310002 * F.exp(start * start / 2)
    return F.when((q > 0) & (q < 1), start - off / (1 + start * off / 2))

"""Market series on the trading calendar, and returns' exposure to them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_ticker, change, clip, div, lag, mean, momentum, std
from tidepanel.functions.linear_time import with_ranks, with_rolling_sums


def on_calendar(bars: DataFrame, series: DataFrame, names: dict[str, str]) -> DataFrame:
    """``(ticker, date, one column per series)``: each of ``names`` (column to series id) at every trading date, the last known value carried on.

    ``ticker`` is zero, so that the expressions of a ticker's windows apply. One row per date, whatever the panel's width.
    """
    wide = series.groupBy("date").agg(*[F.max(F.when(F.col("series_id") == k, F.col("value"))).alias(c) for c, k in names.items()])
    days = bars.select("date").distinct().join(wide, "date", "left").withColumn("ticker", F.lit(0))
    past = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    return days.select("ticker", "date", *[F.last(c, ignorenulls=True).over(past).alias(c) for c in names])


def difference(x: str, n: int = 1) -> Column:
    return F.col(x) - lag(x, n)


def spread_on(bars: DataFrame, calendar: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Calendar columns beside every ticker's rows; the calendar is one row per date."""
    return bars.join(calendar.select("date", *columns), "date")


def beta(panel: DataFrame, x: str, window: int = 756, least: int = 252) -> DataFrame:
    """Mean product less the product of means of the returns and ``x`` over the variance of ``x``, on the ticker's own rows."""
    r, x = F.col("ret"), F.col(x)
    sums = {"_r": r, "_x": x, "_xy": r * x, "_xx": x * x}
    b = with_rolling_sums(panel, sums | {f"_n{n}": v.isNotNull().cast("int") for n, v in sums.items()}, window)
    average = {n: F.when(F.col(f"_n{n}") >= least, F.col(n) / F.col(f"_n{n}")) for n in sums}
    count = F.col("_n_x")
    variance = F.when(count > 1, (F.col("_xx") - F.col("_x") * F.col("_x") / count) / (count - 1))
    out = div(average["_xy"] - average["_r"] * average["_x"], F.when((count >= least) & (variance > 0), variance))
    return b.select(*panel.columns, out.alias("beta"))


def ranked(panel: DataFrame, x: Column) -> DataFrame:
    return with_ranks(panel.withColumn("_x", F.round(x, 9)), {"value": "_x"}, kept=[c for c in panel.columns if c != "value"])


def regime(x: Column) -> Column:
    """Sign of x, zero where it is not known."""
    return F.coalesce(F.signum(x), F.lit(0.0))


def currency_regime(bars: DataFrame, calendar: DataFrame, window: int = 756, least: int = 252) -> DataFrame:
    """Negative beta to the changes of ``a``, turned by the sign of its change over 63 days."""
    c = calendar.withColumns({"x": change("a"), "sign": regime(change("a", 63))})
    return ranked(beta(spread_on(bars, c, ["x", "sign"]), "x", window, least), -F.col("beta") * F.col("sign"))


def volatility_features(bars: DataFrame, calendar: DataFrame, window: int = 252) -> DataFrame:
    """Slope of ``b`` over ``a``, share of the last ``window`` days not above today's ``a``, and its change over five days, beside every row."""
    frame = F.collect_list("a").over(by_ticker().rowsBetween(1 - window, 0))
    share = F.try_divide(F.size(F.filter(frame, lambda v: v <= F.col("a"))), F.size(frame))
    c = calendar.withColumns({"term_slope": div("b", "a") - 1, "percentile": share, "change_5d": change("a", 5)})
    return spread_on(bars, c, ["term_slope", "percentile", "change_5d"])


def ratio_regime(bars: DataFrame, calendar: DataFrame, window: int = 1260, least: int = 252) -> DataFrame:
    """Of the ratio of ``a`` to ``b``: its year's standard score, its change over 63 days, and the ranked beta to its changes."""
    r = calendar.withColumn("ratio", div("a", "b"))
    z = clip(div(F.col("ratio") - mean("ratio", 252, 63), std("ratio", 252, 63)), -4.0, 4.0)
    c = r.withColumns({"z": z, "roc": change("ratio", 63), "x": change("ratio")})
    return ranked(beta(spread_on(bars, c, ["z", "roc", "x"]), "x", window, least), F.col("beta"))


def spread_beta(bars: DataFrame, calendar: DataFrame, window: int = 756, least: int = 252) -> DataFrame:
    """Ranked beta to the changes of ``a`` less ``b``."""
    c = calendar.withColumn("gap", F.col("a") - F.col("b")).withColumn("x", difference("gap"))
    return ranked(beta(spread_on(bars, c, ["x"]), "x", window, least), F.col("beta"))


def year_momentum(bars: DataFrame, calendar: DataFrame, columns: list[str]) -> DataFrame:
    """Each series' change over a year up to a month ago, beside every row."""
    return spread_on(bars, calendar.withColumns({f"mom_{c}": momentum(c, 231, 21) for c in columns}), [f"mom_{c}" for c in columns])


def signed_beta(bars: DataFrame, calendar: DataFrame, window: int = 1260, least: int = 252) -> DataFrame:
    """Beta to the differences of ``a``, turned by the sign of the day's difference, ranked."""
    c = calendar.withColumn("x", difference("a")).withColumn("sign", regime(F.col("x")))
    return ranked(beta(spread_on(bars, c, ["x", "sign"]), "x", window, least), F.col("beta") * F.col("sign"))


def momentum_beta(bars: DataFrame, calendar: DataFrame, window: int = 1260, least: int = 252) -> DataFrame:
    """Beta to the changes of ``a``, turned by the sign of its change over 21 days, ranked."""
    c = calendar.withColumns({"x": change("a"), "sign": regime(change("a", 21))})
    return ranked(beta(spread_on(bars, c, ["x", "sign"]), "x", window, least), F.col("beta") * F.col("sign"))


def ratio_change(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """The ratio of ``a`` to ``b`` and its difference over five days, beside every row."""
    c = calendar.withColumn("ratio", div("a", "b")).withColumn("ratio_5d", difference("ratio", 5))
    return spread_on(bars, c, ["ratio", "ratio_5d"])


def sector_spread(bars: DataFrame, sectors: DataFrame, calendar: DataFrame, cyclical: list[str]) -> DataFrame:
    """Fall of a sector's credit spread over 21 days, ranked: series ``a`` for the ``cyclical`` sectors, ``b`` for others."""
    c = calendar.withColumns({"fall_a": -difference("a", 21), "fall_b": -difference("b", 21)})
    b = spread_on(bars, c, ["fall_a", "fall_b"]).join(sectors.select("ticker", "sector"), "ticker")
    return ranked(b, F.when(F.col("sector").isin(cyclical), F.col("fall_a")).otherwise(F.col("fall_b")))


def difference_beta(bars: DataFrame, calendar: DataFrame, window: int = 756, least: int = 252) -> DataFrame:
    """Ranked beta to the differences of ``a``."""
    return ranked(beta(spread_on(bars, calendar.withColumn("x", difference("a")), ["x"]), "x", window, least), F.col("beta"))

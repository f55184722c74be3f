"""Books of positions and orders, their alignment with dates, and set operations on keyed tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_date, clip, div, lag, mean, rank_pct, rolling
from tidepanel.functions.linear_time import per_ticker, ratio, rolling as rolling_moments, values, with_ranks


def first_days(calendar: DataFrame) -> DataFrame:
    """The first trading day of each month."""
    return calendar.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date"))


def holdings(weights: DataFrame, least: float = 0.001) -> DataFrame:
    """Positions above a least weight on the last date, with their place by weight."""
    last = weights.agg(F.max("date").alias("date"))
    held = weights.join(F.broadcast(last), "date").filter(F.col("weight") > least)  # one row
    return held.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("weight"), "ticker")))


def force_names(book: DataFrame, forced: Column, score: str, least_rank: float = 0.6, share: float = 0.03) -> DataFrame:
    """Marked names without a weight whose score ranks high get a fixed share; the others make room and all sum to one."""
    ranked = book.withColumn("_r", rank_pct(score))
    take = ranked.withColumn("_f", forced & (F.coalesce("weight", F.lit(0.0)) == 0) & (F.coalesce("_r", F.lit(0.0)) >= least_rank))
    n = F.sum(F.col("_f").cast("int")).over(by_date())
    raw = take.withColumn("_w", F.when(F.col("_f"), share).otherwise(F.coalesce("weight", F.lit(0.0)) * F.greatest(F.lit(0.0), 1 - share * n)))
    whole = F.sum("_w").over(by_date())
    return raw.withColumn("value", F.when((n > 0) & (whole > 0), F.col("_w") / whole).otherwise(F.col("_w")))


def scale_to_own_volatility(weights: DataFrame, target: float = 0.2, low: float = 0.5, high: float = 1.5, lookback: int = 126, least: int = 60) -> DataFrame:
    """Leverage per date from the book's own past volatility, one row late; 1 until there is one. ``weights(ticker, date, weight, ret)``."""
    book = weights.withColumn("c", lag("weight") * F.col("ret")).groupBy("date").agg(F.sum("c").alias("ret")).withColumn("ticker", F.lit(0))
    vol = book.withColumn("vol", rolling(F.stddev_samp, "ret", lookback, least) * F.sqrt(F.lit(252.0)))
    return vol.withColumn("lever", clip(div(F.lit(target), "vol"), low, high)).withColumn("value", F.coalesce(lag("lever"), F.lit(1.0))).select("date", "value")


def canary(orders: DataFrame, most: float = 500.0, per_day: int = 5) -> DataFrame:
    """Verdict on ``orders(day, seq, notional)``: too large are capped, of the rest the first of each day are accepted, others deferred."""
    capped = F.col("notional") > most
    place = F.row_number().over(Window.partitionBy("day", capped).orderBy("seq"))
    return orders.withColumn("verdict", F.when(capped, "capped").when(place <= per_day, "accepted").otherwise("deferred"))


def query_fills(fills: DataFrame, side: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fills of a side and of a time range, both ends included; what is not given does not filter."""
    out = fills if side is None else fills.filter(F.col("side") == side)
    out = out if start is None else out.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def status_history(rows: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Rows of a key in order, each with the status before it; only those where it changes."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col(status)))


def slippage_bps(fills: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Cost of each fill against the expected price of its key, in basis points; a sale above it is a gain."""
    both = fills.join(expected, key).filter((F.col("expected") != 0) & (F.col("qty") > 0) & (F.col("price") > 0))
    sign = F.when(F.col("side") == "SELL", -1.0).otherwise(1.0)
    return both.withColumn("bps", sign * (F.col("price") - F.col("expected")) / F.col("expected") * 10_000)


def blend(rule: DataFrame, learnt: DataFrame, weight: float = 0.5) -> DataFrame:
    """Rank of the blend of two signals ``(ticker, date, value)`` where both are present."""
    both = rule.join(learnt.select("ticker", "date", F.col("value").alias("_l")), ["ticker", "date"])
    return both.withColumn("_b", F.round((1 - weight) * F.col("value") + weight * F.col("_l"), 9)).withColumn("value", rank_pct("_b")).drop("_l", "_b")


def prior_book(weights: DataFrame, before: Column) -> DataFrame:
    """Rows of the latest date strictly before a day."""
    earlier = weights.filter(F.col("date") < before)
    return earlier.join(F.broadcast(earlier.agg(F.max("date").alias("date"))), "date")  # one row


def trade_date(dates: DataFrame, calendar: DataFrame, reach: int = 5) -> DataFrame:
    """``dates(date)`` with the nearest trading day on or after, else before, within ``reach`` calendar days."""
    near = F.explode(F.sequence(F.date_sub("date", reach), F.date_add("date", reach))).alias("day")
    hits = dates.select("date", near).join(calendar.select(F.col("date").alias("day")), "day")
    after, before = F.when(F.col("day") >= F.col("date"), F.col("day")), F.when(F.col("day") < F.col("date"), F.col("day"))
    return hits.groupBy("date").agg(F.coalesce(F.min(after), F.max(before)).alias("trade_date"))


def coskewness_signal(bars: DataFrame, market: DataFrame, lookback: int = 60, least: int = 24) -> DataFrame:
    """Rank of negated coskewness with the market ``(date, ret)``: mean of the demeaned return times the squared demeaned market, over std times variance."""
    m = market.select(F.lit(0).alias("ticker"), "date", F.col("ret").alias("m"))
    m = m.withColumn("m2", F.pow(F.col("m") - mean("m", lookback, least), 2)).withColumn("mv", rolling(F.var_samp, "m", lookback, least)).select("date", "m2", "mv")

    def work(t: pa.Table) -> list[np.ndarray]:
        r = values(t, "ret")
        mean_r, var_r = rolling_moments(r, lookback, least)
        return [ratio(rolling_moments((r - mean_r) * values(t, "m2"), lookback, least)[0], np.sqrt(var_r) * values(t, "mv"))]

    b = per_ticker(bars.join(m, "date"), ["raw"], work, ["ret", "m2", "mv"], ["ticker", "date"])
    return with_ranks(b.withColumn("_c", -F.round(clip("raw", -3.0, 3.0), 9)), {"value": "_c"}, kept=["ticker", "date"])


def sector_tailwind(bars: DataFrame, sectors: DataFrame, window: int = 21, least: int = 3) -> DataFrame:
    """Mean change over ``window`` rows of the names of a sector, 0 in sectors of fewer than ``least`` names."""
    names = sectors.groupBy("sector").agg(F.countDistinct("ticker").alias("_n"))
    b = bars.withColumn("_m", div("close", lag("close", window)) - 1).join(sectors, "ticker").join(names, "sector")
    per = F.avg("_m").over(Window.partitionBy("date", "sector"))
    return b.withColumn("value", F.when(F.col("_n") < least, 0.0).otherwise(per)).select("ticker", "date", "value")


def split_tearsheet(returns: DataFrame, start: str, least: int = 20) -> DataFrame:
    """Mean, deviation and Sharpe ratio of each strategy in and out of sample, from ``least`` returns on."""
    part = F.when(F.col("date") >= F.lit(start).cast("date"), "out").otherwise("in").alias("part")
    per = returns.groupBy("strategy_id", part).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd")).filter(F.col("n") >= least)
    return per.withColumn("sharpe", div("mean", "sd") * F.sqrt(F.lit(252.0)))


def difference_rank(panel: DataFrame, column: str, lookback: int = 5) -> DataFrame:
    """Rank on its date of the difference of a column over ``lookback`` rows of the ticker."""
    return panel.withColumn("_d", F.round(F.col(column) - lag(column, lookback), 9)).withColumn("value", rank_pct("_d")).drop("_d")

"""Dividends that option prices imply by put-call parity, against those paid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import rank_pct

DAY = ["date", "ticker"]
#: An expiry band's lower end falls back to so many days if too few pairs lie in it.
FALLBACK_DAYS = 30


def rate_at(knots: Column, days: Column) -> Column:
    """Rate of a curve, an array of structs ``(dte, rate)`` in order of dte, at a number of days: linear between knots, flat beyond, 0 for an empty or null curve."""
    below = F.try_element_at(F.filter(knots, lambda k: k["dte"] <= days), F.lit(-1))
    above = F.get(F.filter(knots, lambda k: k["dte"] >= days), F.lit(0))
    w = (days - below["dte"]) / (above["dte"] - below["dte"])
    inside = F.when(below["dte"] == above["dte"], below["rate"]).otherwise(below["rate"] * (1 - w) + above["rate"] * w)
    return F.coalesce(F.when(below.isNull(), above["rate"]).when(above.isNull(), below["rate"]).otherwise(inside), F.lit(0.0))


def call_put_pairs(chain: DataFrame, spots: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """``(date, ticker, dte, strike, spot, call, put)``: call and put of one strike and expiry, within ``tolerance`` of the spot price.

    ``chain(date, ticker, dte, strike, kind, mid)`` with kinds c and p, ``spots(date, ticker, spot)``. Quotes without a
    positive price, expiry or spot are left out; several quotes of one contract count as their mean. The sides are
    aggregated together, so there is no join of quotes with quotes.
    """
    ok = (F.col("mid") > 0) & (F.col("dte") > 0) & F.col("strike").isNotNull()
    side = lambda k: F.avg(F.when(F.col("kind") == k, F.col("mid")))
    both = chain.filter(ok).groupBy(*DAY, "dte", "strike").agg(side("c").alias("call"), side("p").alias("put")).filter("call is not null and put is not null")
    return both.join(spots.select(*DAY, "spot"), DAY).filter((F.col("spot") > 0) & (F.abs(F.col("strike") / F.col("spot") - 1) <= tolerance)).select(*DAY, "dte", "strike", "spot", "call", "put")


def implied_dividend(pairs: DataFrame, curves: DataFrame, least_dte: int = 30, most_dte: int = 180, least_pairs: int = 2, trim: float = 0.10) -> DataFrame:
    """``(date, ticker, pairs, value)``: yearly dividend per share that pairs imply; null where too few pairs are in the band.

    Of each pair: what the spot price exceeds the discounted strike and the call's excess over the put, carried
    to expiry and scaled to a year. If fewer than ``least_pairs`` expire within the band, it starts at 30 days. The values are
    drawn in to their ``trim`` quantiles at both ends, those below zero to zero, and averaged. ``curves(date, dte, rate)``;
    a date without a curve discounts at 0. A ticker's pairs of a day, bounded by its listed strikes, are one group.
    """
    knots = curves.filter("dte is not null and rate is not null").groupBy("date").agg(F.array_sort(F.collect_list(F.struct(F.col("dte").cast("double").alias("dte"), F.col("rate").cast("double").alias("rate")))).alias("_knots"))
    r, t = rate_at(F.col("_knots"), F.col("dte").cast("double")), F.col("dte") / 365
    b = pairs.join(knots, "date", "left").withColumn("_r", r)
    each = (F.col("spot") - F.col("strike") * F.exp(-F.col("_r") * t) - (F.col("call") - F.col("put"))) * F.exp(F.col("_r") * t) / t
    b = b.withColumn("_v", each).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    usual, wide = F.col("dte").between(least_dte, most_dte), F.col("dte").between(min(least_dte, FALLBACK_DAYS), most_dte)
    ends = F.array(F.lit(trim), F.lit(1 - trim))
    some = lambda cond: (F.collect_list(F.when(cond, F.col("_v"))), F.percentile(F.when(cond, F.col("_v")), ends))
    g = b.groupBy(*DAY).agg(*[x.alias(n) for n, x in zip(("_a", "_qa", "_b", "_qb"), (*some(usual), *some(wide)), strict=True)])
    first = F.size("_a") >= least_pairs
    values, q = F.when(first, F.col("_a")).otherwise(F.col("_b")), F.when(first, F.col("_qa")).otherwise(F.col("_qb"))
    g = g.select(*DAY, values.alias("_v"), q.alias("_q")).withColumn("pairs", F.size("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], x))))
    return g.select(*DAY, "pairs", F.when(F.col("pairs") >= least_pairs, total / F.col("pairs")).alias("value"))


def paid_dividend(dates: DataFrame, payments: DataFrame, days: int = 365) -> DataFrame:
    """``dates(date, ticker)`` with ``paid``: the sum of ``payments(ticker, date, amount)`` over the ``days`` up to each date; 0 where there are none.

    Both lie on one time line per ticker and the sum is a frame over days, so no date is paired with its payments.
    """
    line = payments.groupBy("ticker", "date").agg(F.sum("amount").alias("_amount")).select("ticker", "date", "_amount", F.lit(0).alias("_asked"))
    both = line.unionByName(dates.select("ticker", "date").distinct().select("ticker", "date", F.lit(0.0).alias("_amount"), F.lit(1).alias("_asked"))).withColumn("_day", F.unix_date("date"))
    past = Window.partitionBy("ticker").orderBy("_day").rangeBetween(1 - days, 0)
    paid = both.withColumn("paid", F.sum("_amount").over(past)).filter("_asked = 1").select("ticker", "date", "paid")
    return dates.join(paid, ["ticker", "date"])


def dividend_surprise(implied: DataFrame, payments: DataFrame) -> DataFrame:
    """``implied(date, ticker, value)`` with ``paid``, the ``surprise`` of the implied over the paid dividend, and its ``rank`` on the date; null where nothing is implied."""
    b = paid_dividend(implied, payments).withColumn("surprise", F.col("value") - F.col("paid"))
    return b.withColumn("_x", F.round("surprise", 9)).withColumn("rank", rank_pct("_x")).drop("_x")

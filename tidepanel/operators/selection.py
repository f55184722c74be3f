"""From scores to a book: guarded filters, caps by sector, a choice of names that move apart, carried-over names, weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_date, div

#: Calendar days of history that a name needs: about 180 trading days.
MATURE_DAYS = 270


def _number(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(by_date())


def funnel(
    panel: DataFrame,
    score: str = "score",
    n: int = 20,
    *,
    weakest: float = 0.20,
    quality: str | None = "quality",
    least_quality: float = 0.50,
    first_date: str | None = "first_date",
    earnings: str | None = "earnings",
    traded: str | None = "traded",
    pool: int = 1500,
    least_traded: float = 5_000_000.0,
    vol: str | None = "vol",
    most_vol: float = 0.60,
) -> DataFrame:
    """``panel(ticker, date, score, ...)`` with ``dropped_by``: the number of the filter that takes a row out of its date's candidates, null for those left, 0 where the date is not filled.

    Seven filters in order, each among what those before left, and each only where enough of the date's rows pass it
    (three times ``n`` for the first four, twice for the others): 1 the weakest scores by rank; 2 quality at most
    ``least_quality``; 3 less than ``MATURE_DAYS`` of history; 4 earnings very near (rank of 0.90 or more) unless the
    score is among the best hundredth; 5 all but the ``pool`` most traded, where more than that are known; 6 traded
    less than ``least_traded``; 7 volatility above ``most_vol``. A null in a filter's column fails it, except in 4. A
    column name of None, and a limit of 0 for 1, 5, 6 and 7, leaves the filter out.

    A null score counts as no candidate (0), as do all rows of a date with fewer than twice ``n`` scores. Ties in
    ``traded`` go by ticker. All windows are by date, so the panel is shuffled once.
    """
    b = panel.withColumn("_alive", F.col(score).isNotNull()).withColumn("_drop", F.when(~F.col("_alive"), 0))
    b = b.withColumn("_drop", F.when(_number(F.col("_alive")) < 2 * n, 0).otherwise(F.col("_drop"))).withColumn("_alive", F.col("_drop").isNull())
    among = Window.partitionBy("date", "_alive")
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", "_alive", score))
    place = (F.rank().over(among.orderBy(score)) + (ties - 1) / 2) / F.count(F.lit(1)).over(among)

    def step(b: DataFrame, k: int, passes: Column, times: int) -> DataFrame:
        b = b.withColumn("_ok", F.col("_alive") & F.coalesce(passes, F.lit(False)))
        b = b.withColumn("_enough", _number(F.col("_ok")) >= times * n)
        return b.withColumn("_drop", F.when(F.col("_enough") & F.col("_alive") & ~F.col("_ok"), k).otherwise(F.col("_drop"))).withColumn("_alive", F.col("_drop").isNull())

    if weakest > 0:
        b = step(b, 1, place > weakest, 3)
    if quality:
        b = step(b, 2, F.col(quality) > least_quality, 3)
    if first_date:
        b = step(b, 3, F.col(first_date) <= F.date_sub("date", MATURE_DAYS), 3)
    if earnings:
        b = step(b.withColumn("_best", place >= 0.99), 4, ~F.coalesce(F.col(earnings) >= 0.90, F.lit(False)) | F.col("_best"), 3).drop("_best")
    if traded and pool > 0:
        known = F.col("_alive") & F.col(traded).isNotNull()
        b = b.withColumn("_known", known).withColumn("_size", F.row_number().over(Window.partitionBy("date", "_known").orderBy(F.desc(traded), "ticker")))
        full = _number(F.col("_known")) > pool
        b = step(b.withColumn("_full", full), 5, ~F.col("_full") | (F.col("_known") & (F.col("_size") <= pool)), 2).drop("_known", "_size", "_full")
    if traded and least_traded > 0:
        b = step(b, 6, F.col(traded) >= least_traded, 2)
    if vol and most_vol > 0:
        b = step(b, 7, F.col(vol) <= most_vol, 2)
    return b.select(*panel.columns, F.col("_drop").alias("dropped_by"))


def _apart(key: tuple, pdf: pd.DataFrame, n: int, most: float) -> pd.DataFrame:
    """Candidates of a date in order of place; each is taken unless it moves too much like one taken before."""
    names = pdf.drop_duplicates("ticker").sort_values("place")
    order = names["ticker"].tolist()
    taken = order[:n]
    if not names["early"].iloc[0]:
        corr = pdf.pivot_table(index="row", columns="ticker", values="ret", aggfunc="last").reindex(columns=order).corr().abs()
        taken = []
        for t in order:
            if len(taken) < n and not (taken and corr.loc[t, taken].max() > most):
                taken.append(t)
    return pd.DataFrame({"date": key[0], "ticker": taken, "picked": range(1, len(taken) + 1)})


def uncorrelated(candidates: DataFrame, returns: DataFrame, n: int = 20, pool: int = 40, most: float = 0.80, lookback: int = 63) -> DataFrame:
    """``(date, ticker, picked)``: of each date's candidates, in order of ``place``, up to ``n`` whose returns over the ``lookback`` trading days before it correlate with none taken before by more than ``most`` in size.

    ``candidates(date, ticker, place)``, the first ``pool`` of each date; that is the feature's bound on a date's group,
    with ``lookback`` rows for each. ``returns(ticker, date, ret)``; its dates are the trading days. Correlations use
    the days on which both names have a return, and one that does not exist (too few days, no spread) bars nobody.
    Dates that are no trading day, or have fewer than ``lookback`` before them, take the first ``n``. Of repeated rows of
    a name on a date one counts; ties in place go by ticker. A row per candidate and day is joined by key, never a range.
    """
    days = returns.select("date").distinct().withColumn("_row", F.row_number().over(Window.orderBy("date")) - 1)  # one row a date
    first = candidates.filter("place is not null").groupBy("date", "ticker").agg(F.min("place").alias("place"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("date").orderBy("place", "ticker"))).filter(F.col("place") <= pool)
    c = first.join(days, "date", "left").withColumn("early", F.coalesce(F.col("_row") < lookback, F.lit(True)))
    span = F.when(F.col("early"), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.col("_row") - lookback, F.col("_row") - 1))
    each = c.select("date", "ticker", "place", "early", F.explode(span).alias("row"))
    by_row = returns.join(days, "date").select("ticker", F.col("_row").alias("row"), F.col("ret").cast("double").alias("ret"))
    both = each.join(by_row, ["ticker", "row"], "left").select("date", "ticker", "place", "early", "row", "ret")
    schema = f"date date, ticker {candidates.schema['ticker'].dataType.simpleString()}, picked int"
    return both.groupBy("date").applyInPandas(lambda key, pdf: _apart(key, pdf, n, most), schema)


def carry_over(picks: DataFrame, scores: DataFrame, held: DataFrame, n: int = 20, share: float = 0.7) -> DataFrame:
    """``(date, ticker, slot)``: picks of each date after names held before it keep up to ``share`` of ``n`` places.

    ``held(date, ticker)`` is what was held before a date. The best scored of those that still have a score stay; picks
    fill the rest in their order, then the best scores. Dates with fewer than ``n`` picks keep their picks.
    """
    keep = int(n * share)
    s = scores.filter("score is not null").select("date", "ticker", "score")
    enough = picks.groupBy("date").agg((F.count("*") >= n).alias("_full"))
    kept = held.select("date", "ticker").distinct().join(s, ["date", "ticker"]).withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))).filter(F.col("_k") <= keep)
    lines = s.join(enough, "date").join(picks.select("date", "ticker", "picked"), ["date", "ticker"], "left").join(kept.select("date", "ticker", "_k"), ["date", "ticker"], "left")
    keeps = F.col("_full") & F.col("_k").isNotNull()
    group = F.when(keeps, 0).when(F.col("picked").isNotNull(), 1).when(F.col("_full"), 2)
    order = Window.partitionBy("date").orderBy("_g", F.when(keeps, F.col("_k")).otherwise(F.col("picked")), F.desc("score"), "ticker")
    return lines.withColumn("_g", group).filter("_g is not null").withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= n).select("date", "ticker", "slot")


def book_weights(book: DataFrame, weighting: str = "signal", concentration: float = 1.0, low: float = 0.02, high: float = 0.15, rounds: int = 5, traded: str | None = None, vol: str | None = None) -> DataFrame:
    """``book(date, ticker, score, ...)`` with ``weight``: equal, by score rank to a power, or by inverse volatility; thinly traded names are capped, then all are clipped and scaled to one until they fit.

    The cap is a hundredth of the root of millions traded, within ``low`` and ``high``. A null or zero volatility counts
    as 1. Equal scores are ranked by ticker.
    """
    if weighting == "equal":
        raw: Column = F.lit(1.0)
    elif weighting == "signal":
        raw = F.pow(F.row_number().over(by_date().orderBy("score", "ticker")).cast("double"), concentration)
    elif weighting == "inverse_vol":
        raw = F.coalesce(div(F.lit(1.0), vol), F.lit(1.0)) if vol else F.lit(1.0)
    else:
        raise ValueError(f"no such weighting: {weighting}")
    b = book.withColumn("weight", raw).withColumn("weight", F.col("weight") / F.sum("weight").over(by_date()))
    if traded:
        cap = F.greatest(F.lit(low), F.least(F.lit(high), 0.01 * F.sqrt(F.col(traded) / 1e6)))
        b = b.withColumn("weight", F.when(F.col(traded) > 0, F.least("weight", cap)).otherwise(F.col("weight")))
    b = b.withColumn("_done", F.lit(False))
    for _ in range(rounds):
        clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight")))
        b = b.withColumn("_w", F.when(F.col("_done"), F.col("weight")).otherwise(clipped))
        b = b.withColumn("weight", F.when(F.col("_done"), F.col("weight")).otherwise(F.col("_w") / F.sum("_w").over(by_date())))
        b = b.withColumn("_done", F.col("_done") | ((F.max("weight").over(by_date()) <= high + 1e-6) & (F.min("weight").over(by_date()) >= low - 1e-6)))
    return b.drop("_done", "_w")


def select_and_weight(panel: DataFrame, returns: DataFrame, n: int = 20, held: DataFrame | None = None, share: float = 0.3, most: float = 0.80, lookback: int = 63, weighting: str = "signal", concentration: float = 1.0, low: float = 0.02, high: float = 0.15, **filters) -> DataFrame:
    """``(date, ticker, score, weight)``: the book of each date, by all steps. ``panel`` has ``score``, ``sector`` and what the filters name; a null sector is one sector.

    A date with fewer scores than twice ``n`` has no book. Where fewer than ``n`` names are left, all of them make it up.
    """
    left = funnel(panel, "score", n, **filters).filter("dropped_by is null")
    cap = F.greatest(F.lit(1), F.floor(F.least(F.lit(2 * n), F.count(F.lit(1)).over(by_date())) * F.lit(share)))
    best = [F.desc("score"), F.asc("ticker")]
    inside = left.withColumn("_cap", cap).withColumn("_s", F.row_number().over(Window.partitionBy("date", "sector").orderBy(*best))).filter(F.col("_s") <= F.col("_cap"))
    ranked = inside.withColumn("place", F.row_number().over(by_date().orderBy(*best))).filter(F.col("place") <= 2 * n)
    picks = uncorrelated(ranked.select("date", "ticker", "place"), returns, n, 2 * n, most, lookback)
    if held is not None:
        picks = carry_over(picks, left, held, n)
    book = left.join(picks.select("date", "ticker"), ["date", "ticker"])
    return book_weights(book, weighting, concentration, low, high, traded=filters.get("traded"), vol=filters.get("vol")).select("date", "ticker", "score", "weight")


def credit_overlay(weights: DataFrame, conditions: DataFrame | None, spread: DataFrame | None, tight: float = 0.0, wide: float = 0.05, scale: float = 0.5) -> DataFrame:
    """``weights(date, ticker, weight)`` with weights halved on dates when financial conditions are tight or the credit spread is wide.

    Both series ``(date, value)`` hold from their date until the next one; before the first, and if None, they say nothing.
    """
    risk = F.lit(False)
    days = weights.select("date").distinct()
    for k, (series, limit) in enumerate(((conditions, tight), (spread, wide))):
        if series is not None:
            line = days.select("date").withColumn("v", F.lit(None).cast("double")).withColumn("_day", F.lit(1)).unionByName(series.select("date", F.col("value").cast("double").alias("v"), F.lit(0).alias("_day")))
            last = F.last("v", ignorenulls=True).over(Window.orderBy("date", "_day").rowsBetween(Window.unboundedPreceding, 0))  # one row a date
            days = days.join(line.withColumn(f"_v{k}", last).filter("_day = 1").select("date", f"_v{k}"), "date")
            risk = risk | F.coalesce(F.col(f"_v{k}") > limit, F.lit(False))
    return weights.join(days.withColumn("_off", risk).select("date", "_off"), "date").withColumn("weight", F.when(F.col("_off"), F.col("weight") * scale).otherwise(F.col("weight"))).drop("_off")

"""Signals that join a ticker's returns with market series, facts, events or other tickers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_date, by_ticker, clip, div, lag, mean, rank_pct, std, total
from tidepanel.functions.linear_time import per_ticker, rolling as rolling_moments, rolling_slope, values


def rolling_beta_to(panel: DataFrame, factor: DataFrame, window: int = 126, least: int = 60) -> DataFrame:
    """Covariance over variance of the returns against a factor ``(date, x)`` on common dates, sample forms."""
    return per_ticker(panel.join(factor, "date"), ["value"], lambda t: [rolling_slope(values(t, "ret"), values(t, "x"), window, least)], ["ret", "x"])


def downside_beta_spread(panel: DataFrame, window: int = 126) -> DataFrame:
    """Beta on days when the market is under its rolling mean less beta on the other days."""

    def work(t: pa.Table) -> list[np.ndarray]:
        r, m = values(t, "ret"), values(t, "mkt")
        mean = rolling_moments(m, window)[0]
        down, other = (rolling_slope(r, np.where(on, m, np.nan), window) for on in (m < mean, m >= mean))
        return [down - other]

    return per_ticker(panel.withColumn("mkt", F.avg("ret").over(by_date())), ["value"], work, ["ret", "mkt"])


def combined_regime(market: DataFrame, window: int = 40) -> DataFrame:
    """Trend and volatility state of one market series with ``ticker, date, level, ret``."""
    ma, vol = mean("level", window), std("ret", 21)
    b = market.withColumn("_v", vol)
    trend = F.when(ma.isNull(), "unknown").when(F.col("level") > ma, "bull").otherwise("bear")
    state = F.when(F.col("_v").isNull(), "unknown").when(F.col("_v") <= mean("_v", 252, 1), "calm").otherwise("volatile")
    return b.withColumn("value", F.concat_ws("_", trend, state)).drop("_v")


def trailing_sum(events: DataFrame, value: str, days: int = 365) -> DataFrame:
    """Sum of a ticker's event values over the last ``days`` days, the event's own day included."""
    day = F.unix_date("date")
    w = Window.partitionBy("ticker").orderBy(day).rangeBetween(1 - days, 0)
    return events.withColumn("trailing", F.sum(value).over(w))


def event_pressure(panel: DataFrame, events: DataFrame, lookback: int = 60) -> DataFrame:
    """Sum over the last rows of the day's event scores ``(ticker, date, score)``, ranked on the date."""
    day = events.groupBy("ticker", "date").agg(F.sum("score").alias("_s"))
    b = panel.join(day, ["ticker", "date"], "left").withColumn("_s", F.coalesce("_s", F.lit(0.0)))
    b = b.withColumn("_t", F.round(total("_s", lookback, 1), 9))
    return b.withColumn("value", rank_pct("_t")).drop("_s", "_t")


def difference_rank(panel: DataFrame, x: str, lookback: int = 21, sign: int = -1) -> DataFrame:
    """Signed rank on the date of the change of x over ``lookback`` rows."""
    b = panel.withColumn("_d", F.round(sign * (F.col(x) - lag(x, lookback)), 9))
    return b.withColumn("value", rank_pct("_d")).drop("_d")


def ratio_change_rank(panel: DataFrame, x: str, y: str, lookback: int = 12) -> DataFrame:
    """Rank of the change of x over the average of y, as for deferred revenue over assets."""
    b = panel.withColumn("_d", F.round(div(F.col(x) - lag(x, lookback), (F.col(y) + lag(y, lookback)) / 2), 9))
    return b.withColumn("value", rank_pct("_d")).drop("_d")


def weighted_score(panel: DataFrame, weights: dict[str, float], bound: float = 20.0) -> DataFrame:
    """Bounded weighted sum of ratios, as a distress score."""
    return panel.withColumn("value", clip(sum((w * F.col(x) for x, w in weights.items()), F.lit(0.0)), -bound, bound))


def flags_score(panel: DataFrame, columns: list[str], lookback: int = 12) -> DataFrame:
    """How many columns are positive plus how many have grown over ``lookback`` rows; null columns count for nothing."""
    parts = []
    for c in columns:
        parts += [F.coalesce(F.col(c) > 0, F.lit(False)).cast("int"), F.coalesce(F.col(c) > lag(c, lookback), F.lit(False)).cast("int")]
    return panel.withColumn("value", sum(parts, F.lit(0)))


def ic_weighted(panel: DataFrame, signals: list[str], forward: str, window: int = 12) -> DataFrame:
    """Signals' ranks weighted by their positive rolling information coefficients of earlier dates; equal where none is positive."""
    ranked = panel.withColumns({f"_r_{s}": rank_pct(s) for s in signals} | {"_f": rank_pct(forward)})
    per = ranked.groupBy("date").agg(*[F.corr(F.col(f"_r_{s}"), F.col("_f")).alias(s) for s in signals]).withColumn("ticker", F.lit(0))
    per = per.withColumns({s: F.when(~F.isnan(s), F.col(s)) for s in signals})  # one row per date from here
    per = per.withColumns({f"_m_{s}": mean(s, window, 3) for s in signals})
    per = per.withColumns({f"_w_{s}": F.coalesce(F.greatest(lag(f"_m_{s}"), F.lit(0.0)), F.lit(0.0)) for s in signals})
    whole = sum((F.col(f"_w_{s}") for s in signals), F.lit(0.0))
    weights = per.select("date", whole.alias("_w"), *[F.when(whole > 0, F.col(f"_w_{s}") / whole).otherwise(1 / len(signals)).alias(f"_w_{s}") for s in signals])
    out = ranked.join(weights, "date")
    return out.withColumn("value", sum((F.col(f"_w_{s}") * F.col(f"_r_{s}") for s in signals), F.lit(0.0))).select(*panel.columns, "value")


def volatility_target(weights: DataFrame, vol: str, target: float, correlation: float = 0.45, most: float = 1.3) -> DataFrame:
    """Weights scaled per date to a target volatility under one correlation, within a leverage cap."""
    w, v = F.col("weight"), F.col("weight") * F.coalesce(F.col(vol), F.lit(0.0))
    var = correlation * F.sum(v).over(by_date()) ** 2 + (1 - correlation) * F.sum(v * v).over(by_date())
    scale = F.when(var > 0, F.least(F.lit(most), target / F.sqrt(var))).otherwise(1.0)
    return weights.withColumn("value", w * scale)


#: Blocks of ids on either side, at most: each id's returns are copied so many times, whatever their number.
BLOCKS = 24


def _table(ids: pa.Table, months: np.ndarray) -> np.ndarray:
    """Returns by month and id, NaN where there is none; the mean of several in one month."""
    counts = pa.compute.list_value_length(ids["months"].combine_chunks()).to_numpy()
    at = np.searchsorted(months, ids["months"].combine_chunks().flatten().to_numpy()), np.repeat(np.arange(len(counts)), counts)
    total, n = np.zeros((len(months), len(counts))), np.zeros((len(months), len(counts)))
    np.add.at(total, at, ids["rets"].combine_chunks().flatten().to_numpy())
    np.add.at(n, at, 1.0)
    with np.errstate(invalid="ignore"):
        return total / n


def match_by_returns(left: DataFrame, right: DataFrame, least: int = 24, corr: float = 0.9, block: int = 512) -> DataFrame:
    """One-to-one links of ids by the correlation of their monthly returns ``(id, month, ret)`` on common months.

    Every id of the left is held against every id of the right, in pairs of blocks; a side has ``BLOCKS`` of them at
    most, so what is shuffled grows with the input and not with the pairs. A task multiplies tables of months and
    ``block`` ids at a time, and only an id's best pairs with ``least`` months and the correlation leave it.
    """
    sides = [df.filter("ret is not null and not isnan(ret)").groupBy("id").agg(F.collect_list(F.struct(F.unix_date("month").alias("m"), F.col("ret").cast("double").alias("r"))).alias("x")) for df in (left, right)]
    sides = [df.select(F.col("id").cast("long").alias("id"), F.col("x.m").alias("months"), F.col("x.r").alias("rets")) for df in sides]
    parts = [min(BLOCKS, max(1, math.ceil(df.select("id").distinct().count() / block))) for df in (left, right)]
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = sides[0].select("*", place(parts[0]).alias("_a")).select("*", every(parts[1]).alias("_b"))
    b = sides[1].select("*", place(parts[1]).alias("_b")).select("*", every(parts[0]).alias("_a"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        months = np.intersect1d(*(np.unique(t["months"].combine_chunks().flatten().to_numpy()) for t in (one, two))) if one.num_rows and two.num_rows else np.array([], "int32")
        every_month = np.unique(np.concatenate([t["months"].combine_chunks().flatten().to_numpy() for t in (one, two)])) if len(months) else months
        shared = np.searchsorted(every_month, months)
        found, others = [], []
        for c in range(0, two.num_rows if len(months) else 0, block):
            others.append((two["id"].slice(c, block).to_numpy(), _table(two.slice(c, block), every_month)[shared]))
        for r in range(0, one.num_rows if others else 0, block):
            rows = one["id"].slice(r, block).to_numpy()
            x = _table(one.slice(r, block), every_month)[shared]
            has_x, x = ~np.isnan(x) * 1.0, np.nan_to_num(x)
            for cols, y in others:
                has_y, y = ~np.isnan(y) * 1.0, np.nan_to_num(y)
                n, sx, sy = has_x.T @ has_y, x.T @ has_y, has_x.T @ y
                with np.errstate(divide="ignore", invalid="ignore"):
                    spread = (n * ((x * x).T @ has_y) - sx * sx) * (n * (has_x.T @ (y * y)) - sy * sy)
                    score = np.round((n * (x.T @ y) - sx * sy) / np.sqrt(spread), 9)
                score[~((n >= least) & (score >= corr) & np.isfinite(score))] = -np.inf
                top = np.where(np.isfinite(score), cols[None, :], np.iinfo("int64").max)
                top[score < score.max(axis=1)[:, None]] = np.iinfo("int64").max
                j = top.argmin(axis=1)
                i = np.flatnonzero(np.isfinite(score[np.arange(len(rows)), j]))
                found.append((rows[i], cols[j[i]], n[i, j[i]].astype("int64"), score[i, j[i]]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = [np.concatenate(v) for v in zip(*found, strict=True)] if found else [np.array([])] * 4
        return pa.Table.from_arrays([pa.array(v).cast(k) for v, k in zip(columns, kinds, strict=True)], ["id", "other", "n", "score"])

    scored = a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(run, "id long, other long, n long, score double")
    best = scored.withColumn("_i", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).filter("_i = 1")
    return best.withColumn("_o", F.row_number().over(Window.partitionBy("other").orderBy(F.desc("score"), "id"))).filter("_o = 1").select("id", "other", "n", "score")


def order_chunks(trades: DataFrame, most: float) -> DataFrame:
    """Orders of at most ``most`` money each: a trade is split into equal parts; sells come first in ``seq``."""
    n = F.greatest(F.lit(1), F.ceil(F.col("money") / most)).cast("int")
    each = trades.withColumn("parts", n).select("ticker", "side", "parts", (F.col("money") / n).alias("money"), F.explode(F.sequence(F.lit(1), n)).alias("part"))
    return each


def quantity_mismatch(orders: DataFrame, fills: DataFrame, share: float = 0.005) -> DataFrame:
    """Orders whose filled quantity is off by more than a share of the ordered one."""
    done = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"))
    both = orders.join(done, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return both.filter(F.abs(F.col("filled") - F.col("ordered")) > F.greatest(share * F.col("ordered"), F.lit(1e-6)))


def band_energy(bars: DataFrame, window: int = 64) -> DataFrame:
    """Shares of spectral energy in four bands of each ticker's last ``window`` returns, by grouped numpy transforms.

    Missing returns take the window's mean. A ticker's history is one group; longer histories than memory are not expected of a ticker.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        x = g["ret"].to_numpy(float)
        out = np.full((len(x), 4), np.nan)
        if len(x) >= window:
            frames = np.lib.stride_tricks.sliding_window_view(x, window).copy()
            with np.errstate(invalid="ignore"):
                fill = np.nanmean(frames, axis=1)
            frames = np.where(np.isnan(frames), fill[:, None], frames)
            power = np.abs(np.fft.rfft(frames - frames.mean(axis=1, keepdims=True), axis=1))[:, 1:] ** 2
            bands = np.stack([b.sum(axis=1) for b in np.array_split(power, 4, axis=1)], axis=1)
            whole = bands.sum(axis=1, keepdims=True)
            out[window - 1 :] = np.divide(bands, whole, out=np.full_like(bands, np.nan), where=whole > 0)
        return pd.DataFrame({"ticker": g["ticker"], "date": g["date"], **{f"band{k}": out[:, k] for k in range(4)}})

    rows = bars.select("ticker", "date", "ret").groupBy("ticker").applyInPandas(run, "ticker long, date date, band0 double, band1 double, band2 double, band3 double")
    return rows.select("ticker", "date", *[F.when(~F.isnan(f"band{k}"), F.col(f"band{k}")).alias(f"band{k}") for k in range(4)])


def breadth_z(parts: DataFrame, columns: list[str], window: int = 60) -> DataFrame:
    """Mean of the rolling standard scores of market-wide columns ``(ticker, date, ...)``, one series."""
    zs = [div(F.col(c) - mean(c, window), std(c, window)) for c in columns]
    return parts.withColumn("value", sum(zs, F.lit(0.0)) / len(columns))


def correlated_pairs(signals: DataFrame, names: list[str], most: float = 0.7) -> DataFrame:
    """Pairs of signal columns whose correlation over all rows exceeds a bound; the columns are few and named."""
    pairs = [(a, b) for k, a in enumerate(names) for b in names[:k]]
    row = signals.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    stacked = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs])).alias("p")).select("p.*")
    return stacked.withColumn("close", F.abs("corr") > most)



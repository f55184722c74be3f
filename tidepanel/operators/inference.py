"""How sure a measured performance is: deflated ratios, block resampling of any measure, permutations of a signal."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, div, norm_cdf

YEAR = TRADING_DAYS**0.5
#: Euler's constant, in the expected largest of many normal draws.
EULER = 0.5772156649015329
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)


def deflated_sharpe(returns: DataFrame, trials: int, benchmark: float = 0.0) -> DataFrame:
    """``(strategy_id, n, sharpe, hurdle, probability)``: the probability that a strategy's Sharpe ratio exceeds the largest that so many trials without skill are expected to show.

    ``hurdle`` is yearly, as is ``sharpe``; a benchmark above it takes its place. Strategies with fewer than four
    returns, or without spread, have null; nulls in ``ret`` don't count.
    """
    r = F.col("ret")
    m = returns.filter(r.isNotNull()).groupBy("strategy_id").agg(F.count(r).alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    n = F.col("n")
    root = math.sqrt(2 * math.log(max(2, trials)))
    largest = root - (EULER + math.log(math.log(max(2, trials)))) / root
    expected = F.lit(largest) / F.sqrt(F.greatest(n - 1, F.lit(1))) * YEAR
    hurdle = expected if benchmark == 0.0 else F.greatest(expected, F.lit(benchmark))
    m = m.withColumn("sharpe", div("mu", "sd") * YEAR).withColumn("hurdle", hurdle)
    m = m.withColumn("skew", F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))).withColumn("kurt", F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)))
    daily = F.col("sharpe") / YEAR
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * daily + (F.col("kurt") + 2) / 4 * daily * daily))
    return m.select("strategy_id", "n", "sharpe", "hurdle", norm_cdf((daily - F.col("hurdle") / YEAR) * F.sqrt(n - 1) / spread).alias("probability"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function; equal numbers give equal draws on any worker."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(MIX[2])
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def draws(seed: int, *numbers: np.ndarray | int) -> np.ndarray:
    """Unsigned 64-bit draws that follow from the seed and the numbers alone; arrays are combined as numpy does."""
    out = np.asarray(_mixed(np.asarray(seed)))
    for x in numbers:
        out = _mixed(out ^ _mixed(np.asarray(x)))
    return out


#: Measures of resampled returns: functions of an array ``(simulations, days)``.
MEASURES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mean": lambda r: r.mean(axis=1) * TRADING_DAYS,
    "sharpe": lambda r: np.divide(r.mean(axis=1) * YEAR, s := r.std(axis=1, ddof=1), out=np.zeros(len(r)), where=s > 0),
    "sortino": lambda r: np.divide(r.mean(axis=1) * YEAR, d := np.sqrt((np.minimum(r, 0) ** 2).mean(axis=1)), out=np.zeros(len(r)), where=d > 0),
    "growth": lambda r: np.exp(np.log1p(np.maximum(r, -0.999999)).mean(axis=1) * TRADING_DAYS) - 1,
}
BOOT_SCHEMA = "strategy_id {kind}, measure string, sim int, value double"


def block_draws(returns: DataFrame, measures: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None, sims: int = 1000, block: int | None = None, seed: int = 42, parts: int = 16) -> DataFrame:
    """``(strategy_id, measure, sim, value)``: measures of each strategy's returns, resampled in blocks of days that follow each other; simulation -1 is the series itself.

    ``measures`` maps names to functions of an array (simulations, days), so any measure can be had. A block is the
    square root of the number of days if not given. Where a block starts follows from seed, simulation and block number alone, so a
    lost task draws the same again, and from the strategy's own days. A strategy's series, one number a date, is held
    in a task, as any measure needs it whole; simulations are dealt to ``parts`` tasks. Null returns are left out;
    strategies without any give no rows.
    """
    measures = MEASURES if measures is None else measures
    kind = returns.schema["strategy_id"].dataType.simpleString()
    series = returns.filter("ret is not null").groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("s"))
    work = series.select("strategy_id", F.col("s.ret").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "strategy_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                r = np.asarray(row.r, float)
                n = len(r)
                size = min(n, max(1, math.isqrt(n)) if block is None else block)
                count = -(-n // size)
                mine = np.arange(row.part, sims, parts)
                for at in range(0, len(mine), 64):
                    sim = mine[at : at + 64]
                    starts = (draws(seed, sim[:, None], np.arange(count)[None, :]) % np.uint64(n - size + 1)).astype(np.int64)
                    rows = r[(starts[:, :, None] + np.arange(size)).reshape(len(sim), -1)[:, :n]]
                    yield pd.concat([pd.DataFrame({"strategy_id": row.strategy_id, "measure": m, "sim": sim, "value": f(rows)}) for m, f in measures.items()])
                if row.part == 0:
                    yield pd.DataFrame({"strategy_id": row.strategy_id, "measure": list(measures), "sim": -1, "value": [float(f(r[None, :])[0]) for f in measures.values()]})

    return work.mapInPandas(run, BOOT_SCHEMA.format(kind=kind))


def bootstrap(returns: DataFrame, **kw) -> DataFrame:
    """One row per strategy and measure: what was observed, percentiles and deviation of the resampled values, and the share above zero. Arguments as for ``block_draws``."""
    q = [0.05, 0.25, 0.5, 0.75, 0.95]
    d, sim = block_draws(returns, **kw), F.col("sim") >= 0
    out = d.groupBy("strategy_id", "measure").agg(F.max(F.when(~sim, F.col("value"))).alias("observed"), F.percentile(F.when(sim, F.col("value")), F.array(*[F.lit(x) for x in q])).alias("q"), F.stddev_pop(F.when(sim, F.col("value"))).alias("std"), F.avg(F.when(sim, (F.col("value") > 0).cast("double"))).alias("positive"))
    return out.select("strategy_id", "measure", "observed", *[F.col("q")[k].alias(f"p{int(x * 100)}") for k, x in enumerate(q)], "std", "positive")


def _ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def permuted_correlations(panel: DataFrame, signal: str, forward: str, permutations: int = 200, least: int = 10, seed: int = 42) -> DataFrame:
    """``(date, permutation, ic)``: each date's rank correlation of signal and forward return, -1 as it is and from 0 on with signals dealt anew to the date's tickers.

    Who gets whose signal follows from seed, permutation, date and ticker (a whole number) alone, so the result is the same for any
    partitioning. Rows with a null or NaN in either column are left out; dates with fewer than ``least`` rows, or without spread in one
    column, give none; of repeated rows of a ticker the order of signals decides. A task holds a date's cross-section
    and 64 permutations of it at once.
    """
    both = panel.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull() & ~F.isnan(signal) & ~F.isnan(forward))
    rows = both.select(F.col("date").cast("date").alias("date"), F.col("ticker").cast("long").alias("t"), F.col(signal).cast("double").alias("s"), F.col(forward).cast("double").alias("f"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"date": pd.Series([], dtype=object), "permutation": pd.Series([], dtype=int), "ic": pd.Series([], dtype=float)})
        pdf = pdf.sort_values(["t", "s", "f"])
        a, b = _ranks(pdf.s.to_numpy()), _ranks(pdf.f.to_numpy())
        a, b = a - a.mean(), b - b.mean()
        size = math.sqrt((a @ a) * (b @ b))
        if len(pdf) < least or size == 0:
            return empty
        day, tickers = (key[0] - pd.Timestamp("1970-01-01").date()).days, pdf.t.to_numpy()
        out = [np.array([a @ b / size])]
        for at in range(0, permutations, 64):
            p = np.arange(at, min(at + 64, permutations))
            order = np.argsort(draws(seed, p[:, None], day, tickers[None, :]), axis=1, kind="stable")
            out.append(a[order] @ b / size)
        return pd.DataFrame({"date": key[0], "permutation": np.arange(-1, permutations), "ic": np.concatenate(out)})

    return rows.groupBy("date").applyInPandas(run, "date date, permutation int, ic double")


def permutation_test(panel: DataFrame, signal: str, forward: str, permutations: int = 200, least: int = 10, seed: int = 42) -> DataFrame:
    """One row: the mean correlation over dates, mean and deviation of the permuted ones, z, the share of permutations at least as high (p), and whether it is under 0.05. All null or 0 if no date counts."""
    means = permuted_correlations(panel, signal, forward, permutations, least, seed).groupBy("permutation").agg(F.avg("ic").alias("ic"))
    true, rest = F.max(F.when(F.col("permutation") < 0, F.col("ic"))), F.when(F.col("permutation") >= 0, F.col("ic"))
    one = means.agg(true.alias("true_ic"), F.avg(rest).alias("shuffled_mean"), F.stddev_pop(rest).alias("shuffled_std"), F.collect_list(rest).alias("_all"))  # one number per permutation
    at_least = F.size(F.filter("_all", lambda x: x >= F.col("true_ic")))
    z = F.when(F.col("shuffled_std") > 0, (F.col("true_ic") - F.col("shuffled_mean")) / F.col("shuffled_std")).otherwise(0.0)
    return one.select("true_ic", "shuffled_mean", "shuffled_std", z.alias("z"), div(at_least.cast("double"), F.size("_all")).alias("p")).withColumn("significant", F.col("p") < 0.05)

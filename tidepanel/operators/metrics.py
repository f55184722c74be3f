"""Performance measures of return series, one row per strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, div, norm_cdf

YEAR = TRADING_DAYS**0.5


def by_strategy() -> WindowSpec:
    return Window.partitionBy("strategy_id").orderBy("date")


def _growth(x: str = "ret") -> Column:
    return F.log1p(F.greatest(F.col(x), F.lit(-0.999999)))


def with_drawdown(returns: DataFrame) -> DataFrame:
    """Adds log wealth ``_lw`` and the drawdown from the running maximum, the start included."""
    past = by_strategy().rowsBetween(Window.unboundedPreceding, 0)
    b = returns.withColumn("_lw", F.sum(_growth()).over(past))
    return b.withColumn("drawdown", F.expm1(F.col("_lw") - F.greatest(F.lit(0.0), F.max("_lw").over(past))))


def tearsheet(returns: DataFrame, benchmark: DataFrame, risk_free: float = 0.02) -> DataFrame:
    """All measures of ``(strategy_id, date, ret)`` against ``(date, bench)`` in one aggregation."""
    rf = risk_free / TRADING_DAYS
    b = with_drawdown(returns).join(benchmark, "date")
    r, active, n = F.col("ret"), F.col("ret") - F.col("bench"), F.count("ret")
    ann = F.pow(F.exp(F.sum(_growth())), TRADING_DAYS / n) - 1
    down = F.sqrt(F.avg(F.least(r - rf, F.lit(0.0)) ** 2))
    q = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.95)))
    return b.groupBy("strategy_id").agg(
        n.alias("n"),
        F.coalesce(div(F.avg(r) - rf, F.stddev_samp(r)) * YEAR, F.lit(0.0)).alias("sharpe"),
        (div(F.avg(r) - rf, down) * YEAR).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        div(ann, F.abs(F.min("drawdown"))).alias("calmar"),
        (div(F.avg(active), F.stddev_samp(active)) * YEAR).alias("information_ratio"),
        ann.alias("ann_return"),
        (F.stddev_samp(r) * YEAR).alias("ann_vol"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        div(F.sum(F.greatest(r, F.lit(0.0))), F.abs(F.sum(F.least(r, F.lit(0.0))))).alias("profit_factor"),
        div(q[1], F.abs(q[0])).alias("tail_ratio"),
        div(F.covar_samp("ret", "bench"), F.var_samp("bench")).alias("beta"),
    )


def probabilistic_sharpe(returns: DataFrame, target: float = 0.0) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds a target, with bias-corrected skewness and kurtosis."""
    r, n = F.col("ret"), F.count("ret")
    m = returns.groupBy("strategy_id").agg(n.alias("n"), F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"))
    m = m.withColumn("skew", F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2) * F.col("g1"))
    m = m.withColumn("kurt", (F.col("n") - 1) / ((F.col("n") - 2) * (F.col("n") - 3)) * ((F.col("n") + 1) * F.col("g2") + 6) + 3)
    sr = div("mu", "sd")
    spread = F.sqrt(1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr)
    return m.filter("n > 3").select("strategy_id", "n", "skew", "kurt", norm_cdf(div((sr - target) * F.sqrt(F.col("n") - 1), spread)).alias("psr"))


def drawdown_spells(returns: DataFrame) -> DataFrame:
    """Number and mean length of the completed drawdowns."""
    b = with_drawdown(returns).withColumn("_in", (F.col("drawdown") < -1e-12).cast("int"))
    b = b.withColumn("_new", F.when((F.col("_in") == 1) & (F.coalesce(F.lag("_in").over(by_strategy()), F.lit(0)) == 0), 1).otherwise(0))
    b = b.withColumn("_spell", F.sum("_new").over(by_strategy().rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("date").over(Window.partitionBy("strategy_id"))
    spells = b.withColumn("_last", last).filter("_in = 1").groupBy("strategy_id", "_spell", "_last").agg(F.count("*").alias("length"), F.max("date").alias("to"))
    return spells.filter("to < _last").groupBy("strategy_id").agg(F.count("*").alias("spells"), F.avg("length").alias("mean_length"))


def block_bootstrap_means(returns: DataFrame, sims: int = 200, block: int = 20, seed: int = 42) -> DataFrame:
    """Percentiles of the annual mean over block-resampled series of ``(row, ret)``, rows numbered from 0.

    The starts come from a hash of simulation and block number, so that a lost task draws the same again.
    """
    n = returns.count()
    if n == 0:
        return returns.sparkSession.createDataFrame([], "low double, middle double, high double")
    blocks = -(-n // block)
    draws = returns.sparkSession.range(sims * blocks).select((F.col("id") / blocks).cast("long").alias("sim"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("start"))
    picked = draws.select("sim", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"), "start").select("sim", ((F.col("start") + F.col("k")) % n).alias("row"))
    means = picked.join(returns, "row").groupBy("sim").agg((F.avg("ret") * TRADING_DAYS).alias("mean"))
    return means.agg(*[F.percentile("mean", p).alias(c) for p, c in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))])

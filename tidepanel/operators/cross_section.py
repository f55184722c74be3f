"""Operators within a date's cross-section; each takes a panel with a signal column and returns it with ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_date, demean, div, norm_ppf, rank_pct, residual, zscore


def cross_rank(panel: DataFrame, x: str) -> DataFrame:
    return panel.withColumn("value", rank_pct(x))


def cross_demean(panel: DataFrame, x: str) -> DataFrame:
    return panel.withColumn("value", demean(x))


def cross_zscore(panel: DataFrame, x: str, bound: float | None = 4.0) -> DataFrame:
    return panel.withColumn("value", zscore(x, bound))


def winsorize(panel: DataFrame, x: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """x within its date's quantiles, linearly interpolated."""
    bounds = panel.groupBy("date").agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("_q"))
    value = F.when(F.col(x).isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col(x))))
    return panel.join(bounds, "date").withColumn("value", value).drop("_q")


def rank_normal(panel: DataFrame, x: str, bound: float = 1e-4) -> DataFrame:
    """Inverse normal of the rank, which is kept ``bound`` away from 0 and 1."""
    b = panel.withColumn("_p", F.greatest(F.lit(bound), F.least(F.lit(1 - bound), rank_pct(x))))
    return b.withColumn("value", F.when(F.col(x).isNotNull(), norm_ppf("_p"))).drop("_p")


def group_neutral(panel: DataFrame, x: str, group: str, least: int = 3) -> DataFrame:
    """x less its group's mean on that date; x itself in groups with fewer than ``least`` tickers at all."""
    sizes = panel.select(group, "ticker").distinct().groupBy(group).agg(F.count("*").alias("_n"))
    return panel.join(sizes, group).withColumn("value", F.when(F.col("_n") >= least, demean(x, ["date", group])).otherwise(F.col(x))).drop("_n")


def size_neutral(panel: DataFrame, y: str, x: str, least: int = 10) -> DataFrame:
    return panel.withColumn("value", residual(y, x, least))


def partial_neutral(panel: DataFrame, y: str, x: str, strength: float = 0.5) -> DataFrame:
    return panel.withColumn("value", residual(y, x, 10, strength))


def two_factor_neutral(panel: DataFrame, y: str, x1: str, x2: str, least: int = 12) -> DataFrame:
    """Least-squares residual on two exposures within a date, from sums of products; y where too few or collinear."""
    ok = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()
    b = panel
    for name in (y, x1, x2):
        b = b.withColumn(f"_c_{name}", F.when(ok, F.col(name) - F.avg(F.when(ok, F.col(name))).over(by_date())))
    a, c, d = (F.col(f"_c_{n}") for n in (x1, x2, y))
    s11, s22, s12, s1y, s2y = (F.sum(v).over(by_date()) for v in (a * a, c * c, a * c, a * d, c * d))
    det = s11 * s22 - s12 * s12
    b1, b2 = div(s1y * s22 - s2y * s12, det), div(s2y * s11 - s1y * s12, det)
    fitted = d - b1 * a - b2 * c
    enough = (F.count(F.when(ok, 1)).over(by_date()) >= least) & b1.isNotNull() & ok
    return b.withColumn("value", F.when(enough, fitted).otherwise(F.col(y))).drop(*[f"_c_{n}" for n in (y, x1, x2)])


def orthogonal_blend(panel: DataFrame, main: str, other: str, weight: float = 0.7, least: int = 10) -> DataFrame:
    """Rank of the blend of a signal's rank and of the rank of what another signal adds to it."""
    b = panel.withColumn("_o", residual(other, main, least))
    b = b.withColumn("_b", F.round(weight * rank_pct(main) + (1 - weight) * rank_pct("_o"), 9))
    return b.withColumn("value", rank_pct("_b")).drop("_o", "_b")


def weighted_composite(panel: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rank of the weighted sum of signal ranks; weights are scaled to one, a null in any signal makes it null."""
    whole = sum(abs(w) for w in weights.values())
    b = panel.withColumn("_s", F.round(sum((w / whole * rank_pct(x) for x, w in weights.items()), F.lit(0.0)), 9))
    return b.withColumn("value", rank_pct("_s")).drop("_s")


def interaction(panel: DataFrame, x: str, y: str) -> DataFrame:
    return panel.withColumn("_p", F.col(x) * F.col(y)).withColumn("value", zscore("_p")).drop("_p")


def quality_tilt(panel: DataFrame, signal: str, quality: str, tilt: float = 0.3) -> DataFrame:
    """The signal times 1 + tilt * z(quality), at least 0.1."""
    return panel.withColumn("value", F.col(signal) * F.greatest(F.lit(0.1), 1 + tilt * F.coalesce(zscore(quality, 2.0), F.lit(0.0))))


def investable(panel: DataFrame, size: str, share: float = 0.5) -> DataFrame:
    """1 for the largest share of a date's tickers by size, else 0."""
    return panel.withColumn("value", F.coalesce((rank_pct(size) >= 1 - share).cast("int"), F.lit(0)))


def select_with_caps(panel: DataFrame, score: str, group: str, n: int = 10, share: float = 0.3) -> DataFrame:
    """Per date the n best scores with at most floor(n * share) of a group, ties by ticker."""
    cap = max(1, int(n * share))
    order = [F.desc(score), F.asc("ticker")]
    inside = panel.filter(F.col(score).isNotNull()).withColumn("_g", F.row_number().over(Window.partitionBy("date", group).orderBy(*order))).filter(F.col("_g") <= cap)
    return inside.withColumn("value", F.row_number().over(Window.partitionBy("date").orderBy(*order))).filter(F.col("value") <= n).drop("_g")


def volatility_buckets(panel: DataFrame, score: str, vol: str, per_bucket: int = 3, buckets: int = 5) -> DataFrame:
    """Per date and volatility bucket the best scores."""
    b = panel.filter(F.col(score).isNotNull() & F.col(vol).isNotNull())
    b = b.withColumn("bucket", F.least(F.lit(buckets), F.ceil(rank_pct(vol) * buckets)).cast("int"))
    return b.withColumn("value", F.row_number().over(Window.partitionBy("date", "bucket").orderBy(F.desc(score), "ticker"))).filter(F.col("value") <= per_bucket)


def capped_weights(panel: DataFrame, score: Column | str, low: float = 0.02, high: float = 0.15, rounds: int = 5) -> DataFrame:
    """Weights in proportion to score, clipped and scaled to one a fixed number of times."""
    b = panel.withColumn("value", F.col(score) if isinstance(score, str) else score)
    b = b.withColumn("value", div("value", F.sum("value").over(by_date())))
    for _ in range(rounds):
        b = b.withColumn("value", F.greatest(F.lit(low), F.least(F.lit(high), F.col("value"))))
        b = b.withColumn("value", div("value", F.sum("value").over(by_date())))
    return b

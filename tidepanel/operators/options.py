"""Option chains ``(date, ticker, dte, strike, kind, delta, iv, mid, volume, oi)`` to daily summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import div

DAY = ["date", "ticker"]


def quality_filter(chain: DataFrame, least_oi: int = 10, most_iv: float = 5.0) -> DataFrame:
    return chain.filter((F.col("oi") >= least_oi) & (F.col("iv") > 0) & (F.col("iv") < most_iv))


def volume_totals(chain: DataFrame) -> DataFrame:
    """Volume and open interest by side."""

    def side(kind: str, x: str):
        return F.sum(F.when(F.col("kind") == kind, F.col(x)).otherwise(0))

    return chain.groupBy(*DAY).agg(side("c", "volume").alias("call_volume"), side("p", "volume").alias("put_volume"), side("c", "oi").alias("call_oi"), side("p", "oi").alias("put_oi"))


def smile_fit(chain: DataFrame) -> DataFrame:
    """Line of volatility on delta per expiry."""
    return chain.groupBy(*DAY, "dte").agg(F.regr_slope("iv", "delta").alias("slope"), F.regr_intercept("iv", "delta").alias("level"), F.regr_r2("iv", "delta").alias("r2"), F.count("*").alias("n"))


def bracket_expiries(chain: DataFrame, target: int = 30) -> DataFrame:
    """The last expiry up to the target and the first from it on."""
    return chain.groupBy(*DAY).agg(F.max(F.when(F.col("dte") <= target, F.col("dte"))).alias("near"), F.min(F.when(F.col("dte") >= target, F.col("dte"))).alias("far"))


def delta_bucket(chain: DataFrame, target: float) -> DataFrame:
    """Volatility at a delta per expiry, linear between its neighbours; null outside the quotes."""
    below, above = F.col("delta") <= target, F.col("delta") >= target

    def near(side, x: str, sign: int):
        return F.min_by(F.when(side, F.col(x)), F.when(side, F.struct(sign * F.col("delta"), F.col("iv"))))

    ends = chain.groupBy(*DAY, "dte").agg(near(below, "delta", -1).alias("d0"), near(below, "iv", -1).alias("v0"), near(above, "delta", 1).alias("d1"), near(above, "iv", 1).alias("v1"))
    inner = F.col("v0") + F.coalesce(div(F.lit(target) - F.col("d0"), F.col("d1") - F.col("d0")), F.lit(0.0)) * (F.col("v1") - F.col("v0"))
    return ends.select(*DAY, "dte", inner.alias("value"))


def atm_volatility(chain: DataFrame) -> DataFrame:
    """Mean of the call's and the put's volatility whose delta is nearest to a half, per expiry."""
    nearest = F.min_by("iv", F.struct(F.round(F.abs(F.col("delta") - 0.5), 4), F.col("strike"), F.col("iv")))
    sides = chain.groupBy(*DAY, "dte", "kind").agg(nearest.alias("iv"))
    return sides.groupBy(*DAY, "dte").agg(F.avg("iv").alias("value"))


def trapezoid_variance(chain: DataFrame, least: int = 3) -> DataFrame:
    """Integral of 2 (1 - ln(K / S)) / K^2 times price over strikes, per expiry, by the trapezoid rule; the mean strike stands for the forward."""
    key = [*DAY, "dte"]
    one = chain.groupBy(*key, "strike").agg(F.avg("mid").alias("mid"))
    b = one.withColumn("s", F.avg("strike").over(Window.partitionBy(*key)))
    b = b.withColumn("f", 2 * (1 - F.ln(F.col("strike") / F.col("s"))) / F.col("strike") ** 2 * F.col("mid"))
    order = Window.partitionBy(*key).orderBy("strike")
    b = b.withColumn("a", (F.col("f") + F.lag("f").over(order)) / 2 * (F.col("strike") - F.lag("strike").over(order)))
    return b.groupBy(*key).agg(F.sum("a").alias("value"), F.count("*").alias("n")).filter(F.col("n") >= least)

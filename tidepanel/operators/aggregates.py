"""Tables by month, year, date, regime or period from daily returns and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, div, rank_pct


def compound(x: str = "ret"):
    """Compound return; a return is floored just above a total loss."""
    return F.expm1(F.sum(F.log1p(F.greatest(F.col(x), F.lit(-0.999999)))))


def monthly_returns(panel: DataFrame) -> DataFrame:
    return panel.groupBy("ticker", F.last_day("date").alias("month_end")).agg(compound().alias("value"))


def monthly_table(daily: DataFrame) -> DataFrame:
    """Year by month percentages and the year to date."""
    m = daily.withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    months = m.groupBy("year").pivot("month", list(range(1, 13))).agg(F.round(100 * compound(), 2))
    return months.join(m.groupBy("year").agg(F.round(100 * compound(), 2).alias("ytd")), "year")


def annual_returns(daily: DataFrame, benchmark: DataFrame, keys: list[str] | None = None) -> DataFrame:
    both = daily.join(benchmark.withColumnRenamed("ret", "bench"), "date")
    return both.groupBy(*(keys or []), F.year("date").alias("year")).agg(compound().alias("strategy"), compound("bench").alias("benchmark")).withColumn("alpha", F.col("strategy") - F.col("benchmark"))


def win_rate_monthly(daily: DataFrame) -> DataFrame:
    m = daily.groupBy(F.last_day("date").alias("m")).agg(compound().alias("r"))
    return m.agg(F.avg((F.col("r") > 0).cast("double")).alias("value"), F.count("*").alias("months"))


def information_coefficient(panel: DataFrame, signal: str, forward: str, least: int = 10) -> DataFrame:
    """Rank correlation of signal and forward return per date with at least so many pairs."""
    both = panel.filter(F.col(signal).isNotNull() & F.col(forward).isNotNull())
    ranked = both.withColumn("_a", rank_pct(signal)).withColumn("_b", rank_pct(forward))
    return ranked.groupBy("date").agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame) -> DataFrame:
    return ic.agg(F.avg("ic").alias("mean_ic"), div(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("*").alias("days"))


def breadth(panel: DataFrame, above: str) -> DataFrame:
    """Share of a date's tickers with close above a column; unknown counts as below."""
    return panel.groupBy("date").agg(F.avg(F.coalesce(F.col("close") > F.col(above), F.lit(False)).cast("double")).alias("value"))


def highs_less_lows(panel: DataFrame, high: str, low: str) -> DataFrame:
    up, down = (F.sum(F.coalesce(F.col("close") == F.col(c), F.lit(False)).cast("int")) for c in (high, low))
    return panel.groupBy("date").agg((div(up - down, F.count("close"))).alias("value"))


def advance_decline(panel: DataFrame) -> DataFrame:
    ups, downs = F.sum((F.col("ret") > 0).cast("int")), F.sum((F.col("ret") < 0).cast("int"))
    return panel.groupBy("date").agg(div(ups, downs).alias("value"))


def market_series(panel: DataFrame) -> DataFrame:
    """Equal-weight return per date."""
    return panel.groupBy("date").agg(F.avg("ret").alias("ret")).filter("ret is not null")


def by_regime(daily: DataFrame, regime: str, risk_free: float = 0.02, least: int = 20) -> DataFrame:
    rf = risk_free / TRADING_DAYS
    out = daily.filter(F.col(regime).isNotNull()).groupBy(regime).agg(
        F.count("*").alias("n"), (F.avg("ret") * TRADING_DAYS).alias("ann_return"), (F.stddev_samp("ret") * TRADING_DAYS**0.5).alias("ann_vol"), (div(F.avg("ret") - rf, F.stddev_samp("ret")) * TRADING_DAYS**0.5).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate")
    )
    return out.filter(F.col("n") >= least)


def stress(daily: DataFrame, periods: DataFrame, least: int = 5) -> DataFrame:
    """Return, volatility and number of days in named periods ``(name, first, last)``; null where the sample has too few days."""
    hit = F.broadcast(periods).join(daily, (F.col("date") >= F.col("first")) & (F.col("date") <= F.col("last")), "left")  # periods: a short named list
    out = hit.groupBy("name").agg(F.count("ret").alias("days"), compound().alias("total_return"), (F.stddev_samp("ret") * TRADING_DAYS**0.5).alias("volatility"))
    return out.select("name", "days", *[F.when(F.col("days") >= least, F.col(c)).alias(c) for c in ("total_return", "volatility")])


def sector_allocation(weights: DataFrame) -> DataFrame:
    return weights.groupBy("date", "sector").agg(F.sum("weight").alias("value"))


def portfolio_stats(weights: DataFrame) -> DataFrame:
    """Positions, exposure, largest and five largest weights per date."""
    order = Window.partitionBy("date").orderBy(F.desc("weight"), "ticker")
    top = weights.withColumn("_k", F.row_number().over(order))
    return top.groupBy("date").agg(F.count_if(F.col("weight") > 0).alias("positions"), F.sum("weight").alias("exposure"), F.max("weight").alias("largest"), F.sum(F.when(F.col("_k") <= 5, F.col("weight"))).alias("top_five"))


def fills_by(fills: DataFrame, *keys: str) -> DataFrame:
    """Quantity, volume-weighted price, signed cash and times of fills by the keys."""
    notional = F.col("qty") * F.col("price")
    return fills.groupBy(*keys).agg(
        F.count("*").alias("n_fills"), F.sum("qty").alias("qty"), div(F.sum(notional), F.sum("qty")).alias("vwap"), F.sum(notional).alias("notional"),
        F.sum(F.when(F.col("side") == "BUY", -notional).otherwise(notional)).alias("net_cash"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def slippage(fills: DataFrame, expected: DataFrame) -> DataFrame:
    """Side-adjusted basis points against an expected price, summed up by side."""
    bps = div(F.when(F.col("side") == "BUY", F.col("price") - F.col("expected")).otherwise(F.col("expected") - F.col("price")), "expected") * 10_000
    each = fills.join(expected, "account").withColumn("bps", bps).filter("bps is not null")
    return each.groupBy("side").agg(F.count("*").alias("n"), F.avg("bps").alias("mean"), F.median("bps").alias("median"), F.min("bps").alias("least"), F.max("bps").alias("most"), F.stddev_samp("bps").alias("std"))

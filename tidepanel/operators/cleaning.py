"""Universe, calendar and bar cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_ticker, div, lag


def adjust(bars: DataFrame, adjusted: str) -> DataFrame:
    """Open, high and low times adjusted close over close; a zero or missing ratio counts as one."""
    f = F.coalesce(div(F.nullif(F.col(adjusted), F.lit(0.0)), "close"), F.lit(1.0))
    return bars.withColumn("factor", f).withColumn("high", F.col("high") * f).withColumn("low", F.col("low") * f)


def densify(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each calendar date between a ticker's first and last one: prices carried forward, volume zero."""
    days = calendar.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("_days"))
    life = bars.groupBy("ticker").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    # one row, an array as long as the calendar
    grid = life.crossJoin(F.broadcast(days)).select("ticker", F.explode(F.filter("_days", lambda d: (d >= F.col("_from")) & (d <= F.col("_to")))).alias("date"))
    past = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    both = grid.join(bars, ["ticker", "date"], "left")
    return both.withColumn("close", F.last("close", ignorenulls=True).over(past)).withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def quality_drop(bars: DataFrame, least_rows: int = 60, penny: float = 0.01, most_penny: float = 0.05) -> DataFrame:
    """Bars without tickers that have too few rows or too many closes of nearly nothing."""
    stats = bars.groupBy("ticker").agg(F.count("close").alias("n"), F.avg((F.col("close") <= penny).cast("double")).alias("p"))
    bad = stats.filter((F.col("n") < least_rows) | (F.col("p") > most_penny))
    return bars.join(bad.select("ticker"), "ticker", "left_anti")


def sentinel_drop(bars: DataFrame, most_close: float, most_move: float) -> DataFrame:
    """Bars without tickers that ever show an absurd price or move."""
    stats = bars.withColumn("_m", F.abs(div("close", lag("close")) - 1)).groupBy("ticker").agg(F.max("close").alias("c"), F.max("_m").alias("m"))
    return bars.join(stats.filter((F.col("c") > most_close) | (F.col("m") > most_move)).select("ticker"), "ticker", "left_anti")


def coverage_gate(bars: DataFrame, column: str, least: float) -> DataFrame:
    """``value``: the column, null for tickers of which too small a share of rows has it."""
    share = F.avg(F.col(column).isNotNull().cast("double")).over(Window.partitionBy("ticker"))
    return bars.withColumn("value", F.when(share >= least, F.col(column)))


def clean_symbol(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.col(x) if isinstance(x, str) else x)), r"[^A-Z0-9]+", "-")


def rebalance_dates(calendar: DataFrame, nth: int = 3) -> DataFrame:
    """The nth trading day of each month, its last one if it has fewer."""
    month = Window.partitionBy(F.trunc("date", "month")).orderBy("date")
    whole = Window.partitionBy(F.trunc("date", "month"))
    ranked = calendar.select("date").distinct().withColumn("_k", F.row_number().over(month)).withColumn("_n", F.count("*").over(whole))
    return ranked.filter(F.col("_k") == F.least(F.lit(nth), F.col("_n"))).select("date")


def add_business_days(x: Column | str, n: int) -> Column:
    """The nth weekday after a date; holidays are not known."""
    d = F.col(x) if isinstance(x, str) else x
    days = F.filter(F.sequence(F.date_add(d, 1), F.date_add(d, 2 * n + 6)), lambda v: F.weekday(v) < 5)
    return F.get(days, n - 1)


def settlement_dates(calendar: DataFrame) -> DataFrame:
    """The 15th and the last day of each month in the calendar, moved back to a weekday."""
    months = calendar.select(F.trunc("date", "month").alias("m")).distinct()
    both = months.select(F.explode(F.array(F.date_add("m", 14), F.last_day("m"))).alias("d"))
    return both.select(F.date_sub("d", F.greatest(F.weekday("d") - 4, F.lit(0))).alias("date"))


def ranges_to_label(rows: DataFrame, column: str, ranges: DataFrame, default: str = "Unknown") -> DataFrame:
    """``label`` of the first range ``(low, high, label)`` that holds the value; the range table is a short fixed list."""
    hit = rows.join(F.broadcast(ranges), (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")), "left")
    return hit.withColumn("label", F.coalesce("label", F.lit(default))).drop("low", "high")

"""As-of, tolerance, interval and outer joins of panels, none of which compares all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(panel: DataFrame, facts: DataFrame, value: str, lag_days: int = 0, key: str = "ticker") -> DataFrame:
    """The panel with the latest fact of its key whose date plus lag is not later than the panel's date.

    ``facts(key, date, value)`` has one row per key and date. Both sides are laid on one time line per key, and
    the last fact is carried forward: one shuffle on the key, and no pairs. Facts sort before panel rows of
    the same date. Dates without an earlier fact get null.
    """
    left = panel.withColumn("_fact", F.lit(None).cast(facts.schema[value].dataType)).withColumn("_at", F.col("date")).withColumn("_side", F.lit(1))
    right = facts.select(F.col(key), F.date_add("date", lag_days).alias("_at"), F.col(value).alias("_fact"), F.lit(0).alias("_side"))
    line = left.unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn(value, F.last("_fact", ignorenulls=True).over(past)).filter("_side = 1").drop("_fact", "_at", "_side")


def nearest_event(panel: DataFrame, events: DataFrame, key: str = "ticker") -> DataFrame:
    """Adds ``to_next``, days to the next later event, ``since_last``, days since the last one up to the date, and ``signed``, the nearer of both."""
    left = panel.withColumn("_event", F.lit(None).cast("date")).withColumn("_at", F.col("date")).withColumn("_side", F.lit(1))
    right = events.select(F.col(key), F.col("date").alias("_at"), F.col("date").alias("_event"), F.lit(0).alias("_side")).distinct()
    line = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side")
    last = F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_event", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    out = line.withColumn("_last", last).withColumn("_next", after).filter("_side = 1")
    out = out.withColumn("since_last", F.datediff("date", "_last")).withColumn("to_next", F.datediff("_next", "date"))
    signed = F.when(F.col("to_next").isNull() | (F.col("since_last") <= F.col("to_next")), -F.col("since_last")).otherwise(F.col("to_next"))
    return out.withColumn("signed", signed).drop("_event", "_at", "_side", "_last", "_next")


def next_trading_day(dates: DataFrame, calendar: DataFrame, column: str = "date") -> DataFrame:
    """Adds ``trade_date``, the first calendar date on or after the row's date, by one pass over the joint time line."""
    days = dates.select(F.col(column).alias("_at"), F.lit(None).cast("date").alias("_day"), F.lit(0).alias("_side")).distinct()
    line = days.union(calendar.select("date", "date", F.lit(1)))
    # one row per calendar date: the line is as long as the calendar, whatever the number of tickers
    order = Window.orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
    mapped = line.withColumn("trade_date", F.first("_day", ignorenulls=True).over(order)).filter("_side = 0").select("_at", "trade_date")
    return dates.join(mapped, F.col(column) == F.col("_at"), "left").drop("_at")


def trades(target: DataFrame, prior: DataFrame, notional: float = 100_000.0, least: float = 50.0) -> DataFrame:
    """Orders that turn prior into target weights: full outer join, side, money, noise filtered."""
    both = target.select("ticker", F.col("weight").alias("_t")).join(prior.select("ticker", F.col("weight").alias("_p")), "ticker", "full")
    delta = (F.coalesce("_t", F.lit(0.0)) - F.coalesce("_p", F.lit(0.0))) * notional
    out = both.select("ticker", delta.alias("delta"))
    return out.filter(F.abs("delta") >= least).select("ticker", F.when(F.col("delta") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("delta").alias("money"))


def drift_report(target: DataFrame, actual: DataFrame) -> DataFrame:
    """Weight drift by ticker of one book against another, missing weights counting as zero."""
    both = target.select("date", "ticker", F.col("weight").alias("_t")).join(actual.select("date", "ticker", F.col("weight").alias("_a")), ["date", "ticker"], "full")
    d = F.coalesce("_a", F.lit(0.0)) - F.coalesce("_t", F.lit(0.0))
    return both.groupBy("date").agg(F.sum(F.abs(d)).alias("l1"), F.max(F.abs(d)).alias("largest"), F.count("*").alias("names"))


def bought_near_loss(sells: DataFrame, buys: DataFrame, days: int = 31) -> DataFrame:
    """Buys within so many days after a sale at a loss of the same account and ticker.

    The last sale before each buy decides: both are laid on one time line, so no pair of sales and buys is made.
    """
    left = buys.withColumn("_loss", F.lit(None).cast("timestamp_ntz")).withColumn("_side", F.lit(1))
    right = sells.filter("loss > 0").select("account", "ticker", "ts", F.col("ts").alias("_loss"), F.lit(0).alias("_side"))
    line = left.unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy("account", "ticker").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = line.withColumn("_last", F.last("_loss", ignorenulls=True).over(past)).filter("_side = 1")
    return out.withColumn("blocked", F.coalesce(F.col("ts") < F.col("_last") + F.expr(f"INTERVAL {days} DAYS"), F.lit(False))).drop("_loss", "_side", "_last")


def latest(rows: DataFrame, key: str | list[str], order: Column | str) -> DataFrame:
    """The last version of each key; rows superseded by it go."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order)
    return rows.withColumn("_v", F.row_number().over(w)).filter("_v = 1").drop("_v")


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which new rows replace old ones of equal keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.desc("_new")).drop("_new")

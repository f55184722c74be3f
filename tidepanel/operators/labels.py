"""Labels, walk-forward folds and sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import by_ticker, rank_pct

GRADES = (0.2, 0.4, 0.6, 0.8, 0.95)


def graded_labels(bars: DataFrame, window: int = 5) -> DataFrame:
    """Grade 0 to 5 of the forward return's rank on its date; null on a ticker's last rows."""
    frame = by_ticker().rowsBetween(1, window)
    b = bars.withColumn("_f", F.when(F.count("ret").over(frame) == window, F.round(F.sum("ret").over(frame), 9)))
    b = b.withColumn("_r", rank_pct("_f"))
    grade = sum(((F.col("_r") > g).cast("int") for g in GRADES), F.lit(0))
    return b.withColumn("value", F.when(F.col("_r").isNotNull(), grade)).drop("_f", "_r")


def folds(calendar: DataFrame, train: int, step: int, embargo: int) -> DataFrame:
    """Walk-forward folds over the trading dates: train from and to, test from and to; the embargo lies between."""
    numbered = calendar.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1)  # one row per trading date
    last = numbered.agg(F.max("k").alias("m"))
    starts = last.select(F.explode(F.sequence(F.lit(train + embargo), F.greatest(F.col("m"), F.lit(train + embargo)), F.lit(step))).alias("s"), "m").filter("s <= m")
    marks = starts.select(F.floor((F.col("s") - train - embargo) / step).cast("int").alias("fold"), F.explode(F.create_map(F.lit("train_from"), F.col("s") - train - embargo, F.lit("train_to"), F.col("s") - embargo - 1, F.lit("test_from"), F.col("s"), F.lit("test_to"), F.least(F.col("s") + step - 1, F.col("m")))).alias("name", "k"))
    return marks.join(numbered, "k").groupBy("fold").pivot("name", ["train_from", "train_to", "test_from", "test_to"]).agg(F.first("date"))


def uniqueness(label_dates: DataFrame, window: int = 5) -> DataFrame:
    """Mean over a label's span of one over the number of labels alive, by date."""
    per = label_dates.groupBy("date").agg(F.count("*").alias("n"))  # one row per trading date from here on
    order = Window.orderBy("date")
    alive = per.withColumn("c", F.sum("n").over(order.rowsBetween(1 - window, 0)))
    return alive.withColumn("value", F.avg(1 / F.col("c")).over(order.rowsBetween(0, window - 1))).select("date", "value")

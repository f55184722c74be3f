"""Principal components of a curve's weekly changes, fitted up to a cut-off, and returns' exposure to them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import lag
from tidepanel.operators.macro_signals import beta, ranked


def weekly_changes(curve: DataFrame, columns: list[str]) -> DataFrame:
    """``(date, *columns)``: the change of each column from one week's last value to the next week's, by the Friday that ends the week.

    Values are carried on from day to day first. Weeks that lack a value in any column, and the first week, have no row.
    One row a date goes in and one a week comes out, so the windows over all of them stay small.
    """
    past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    week = F.floor((F.unix_date("date") - 2) / 7)  # Saturday to Friday
    held = curve.select("date", week.alias("_week"), *[F.last(c, ignorenulls=True).over(past).alias(c) for c in columns])
    last = held.groupBy("_week").agg(*[F.max_by(c, "date").alias(c) for c in columns])
    order = Window.orderBy("_week")
    change = last.select(F.date_from_unix_date((F.col("_week") * 7 + 8).cast("int")).alias("date"), *[(F.col(c) - F.lag(c).over(order)).alias(c) for c in columns])
    return change.dropna(subset=columns)


def loadings(changes: DataFrame, columns: list[str], cutoff: Column, least: int = 30) -> DataFrame:
    """One row ``(mean, vectors, share)``: means, unit vectors by falling variance and their shares of it, from the rows up to ``cutoff``; no row if there are fewer than ``least``.

    Each vector's largest entry in size is positive, the first of equals, so signs don't depend on the solver. Only
    means and covariances, aggregated, leave the tasks.
    """
    pairs = [F.covar_samp(a, b) for a, b in product(columns, columns)]
    one = changes.filter(F.col("date") <= cutoff).agg(F.count("*").alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*pairs).alias("cov")).filter(F.col("n") >= least)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                values, vectors = np.linalg.eigh(np.array(r.cov).reshape(len(columns), -1))
                values, vectors = values[::-1], vectors[:, ::-1].T
                size = np.abs(vectors)
                first = np.argmax(size >= size.max(axis=1, keepdims=True) - 1e-12, axis=1)
                vectors = vectors * np.sign(vectors[np.arange(len(vectors)), first])[:, None]
                total = max(values.sum(), 1e-300)
                out.append((list(r.mean), vectors.tolist(), (values / total).tolist()))
            yield pd.DataFrame(out, columns=["mean", "vectors", "share"])

    return one.mapInPandas(solve, "mean array<double>, vectors array<array<double>>, share array<double>")


def scores(changes: DataFrame, columns: list[str], fit: DataFrame, k: int) -> DataFrame:
    """``(date, score)`` of each week on component ``k`` (0 is the first): later weeks are measured by the same vectors."""
    b = changes.crossJoin(F.broadcast(fit))  # one row
    score = sum(((F.col(c) - F.col("mean")[j]) * F.col("vectors")[k][j] for j, c in enumerate(columns)), F.lit(0.0))
    return b.select("date", score.alias("score"))


def component_beta(bars: DataFrame, curve: DataFrame, columns: list[str], cutoff: Column, k: int = 1, window: int = 1260, least: int = 252) -> DataFrame:
    """``bars`` with ``beta`` to the daily change of a component's score (the second, the slope, by default), and ``value``, its rank on the date.

    A day has the score of the last week that ended on it or before, so its change is zero but on the first day after a
    week's end. Vectors come from weeks up to ``cutoff`` alone: rows after it move no value up to it. Without enough
    weeks to fit, there are no rows.
    """
    change = weekly_changes(curve, columns)
    weekly = scores(change, columns, loadings(change, columns, cutoff), k)
    days = bars.select("date").distinct().select("date", F.lit(None).cast("double").alias("score"), F.lit(1).alias("_day"))
    line = days.unionByName(weekly.withColumn("_day", F.lit(0)))
    last = F.last("score", ignorenulls=True).over(Window.orderBy("date", "_day").rowsBetween(Window.unboundedPreceding, 0))  # one row a date
    daily = line.withColumn("score", last).filter("_day = 1").select(F.lit(0).alias("ticker"), "date", "score")
    x = daily.withColumn("x", F.col("score") - lag("score")).select("date", "x")
    return ranked(beta(bars.join(x, "date"), "x", window, least), F.col("beta")).select(*bars.columns, "beta", "value")



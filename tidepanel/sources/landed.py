"""Readers of landed vendor files; each has an explicit schema and gives the inventory's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators.cleaning import add_business_days


def macro_series(spark: SparkSession, path: str, calendar: DataFrame) -> DataFrame:
    """A series CSV ``DATE,VALUE`` in which a dot is missing, carried to the calendar's dates and shown one date later."""
    raw = spark.read.schema("date date, value double").option("header", True).option("nullValue", ".").csv(path).filter("value is not null")
    line = calendar.select("date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")).union(raw.select("date", "value", F.lit(0)))
    order = Window.orderBy("date", "side")  # one row per calendar date and per value of one series
    seen = line.withColumn("seen", F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("side = 1")
    return seen.select("date", F.lag("seen").over(Window.orderBy("date")).alias("value"))


def short_interest(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-separated settlement files; published eight weekdays after settlement, rows without a count are left out."""
    schema = "settlement_date string, symbol string, shares_short double, days_to_cover double, avg_daily_vol double, exchange string"
    raw = spark.read.schema(schema).option("header", True).option("sep", "|").csv(path).filter("shares_short is not null")
    settled = F.to_date("settlement_date", "yyyyMMdd")
    return raw.withColumn("settlement_date", settled).withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("publication_date", add_business_days("settlement_date", 8))


def factor_returns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Daily factor files with text around the rows: lines that start with eight digits, percent to shares."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d{8}\s*,"))
    return rows.select(F.to_date(F.trim(parts[0]), "yyyyMMdd").alias("date"), *[(F.trim(parts[k]).cast("double") / 100).alias(n) for k, n in enumerate(names, 1)])


def snapshots(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Parquet files named by date, of which only those from first to last are read."""
    named = F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1))
    return spark.read.parquet(folder).withColumn("snapshot_date", named).filter(F.col("snapshot_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def company_facts(spark: SparkSession, path: str, concepts: list[str]) -> DataFrame:
    """Annual values of the first concept of an alias list that a company reports, one per filing date, in dollars where there are any."""
    entry = "struct<form:string,filed:string,val:double>"
    raw = spark.read.schema(f"cik string, facts map<string,map<string,struct<units:map<string,array<{entry}>>>>>").json(path)
    each = raw.select("cik", F.explode(F.col("facts")["us-gaap"]).alias("concept", "body")).filter(F.col("concept").isin(concepts))
    units = F.coalesce(F.col("body.units")["USD"], F.get(F.map_values("body.units"), 0))
    rows = each.select("cik", "concept", F.posexplode(units).alias("k", "e")).filter(F.col("e.form").isin("10-K", "10-K/A"))
    rank = F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept"))
    first = rows.withColumn("p", rank).withColumn("best", F.min("p").over(Window.partitionBy("cik"))).filter("p = best")
    return first.groupBy("cik", F.to_date("e.filed").alias("filed")).agg(F.max_by("e.val", "k").alias("value"))

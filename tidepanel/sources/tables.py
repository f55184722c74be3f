"""Panel tables read from order data: bars, sectors, macro series, factor returns, fundamentals, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import clip, lag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, month: bool = False) -> DataFrame:
    """Daily (or monthly) bars of suppliers: unit price open, high, low and average, quantity as volume, and the return."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        (F.trunc("l_shipdate", "month") if month else F.col("l_shipdate").cast("date")).alias("date"),
        "l_quantity",
        "l_extendedprice",
        F.try_divide("l_extendedprice", "l_quantity").alias("unit"),
    )
    daily = items.groupBy("ticker", "date").agg(
        F.max("unit").alias("high"), F.min("unit").alias("low"), F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )
    raw = F.try_divide(F.col("close"), lag("close")) - 1
    return daily.withColumn("ret", clip(raw, -1.0, 1.0))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker to region and nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average order price by priority and day as market series."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("value"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated facts of a ticker: customer number modulo the number of suppliers."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    return orders.select((F.col("o_custkey") % F.col("n") + 1).alias("ticker"), F.col("o_orderdate").cast("date").alias("filed"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("key"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors of the event table as BUY and SELL fills."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select(
        F.col("event_id").alias("fill_id"),
        F.get_json_object("props", "$.k").cast("long").alias("order_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("user_id").alias("account"),
        F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"),
        F.col("value").alias("price"),
        (F.col("event_id") % 7 + 1).cast("double").alias("qty"),
    )


def volatilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly stand-in for a panel of option summaries: discounts, taxes and quantities of a supplier's items as volatilities and interest."""
    items = table(spark, sf_dir, "lineitem")
    held = F.col("l_returnflag") == "N"
    raw = items.groupBy(F.col("l_suppkey").alias("ticker"), F.trunc("l_shipdate", "month").alias("date")).agg(
        *[f(c).alias(f"{n}_{c[2:]}") for c in ("l_discount", "l_tax") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))],
        F.max("l_quantity").alias("most"),
        F.coalesce(F.sum(F.when(held, F.col("l_quantity"))), F.lit(0.0)).alias("call_oi"),
        F.coalesce(F.sum(F.when(~held, F.col("l_quantity"))), F.lit(0.0)).alias("put_oi"),
    )
    d, t = "_discount", "_tax"
    iv = {7: 0.1 + 5 * F.col("max" + d), 30: 0.1 + 5 * F.col("avg" + d), 60: 0.1 + 6 * F.col("avg" + t), 90: 0.1 + 5 * F.col("max" + t), 180: 0.1 + 3 * (F.col("avg" + d) + F.col("avg" + t)), 365: 0.1 + 5 * F.col("min" + d) + F.col("min" + t)}
    return raw.select(
        "ticker", "date", "call_oi", "put_oi", *[x.alias(f"iv{k}") for k, x in iv.items()],
        (F.col("avg" + d) - F.col("avg" + t)).alias("slope"), (F.col("max" + d) - F.col("max" + t)).alias("cp_spread"), (F.col("most") / 100).alias("implied_move"),
        (F.col("avg" + t) - F.col("max" + t)).alias("implied_skew"), (3 + F.col("max" + d) - F.col("min" + d)).alias("implied_kurt"),
        (iv[30] - F.col("avg" + t) / 10).alias("call25"), (iv[30] + F.col("max" + t) / 10).alias("put25"), (iv[30] + F.col("max" + d)).alias("put5"), (iv[30] - F.col("min" + d) / 2).alias("event_free_iv30"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly stand-in for filed statements of a ticker: order sums by priority and status, and running sums as balances."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n))  # one row
    kinds = {"gross_profit": "1-URGENT", "sga": "2-HIGH", "rd": "3-MEDIUM", "dividends": "4-NOT SPECIFIED", "buybacks": "5-LOW"}
    part = {c: F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))) for c, p in kinds.items()}
    month = orders.groupBy((F.col("o_custkey") % F.col("n") + 1).alias("ticker"), F.trunc("o_orderdate", "month").alias("date")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count("*").cast("double").alias("shares"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("issuance"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("debt_issued"), F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("debt_repaid"), *[x.alias(c) for c, x in part.items()],
    )
    held = F.sum("revenue").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    m = month.withColumn("assets", held)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.select(
        "ticker", "date", "revenue", "shares", "issuance", "debt_issued", "debt_repaid", *kinds, "assets",
        (F.col("assets") * 0.4 + zero("debt_issued")).alias("liabilities"), (F.col("assets") * 0.5 - zero("rd")).alias("equity"), (zero("gross_profit") - zero("sga") / 2).alias("net_income"),
        (F.col("revenue") / 10).alias("operating_cf"), (zero("sga") / 5).alias("taxes"), (F.col("revenue") / 20).alias("interest"), (F.col("assets") / 8).alias("cash"),
    )

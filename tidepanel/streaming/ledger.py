"""Structured Streaming over the append-only fill ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def fill_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """Fills as they land in a folder: purchases and errors of the event table as BUY and SELL."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)
    sides = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "error", "SELL")
    return raw.select(F.col("event_id").alias("fill_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("account"), F.get_json_object("props", "$.k").cast("long").alias("order_id"), sides.alias("side"), F.col("value").alias("price"), (F.col("event_id") % 7 + 1).cast("double").alias("qty")).filter("side is not null")


def hourly_fills(fills: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Fills, quantity and money by side and window; a window is final once the watermark has passed its end."""
    once = fills.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fill_id"])
    return once.groupBy(F.window("ts", width), "side").agg(F.count("*").alias("n_fills"), F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("notional"))


def traded_prices(fills: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Quantity, notional, average price and mean slippage of each symbol and window. ``fills(ticker, ts, qty, price, expected)``; a null expected price has no slippage."""
    cost = F.when((F.col("expected") > 0) & (F.col("price") > 0), F.when(F.col("side") == "SELL", -1.0).otherwise(1.0) * (F.col("price") - F.col("expected")) / F.col("expected") * 10_000)
    rows = fills.withWatermark("ts", late).withColumn("bps", cost)
    out = rows.groupBy(F.window("ts", width), "ticker").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum(F.col("qty") * F.col("price")).alias("notional"), F.avg("bps").alias("bps"))
    return out.withColumn("vwap", F.try_divide("notional", "qty"))


def activity(events: DataFrame, key: str, width: str = "60 minutes", step: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Number of events, and purchases less sales, of each key in windows that slide by ``step``."""
    side = F.when(F.col("side") == "BUY", 1).when(F.col("side") == "SELL", -1).otherwise(0)
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), key).agg(F.count("*").alias("n"), F.sum(side).alias("net"))


def with_expected(fills: DataFrame, book: DataFrame, key: str) -> DataFrame:
    """A stream of fills with the expected price of a static ``book(key, expected)``; fills whose key it lacks have none. The book is read again for each batch."""
    return fills.join(book.select(key, "expected"), key, "left")


def drain(result: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that has landed, into Parquet with a checkpoint, and read what it wrote."""
    return run(result, f"{folder}/stream-{uuid.uuid4().hex}")


def run(result: DataFrame, base: str) -> DataFrame:
    """The same with output and checkpoint under ``base``; called again with it, it goes on where it stopped.

    The state is kept in RocksDB while it runs; the session's own choice is put back afterwards.
    """
    spark = result.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = result.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(result.schema).parquet(f"{base}/out")

"""Queries that run a stream to its end, and the SQL for the same rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.plans.cross import FILLS
from tidepanel.plans.lots_sql import STATE
from tidepanel.sources import tables
from tidepanel.streaming import breaker, ledger


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or a temporary folder where it is unset (one machine, tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tidepanel-")


def k4_fill_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.drain(ledger.hourly_fills(ledger.fill_stream(spark, sf_dir)), shared(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "side", "n_fills", (F.round("qty", 4) + 0.0).alias("qty"), (F.round("notional", 4) + 0.0).alias("notional"))


def trade_stream(spark: SparkSession, sf_dir: str, name: str = "events.parquet") -> DataFrame:
    """The fill stream in five tickers; an hour of it stands for a trading day, as in the queries over lots."""
    day = F.floor((F.unix_micros("ts") / 1_000_000 - 1_704_067_200) / 3600).cast("int")
    return ledger.fill_stream(spark, sf_dir, name).withColumn("ticker", F.col("order_id") % 5).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), day))


def st6_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.drain(breaker.breaches(trade_stream(spark, sf_dir), 1000.0), shared(spark))
    return out.select("account", F.col("ts").cast("timestamp_ntz").alias("ts"), "date", "fill_id", "decision", *[(F.round(c, 4) + 0.0).alias(c) for c in ("day_pnl", "total_pnl")])


def st3_traded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = tables.fills(spark, sf_dir).groupBy((F.col("order_id") % 5).alias("ticker")).agg(F.avg("price").alias("expected"))
    out = ledger.drain(ledger.traded_prices(ledger.with_expected(trade_stream(spark, sf_dir), book, "ticker")), shared(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "ticker", "n", *[(F.round(c, 7) + 0.0).alias(c) for c in ("qty", "notional", "vwap", "bps")])


def st4_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.drain(ledger.activity(trade_stream(spark, sf_dir), "ticker"), shared(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "ticker", "n", "net")


def st9_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = tables.fills(spark, sf_dir).filter("side = 'BUY'").groupBy("account").agg(F.avg("price").alias("expected"))
    out = ledger.drain(ledger.with_expected(ledger.fill_stream(spark, sf_dir), book, "account"), shared(spark))
    return out.select("fill_id", "account", "side", *[(F.round(c, 7) + 0.0).alias(c) for c in ("price", "expected")])


TABLE = {
    "ST3_traded_prices": (
        st3_traded_prices,
        f"WITH {FILLS}, t AS (SELECT *, order_id % 5 AS ticker FROM fills), e AS (SELECT ticker, avg(price) AS expected FROM t GROUP BY 1), w AS (SELECT t.*, CASE WHEN price > 0 AND expected > 0 THEN CASE side WHEN 'SELL' THEN -1 ELSE 1 END * (price - expected) / expected * 10000 END AS b, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start FROM t JOIN e USING (ticker)) SELECT window_start, ticker, count(*) AS n, round(sum(qty), 7) + 0.0 AS qty, round(sum(qty * price), 7) + 0.0 AS notional, round(sum(qty * price) / nullif(sum(qty), 0), 7) + 0.0 AS vwap, round(avg(b), 7) + 0.0 AS bps FROM w GROUP BY 1, 2 HAVING window_start + INTERVAL 5 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM fills)",
    ),
    "ST4_activity": (
        st4_activity,
        f"WITH {FILLS}, t AS (SELECT order_id % 5 AS ticker, side, ts, unnest(range(6)) AS k FROM fills), w AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start FROM t) SELECT window_start, ticker, count(*) AS n, CAST(sum(CASE side WHEN 'BUY' THEN 1 ELSE -1 END) AS BIGINT) AS net FROM w GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM fills)",
    ),
    "ST6_breaker": (
        st6_breaker,
        f"""{STATE}, ok AS (SELECT s.*, f.ts FROM sales s JOIN fills f ON f.fill_id = s.sale_id WHERE f.ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM fills)),
c AS (SELECT *, sum(gain) OVER (PARTITION BY account ORDER BY ts, sale_id) AS total_pnl, sum(gain) OVER (PARTITION BY account, sold ORDER BY ts, sale_id) AS day_pnl FROM ok),
v AS (SELECT *, CASE WHEN total_pnl <= -300 THEN 'total' WHEN day_pnl <= -50 THEN 'day' END AS decision FROM c)
SELECT account, ts, sold AS date, sale_id AS fill_id, decision, round(day_pnl, 4) + 0.0 AS day_pnl, round(total_pnl, 4) + 0.0 AS total_pnl FROM v WHERE decision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts, sale_id) = 1""",
    ),
    "ST9_expected_price": (
        st9_expected,
        f"WITH {FILLS}, e AS (SELECT account, avg(price) AS expected FROM fills WHERE side = 'BUY' GROUP BY 1) SELECT fill_id, account, side, round(price, 7) + 0.0 AS price, round(expected, 7) + 0.0 AS expected FROM fills LEFT JOIN e USING (account)",
    ),
    "K4_fill_stream": (
        k4_fill_stream,
        f"WITH {FILLS}, w AS (SELECT *, date_trunc('hour', ts) AS window_start FROM fills) SELECT window_start, side, count(*) AS n_fills, round(sum(qty), 4) + 0.0 AS qty, round(sum(qty * price), 4) + 0.0 AS notional FROM w GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM fills)",
    ),
}

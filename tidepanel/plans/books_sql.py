"""Queries of books, alignments and set operations, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import momentum, rank_pct
from tidepanel.operators import books as B
from tidepanel.plans import sql as S
from tidepanel.plans.cross import DAILY as STRATEGIES
from tidepanel.plans.cross import FILLS, WEIGHTS, daily, rounded, weights
from tidepanel.plans.derived_sql import VOLS
from tidepanel.plans.tables_sql import CAL, calendar
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
TD = ["ticker", "date"]
MARKET = "mk AS (SELECT 0 AS ticker, date, avg(ret) AS m FROM bars GROUP BY date)"


def _market(s: SparkSession, d: str, month: bool = False) -> DataFrame:
    return tables.bars(s, d, month).groupBy("date").agg(F.avg("ret").alias("ret"))


def _coskew(month: bool, n: int, least: int) -> tuple[Query, str]:
    text = f"""WITH {S.MONTHLY if month else S.DAILY}, {MARKET}, k AS (SELECT date, pow(m - {S.avg('m', n, least)}, 2) AS m2, {S.var('m', n, least)} AS mv FROM mk),
    p AS (SELECT b.*, m2, mv, (ret - {S.avg('ret', n, least)}) * m2 AS prod FROM bars b JOIN k USING (date)), c AS (SELECT ticker, date, {S.div(S.avg('prod', n, least), S.std('ret', n, least) + ' * mv')} AS raw FROM p),
    q AS (SELECT ticker, date, -round({S.clip('raw', -3, 3)}, 9) AS c FROM c) SELECT ticker, date, round({S.rank_pct('c')}, 6) + 0.0 AS value FROM q"""
    return lambda s, d: rounded(B.coskewness_signal(tables.bars(s, d, month), _market(s, d, month), n, least), TD, ["value"]), text


def _tailwind(s: SparkSession, d: str) -> DataFrame:
    return rounded(B.sector_tailwind(tables.bars(s, d, True), tables.sectors(s, d)), TD, ["value"])


def _forced(s: SparkSession, d: str) -> DataFrame:
    w = weights(s, d).withColumn("big", F.col("ticker") % 50 == 1).withColumn("score", F.round("close", 9))
    book = w.withColumn("weight", F.when(~F.col("big"), F.col("weight")))
    return rounded(B.force_names(book, F.col("big"), "score", share=0.003), TD, ["value"])


def _orders(s: SparkSession, d: str) -> DataFrame:
    o = tables.table(s, d, "orders")
    return o.select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 500).alias("notional"))


def _slippage(s: SparkSession, d: str) -> DataFrame:
    f = tables.fills(s, d)
    return rounded(B.slippage_bps(f, f.groupBy("account").agg(F.avg("price").alias("expected")), "account"), ["fill_id"], ["bps"], 4)


def _blend(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True)
    rule = b.withColumn("m", F.round(momentum("close", 3), 9)).filter("m is not null").withColumn("value", rank_pct("m")).select(*TD, "value")
    learnt = b.filter("ret is not null").withColumn("r", F.round("ret", 9)).withColumn("value", rank_pct("r")).select(*TD, "value")
    return rounded(B.blend(rule, learnt, 0.3), TD, ["value"])


def _month_ends(s: SparkSession, d: str) -> DataFrame:
    ends = calendar(s, d).select(F.last_day("date").alias("date")).distinct()
    return B.trade_date(ends, calendar(s, d))


def _with_macro(s: SparkSession, d: str) -> DataFrame:
    m = tables.macro(s, d).groupBy("date").agg(F.avg("value").alias("level"))
    return rounded(_market(s, d).filter("ret is not null").join(m, "date"), ["date"], ["ret", "level"])


def _stacked(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True)
    return rounded(b.unpivot(TD, ["close", "volume"], "field", "value").filter("value is not null"), [*TD, "field"], ["value"])


def _ids(s: SparkSession, d: str, table: str, column: str) -> DataFrame:
    return tables.table(s, d, table).select(F.col(column).alias("id"))


BOTH = "SELECT c_custkey AS id FROM customer", "SELECT o_custkey AS id FROM orders"

TABLE: dict[str, tuple[Query, str]] = {
    "C20_first_days": (lambda s, d: B.first_days(calendar(s, d)), f"WITH {CAL} SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS date FROM cal GROUP BY 1"),
    "W33_sector_tailwind": (
        _tailwind,
        f"WITH {S.MONTHLY}, {S.SECTORS}, n AS (SELECT sector, count(DISTINCT ticker) AS n FROM sectors GROUP BY 1), x AS (SELECT *, {S.div('close', S.lag('close', 21))} - 1 AS m FROM bars) SELECT ticker, date, round(CASE WHEN n < 3 THEN 0 ELSE avg(m) OVER (PARTITION BY date, sector) END, 6) + 0.0 AS value FROM x JOIN sectors USING (ticker) JOIN n USING (sector)",
    ),
    "W58_spread_change_rank": (
        lambda s, d: rounded(B.difference_rank(tables.volatilities(s, d).withColumn("cp_spread", F.round(F.col("cp_spread") * 100, 0)), "cp_spread", 5), TD, ["value"]),
        f"WITH {S.MONTHLY}, {VOLS}, o AS (SELECT ticker, date, round(cp_spread * 100, 0) AS x FROM v), c AS (SELECT ticker, date, round(x - {S.lag('x', 5)}, 9) AS c FROM o) SELECT ticker, date, round({S.rank_pct('c')}, 6) + 0.0 AS value FROM c",
    ),
    "W61_coskewness_monthly": _coskew(True, 60, 24),
    "W62_coskewness_daily": _coskew(False, 252, 126),
    "TK6_holdings": (
        lambda s, d: rounded(B.holdings(weights(s, d)), ["date", "ticker", "place"], ["weight"], 9),
        f"WITH {S.MONTHLY}, {WEIGHTS} SELECT date, ticker, row_number() OVER (ORDER BY weight DESC, ticker) AS place, round(weight, 9) + 0.0 AS weight FROM weights WHERE date = (SELECT max(date) FROM weights) AND weight > 0.001",
    ),
    "TK7_force_names": (
        _forced,
        f"WITH {S.MONTHLY}, {WEIGHTS}, w AS (SELECT ticker, date, ticker % 50 = 1 AS big, CASE WHEN ticker % 50 <> 1 THEN weight ELSE 0 END AS weight, round(close, 9) AS score FROM weights), r AS (SELECT *, big AND weight = 0 AND {S.rank_pct('score')} >= 0.6 AS f FROM w), n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS n FROM r), x AS (SELECT *, CASE WHEN f THEN 0.003 ELSE weight * greatest(0, 1 - 0.003 * n) END AS x FROM n) SELECT ticker, date, round(CASE WHEN n > 0 AND sum(x) OVER (PARTITION BY date) > 0 THEN x / sum(x) OVER (PARTITION BY date) ELSE x END, 6) + 0.0 AS value FROM x",
    ),
    "TK10_own_volatility": (
        lambda s, d: rounded(B.scale_to_own_volatility(weights(s, d), lookback=24, least=12), ["date"], ["value"]),
        f"WITH {S.MONTHLY}, {WEIGHTS}, c AS (SELECT date, {S.lag('weight')} * ret AS c FROM weights), b AS (SELECT 0 AS ticker, date, sum(c) AS ret FROM c GROUP BY date), v AS (SELECT *, {S.std('ret', 24, 12)} * sqrt(252) AS vol FROM b), l AS (SELECT *, {S.clip('(0.2 / nullif(vol, 0))', 0.5, 1.5)} AS lever FROM v) SELECT date, round(coalesce({S.lag('lever')}, 1), 6) + 0.0 AS value FROM l",
    ),
    "TK12_canary_orders": (
        lambda s, d: rounded(B.canary(_orders(s, d)), ["day", "seq", "verdict"], ["notional"]),
        "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq, o_totalprice / 500 AS notional FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY day, notional > 500 ORDER BY seq) AS k FROM o) SELECT day, seq, CASE WHEN notional > 500 THEN 'capped' WHEN k <= 5 THEN 'accepted' ELSE 'deferred' END AS verdict, round(notional, 6) + 0.0 AS notional FROM k",
    ),
    "TK13_query_fills": (
        lambda s, d: B.query_fills(tables.fills(s, d), side="SELL").select("fill_id", "order_id", "account"),
        f"WITH {FILLS} SELECT fill_id, order_id, account FROM fills WHERE side = 'SELL'",
    ),
    "G2_status_history": (
        lambda s, d: B.status_history(tables.fills(s, d), "order_id", "side", ["ts", "fill_id"]).select("order_id", "fill_id", "side", "before"),
        f"WITH {FILLS}, h AS (SELECT order_id, fill_id, side, lag(side) OVER (PARTITION BY order_id ORDER BY ts, fill_id) AS before FROM fills) SELECT * FROM h WHERE before IS DISTINCT FROM side",
    ),
    "G7_slippage_bps": (
        _slippage,
        f"WITH {FILLS}, e AS (SELECT account, avg(price) AS expected FROM fills GROUP BY 1) SELECT fill_id, round(CASE WHEN side = 'SELL' THEN -1 ELSE 1 END * (price - expected) / expected * 10000, 4) + 0.0 AS bps FROM fills JOIN e USING (account) WHERE expected <> 0 AND qty > 0 AND price > 0",
    ),
    "J14_common_dates": (
        _with_macro,
        f"WITH {S.DAILY}, m AS (SELECT date, avg(ret) AS ret FROM bars GROUP BY date HAVING avg(ret) IS NOT NULL), x AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), l AS (SELECT date, avg(v) AS level FROM x GROUP BY 1) SELECT date, round(ret, 6) + 0.0 AS ret, round(level, 6) + 0.0 AS level FROM m JOIN l USING (date)",
    ),
    "J16_blend_signals": (
        _blend,
        f"WITH {S.MONTHLY}, p AS (SELECT ticker, date, round({S.momentum('close', 3)}, 9) AS m, round(ret, 9) AS r FROM bars), a AS (SELECT ticker, date, {S.rank_pct('m')} AS x FROM p WHERE m IS NOT NULL), b AS (SELECT ticker, date, {S.rank_pct('r')} AS y FROM p WHERE r IS NOT NULL), j AS (SELECT ticker, date, round(0.7 * x + 0.3 * y, 9) AS z FROM a JOIN b USING (ticker, date)) SELECT ticker, date, round({S.rank_pct('z')}, 6) + 0.0 AS value FROM j",
    ),
    "J19_prior_book": (
        lambda s, d: rounded(B.prior_book(weights(s, d), F.lit("1996-01-01").cast("date")), TD, ["weight"], 9),
        f"WITH {S.MONTHLY}, {WEIGHTS} SELECT ticker, date, round(weight, 9) + 0.0 AS weight FROM weights WHERE date = (SELECT max(date) FROM weights WHERE date < DATE '1996-01-01')",
    ),
    "J20_trade_date": (
        _month_ends,
        f"WITH {CAL}, e AS (SELECT DISTINCT last_day(date) AS date FROM cal) SELECT e.date, coalesce(min(CASE WHEN c.date >= e.date THEN c.date END), max(CASE WHEN c.date < e.date THEN c.date END)) AS trade_date FROM e JOIN cal c ON c.date BETWEEN e.date - 5 AND e.date + 5 GROUP BY 1",
    ),
    "A14_split_tearsheet": (
        lambda s, d: rounded(B.split_tearsheet(daily(s, d), "1996-01-01"), ["strategy_id", "part", "n"], ["mean", "sd", "sharpe"]),
        f"WITH {S.DAILY}, {STRATEGIES}, g AS (SELECT strategy_id, CASE WHEN date >= DATE '1996-01-01' THEN 'out' ELSE 'in' END AS part, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM daily GROUP BY 1, 2 HAVING count(ret) >= 20) SELECT strategy_id, part, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(mean / nullif(sd, 0) * sqrt(252), 6) + 0.0 AS sharpe FROM g",
    ),
    "U_1_union_distinct": (lambda s, d: _ids(s, d, "customer", "c_custkey").union(_ids(s, d, "orders", "o_custkey")).distinct(), " UNION ".join(BOTH)),
    "U_4_intersection": (lambda s, d: _ids(s, d, "customer", "c_custkey").intersect(_ids(s, d, "orders", "o_custkey")), " INTERSECT ".join(BOTH)),
    "U_5_unmapped": (lambda s, d: _ids(s, d, "customer", "c_custkey").join(_ids(s, d, "orders", "o_custkey"), "id", "left_anti"), " EXCEPT ".join(BOTH)),
    "Z4_stacked_panels": (
        _stacked,
        f"WITH {S.MONTHLY}, u AS (SELECT ticker, date, 'close' AS field, close AS value FROM bars UNION ALL SELECT ticker, date, 'volume', volume FROM bars) SELECT ticker, date, field, round(value, 6) + 0.0 AS value FROM u WHERE value IS NOT NULL",
    ),
}

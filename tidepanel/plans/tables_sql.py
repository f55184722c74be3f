"""Queries of joins, cleaning, text, ledger, label and option operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import finance
from tidepanel.functions.columns import lag, mean, rolling, zscore
from tidepanel.operators import cleaning as C
from tidepanel.operators import joins as J
from tidepanel.operators import labels as L
from tidepanel.operators import options as O  # noqa: E741,N812
from tidepanel.operators import text as T
from tidepanel.plans import sql as S
from tidepanel.plans.cross import FILLS, WEIGHTS, rounded, weights
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
FACTS = """facts AS (SELECT (o_custkey % (SELECT count(*) FROM supplier)) + 1 AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS fact FROM orders GROUP BY 1, 2)"""
MACRO = "macro AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2)"


def facts(s: SparkSession, d: str) -> DataFrame:
    return tables.facts(s, d).groupBy("ticker", F.col("filed").alias("date")).agg(F.max("value").alias("fact"))


def macro(s: SparkSession, d: str) -> DataFrame:
    return tables.macro(s, d).select(F.col("series_id").alias("ticker"), "date", F.col("value").alias("x"))


def month_book(s: SparkSession, d: str, back: int) -> DataFrame:
    w = weights(s, d)
    month = w.select("date").distinct().orderBy(F.desc("date")).limit(back).agg(F.min("date").alias("date"))
    return w.join(F.broadcast(month), "date").select("date", "ticker", "weight")


BOOKS = WEIGHTS + ", d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM weights)), t AS (SELECT ticker, weight FROM weights JOIN d USING (date) WHERE k = 2), p AS (SELECT ticker, weight FROM weights JOIN d USING (date) WHERE k = 3)"


def _trades(s: SparkSession, d: str) -> DataFrame:
    return rounded(J.trades(month_book(s, d, 2), month_book(s, d, 3)), ["ticker", "side"], ["money"], 4)


def _drift(s: SparkSession, d: str) -> DataFrame:
    w = weights(s, d).select("date", "ticker", "weight")
    before = w.select(F.add_months("date", 1).alias("date"), "ticker", "weight")
    return rounded(J.drift_report(w, before), ["date", "names"], ["l1", "largest"])


def _nearest(s: SparkSession, d: str) -> DataFrame:
    out = J.nearest_event(tables.bars(s, d, True).select("ticker", "date"), facts(s, d).select("ticker", "date"))
    return out.select("ticker", "date", *[F.col(c).cast("long").alias(c) for c in ("to_next", "since_last", "signed")])


def _snap(s: SparkSession, d: str) -> DataFrame:
    calendar = tables.bars(s, d).select("date").distinct()
    return J.next_trading_day(facts(s, d).select("ticker", "date"), calendar)


def _wash(s: SparkSession, d: str) -> DataFrame:
    f = tables.fills(s, d).withColumn("ticker", F.col("fill_id") % 5)
    buys = f.filter("side = 'BUY'").select("account", "ticker", "ts", "fill_id")
    sells = f.filter("side = 'SELL'").select("account", "ticker", "ts", (F.lit(20.0) - F.col("price")).alias("loss"))
    return J.bought_near_loss(sells, buys).select("fill_id", "blocked")


def _merge(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True).select("ticker", "date", "close")
    new = b.filter(F.col("ticker") % 3 == 0).withColumn("close", F.col("close") + 1)
    return rounded(J.merge_latest(b, new, ["ticker", "date"]), ["ticker", "date"], ["close"], 8)


def _latest(s: SparkSession, d: str) -> DataFrame:
    return J.latest(tables.fills(s, d), "order_id", F.struct("ts", "fill_id").desc()).select("order_id", "fill_id", "side")


def _dense(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True)
    return rounded(C.densify(b.select("ticker", "date", "close", "volume"), b), ["ticker", "date"], ["close", "volume"])


def _labelled(s: SparkSession, d: str) -> DataFrame:
    ranges = s.createDataFrame([(0.0, 20.0, "small"), (20.0, 60.0, "middle"), (60.0, 120.0, "large")], "low double, high double, label string")
    b = tables.bars(s, d).select("ticker", "date", "volume")
    return C.ranges_to_label(b, "volume", ranges).select("ticker", "date", "label")


def calendar(s: SparkSession, d: str) -> DataFrame:
    return tables.bars(s, d).select("date").distinct()


CAL = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


def _costs(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d).withColumn("n", F.col("close") * 10).withColumn("adv", F.col("close") * F.col("volume") * 40)
    out = b.withColumn("tiered", finance.tiered_cost("n", "adv")).withColumn("liquid", finance.liquidity_cost("n", "adv"))
    return rounded(out, ["ticker", "date"], ["tiered", "liquid"], 9)


def _vols(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d).withColumn("v30", rolling(F.stddev_samp, "ret", 30)).withColumn("v60", rolling(F.stddev_samp, "ret", 60))
    out = b.withColumn("forward", finance.forward_volatility("v30", "v60", 30.0, 60.0)).withColumn("at45", finance.variance_time(F.lit(30.0), "v30", F.lit(60.0), "v60", 45.0))
    return rounded(out, ["ticker", "date"], ["forward", "at45"])


def filings(s: SparkSession, d: str) -> DataFrame:
    return tables.table(s, d, "documents").select(F.col("source").alias("ticker"), F.col("doc_id").alias("seq"), "text")


FILINGS = "filings AS (SELECT source AS ticker, doc_id AS seq, text FROM documents)"
WORDS = "regexp_extract_all(lower(text), '[a-z'']+')"
TONE = [("the", "positive"), ("and", "positive"), ("of", "negative"), ("er", "negative"), ("in", "uncertainty"), ("de", "uncertainty")]


def _tone(s: SparkSession, d: str) -> DataFrame:
    out = T.tone(filings(s, d), s.createDataFrame(TONE, "word string, category string"))
    return rounded(out, ["ticker", "seq", "n_words"], ["positive", "negative", "uncertainty", "net"])


def chain(s: SparkSession, d: str) -> DataFrame:
    """Line items read as quotes: supplier and month, line number as expiry, discount and tax as volatility and delta."""
    i = tables.table(s, d, "lineitem")
    return i.select(
        F.trunc("l_shipdate", "month").alias("date"), F.col("l_suppkey").alias("ticker"), (F.col("l_linenumber") * 15).cast("int").alias("dte"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("strike"),
        F.when(F.col("l_returnflag") == "N", "c").otherwise("p").alias("kind"), F.round(F.pmod(F.col("l_partkey"), F.lit(19)) * 0.05 + 0.05, 2).alias("delta"), F.round(F.col("l_discount") + F.col("l_tax") + 0.1, 4).alias("iv"),
        F.round(F.col("l_extendedprice") / 1000, 8).alias("mid"), F.col("l_quantity").cast("long").alias("volume"), F.col("l_quantity").cast("long").alias("oi"),
    )


CHAIN = """chain AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey AS ticker, l_linenumber * 15 AS dte, round(l_extendedprice / l_quantity, 8) AS strike, CASE WHEN l_returnflag = 'N' THEN 'c' ELSE 'p' END AS kind,
round((l_partkey % 19) * 0.05 + 0.05, 2) AS delta, round(l_discount + l_tax + 0.1, 4) AS iv, round(l_extendedprice / 1000, 8) AS mid, CAST(l_quantity AS BIGINT) AS volume, CAST(l_quantity AS BIGINT) AS oi FROM lineitem)"""


def on_chain(op: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str], places: int = 6) -> Query:
    return lambda s, d: rounded(op(chain(s, d)), keys, values, places)


def _macro_z(s: SparkSession, d: str) -> DataFrame:
    m = macro(s, d).withColumn("mu", mean("x", 60)).withColumn("sd", rolling(F.stddev_samp, "x", 60))
    z = F.when(F.col("sd") > 0, F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col("x") - F.col("mu")) / F.col("sd"))))
    return rounded(m.withColumn("value", z), ["ticker", "date"], ["value"])


def _labels(s: SparkSession, d: str) -> DataFrame:
    return L.graded_labels(tables.bars(s, d)).select("ticker", "date", F.col("value").cast("long").alias("value"))


def _turnover(s: SparkSession, d: str) -> DataFrame:
    w = weights(s, d)
    per = w.withColumn("c", F.abs(F.col("weight") - F.coalesce(lag("weight"), F.lit(0.0)))).groupBy("date").agg((F.sum("c") / 2).alias("value"))
    return rounded(per, ["date"], ["value"])


def _portfolio(s: SparkSession, d: str) -> DataFrame:
    out = weights(s, d).withColumn("c", lag("weight") * F.col("ret")).groupBy("date").agg(F.sum("c").alias("value"))
    return rounded(out, ["date"], ["value"])


def _sector_z(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True).join(tables.sectors(s, d), "ticker")
    return rounded(b.withColumn("value", zscore(F.round("ret", 9), 3.0, ["date", "sector"])), ["ticker", "date"], ["value"])


TABLE: dict[str, tuple[Query, str]] = {
    "J1_as_of": (
        lambda s, d: rounded(J.as_of(tables.bars(s, d).select("ticker", "date"), facts(s, d), "fact", 45), ["ticker", "date"], ["fact"]),
        f"WITH {S.DAILY}, {FACTS}, e AS (SELECT ticker, date + 45 AS date, fact FROM facts) SELECT b.ticker, b.date, round(e.fact, 6) + 0.0 AS fact FROM bars b ASOF LEFT JOIN e ON b.ticker = e.ticker AND b.date >= e.date",
    ),
    "J3_next_trading_day": (_snap, f"WITH {CAL}, {FACTS} SELECT f.ticker, f.date, c.date AS trade_date FROM facts f ASOF LEFT JOIN cal c ON f.date <= c.date"),
    "J10_trades": (
        _trades,
        f"WITH {S.MONTHLY}, {BOOKS}, x AS (SELECT coalesce(t.ticker, p.ticker) AS ticker, (coalesce(t.weight, 0) - coalesce(p.weight, 0)) * 100000 AS delta FROM t FULL JOIN p ON t.ticker = p.ticker) SELECT ticker, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(delta), 4) + 0.0 AS money FROM x WHERE abs(delta) >= 50",
    ),
    "J11_drift": (
        _drift,
        f"WITH {S.MONTHLY}, {WEIGHTS}, b AS (SELECT CAST(date + INTERVAL 1 MONTH AS DATE) AS date, ticker, weight FROM weights), x AS (SELECT coalesce(w.date, b.date) AS date, coalesce(b.weight, 0) - coalesce(w.weight, 0) AS dr FROM weights w FULL JOIN b ON w.date = b.date AND w.ticker = b.ticker), y AS (SELECT date, count(*) AS names, sum(abs(dr)) AS l1, max(abs(dr)) AS largest FROM x GROUP BY date) SELECT date, names, {S.rounded('l1', 'largest')} FROM y",
    ),
    "J12_nearest_event": (
        _nearest,
        f"WITH {S.MONTHLY}, {FACTS}, n AS (SELECT b.ticker, b.date, f.date - b.date AS to_next FROM bars b ASOF LEFT JOIN facts f ON b.ticker = f.ticker AND b.date < f.date), l AS (SELECT b.ticker, b.date, b.date - f.date AS since_last FROM bars b ASOF LEFT JOIN facts f ON b.ticker = f.ticker AND b.date >= f.date) SELECT ticker, date, to_next, since_last, CASE WHEN to_next IS NULL OR since_last <= to_next THEN -since_last ELSE to_next END AS signed FROM n JOIN l USING (ticker, date)",
    ),
    "K2_merge_latest": (_merge, f"WITH {S.MONTHLY} SELECT ticker, date, round(close + CASE WHEN ticker % 3 = 0 THEN 1 ELSE 0 END, 8) + 0.0 AS close FROM bars"),
    "G1_latest_version": (_latest, f"WITH {FILLS}, k AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, fill_id DESC) AS k FROM fills) SELECT order_id, fill_id, side FROM k WHERE k = 1"),
    "G12_wash_sale": (
        _wash,
        f"WITH {FILLS}, f AS (SELECT *, fill_id % 5 AS ticker FROM fills) SELECT b.fill_id, EXISTS (SELECT 1 FROM f s WHERE s.side = 'SELL' AND 20 - s.price > 0 AND s.account = b.account AND s.ticker = b.ticker AND s.ts <= b.ts AND b.ts < s.ts + INTERVAL 31 DAY) AS blocked FROM f b WHERE b.side = 'BUY'",
    ),
    "G17_turnover": (_turnover, f"WITH {S.MONTHLY}, {WEIGHTS}, c AS (SELECT date, abs(weight - coalesce({S.lag('weight')}, 0)) AS c FROM weights) SELECT date, round(sum(c) / 2, 6) + 0.0 AS value FROM c GROUP BY date"),
    "G19_portfolio_return": (_portfolio, f"WITH {S.MONTHLY}, {WEIGHTS}, c AS (SELECT date, {S.lag('weight')} * ret AS c FROM weights) SELECT date, round(sum(c), 6) + 0.0 AS value FROM c GROUP BY date"),
    "C6_adjust": (
        lambda s, d: rounded(C.adjust(tables.bars(s, d).withColumn("adj", F.when(F.col("volume") > 50, F.col("close") * 0.9).otherwise(0.0)), "adj"), ["ticker", "date"], ["factor", "high", "low"], 8),
        f"WITH {S.DAILY}, a AS (SELECT *, coalesce(nullif(CASE WHEN volume > 50 THEN close * 0.9 ELSE 0 END, 0) / nullif(close, 0), 1) AS factor FROM bars) SELECT ticker, date, round(factor, 8) + 0.0 AS factor, round(high * factor, 8) + 0.0 AS high, round(low * factor, 8) + 0.0 AS low FROM a",
    ),
    "C7_densify": (
        _dense,
        f"WITH {S.MONTHLY}, life AS (SELECT ticker, min(date) AS f, max(date) AS t FROM bars GROUP BY ticker), days AS (SELECT DISTINCT date FROM bars), grid AS (SELECT ticker, date FROM life JOIN days ON date BETWEEN f AND t) SELECT g.ticker, g.date, round(last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS close, round(coalesce(b.volume, 0), 6) + 0.0 AS volume FROM grid g LEFT JOIN bars b ON g.ticker = b.ticker AND g.date = b.date",
    ),
    "C8_quality_drop": (
        lambda s, d: rounded(C.quality_drop(tables.bars(s, d), 520, 950.0, 0.22), ["ticker", "date"], ["close"], 8),
        f"WITH {S.DAILY}, x AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(close) < 520 OR avg(CASE WHEN close <= 950 THEN 1.0 ELSE 0.0 END) > 0.22) SELECT ticker, date, round(close, 8) + 0.0 AS close FROM bars WHERE ticker NOT IN (SELECT ticker FROM x)",
    ),
    "C9_sentinel_drop": (
        lambda s, d: rounded(C.sentinel_drop(tables.bars(s, d), 97000.0, 500.0), ["ticker", "date"], ["close"], 8),
        f"WITH {S.DAILY}, m AS (SELECT *, abs(close / {S.lag('close')} - 1) AS m FROM bars), x AS (SELECT ticker FROM m GROUP BY ticker HAVING max(close) > 97000 OR max(m) > 500) SELECT ticker, date, round(close, 8) + 0.0 AS close FROM bars WHERE ticker NOT IN (SELECT ticker FROM x)",
    ),
    "C12_coverage_gate": (
        lambda s, d: rounded(C.coverage_gate(tables.bars(s, d).withColumn("x", F.when(F.col("volume") > 30, F.col("close"))), "x", 0.4), ["ticker", "date"], ["value"], 8),
        S.query({"x": "CASE WHEN volume > 30 THEN close END"}, {"value": "CASE WHEN avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY ticker) >= 0.4 THEN x END"}, final="SELECT ticker, date, round(value, 8) + 0.0 AS value FROM {at}"),
    ),
    "C2_clean_symbol": (
        lambda s, d: tables.table(s, d, "supplier").select("s_suppkey", C.clean_symbol("s_name").alias("symbol")),
        "SELECT s_suppkey, regexp_replace(upper(trim(s_name)), '[^A-Z0-9]+', '-', 'g') AS symbol FROM supplier",
    ),
    "C14_range_labels": (_labelled, f"WITH {S.DAILY} SELECT ticker, date, CASE WHEN volume >= 0 AND volume < 20 THEN 'small' WHEN volume >= 20 AND volume < 60 THEN 'middle' WHEN volume >= 60 AND volume < 120 THEN 'large' ELSE 'Unknown' END AS label FROM bars"),
    "C17_settlement_dates": (
        lambda s, d: C.settlement_dates(calendar(s, d)),
        f"WITH {CAL}, m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM cal), x AS (SELECT m + 14 AS d FROM m UNION ALL SELECT last_day(m) FROM m) SELECT d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS date FROM x",
    ),
    "C19_rebalance_dates": (
        lambda s, d: C.rebalance_dates(calendar(s, d)),
        f"WITH {CAL}, k AS (SELECT date, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS k, count(*) OVER (PARTITION BY date_trunc('month', date)) AS n FROM cal) SELECT date FROM k WHERE k = least(3, n)",
    ),
    "C22_business_days": (
        lambda s, d: calendar(s, d).select("date", C.add_business_days("date", 8).alias("later_date")),
        f"WITH {CAL} SELECT date, list_filter(list_transform(range(1, 23), lambda k: date + CAST(k AS INTEGER)), lambda v: isodow(v) < 6)[8] AS later_date FROM cal",
    ),
    "P6_forward_volatility": (
        _vols,
        S.query(
            {"a": S.std("ret", 30), "b": S.std("ret", 60)},
            {"fv": "(b * b * 60 - a * a * 30) / 30", "tv": "a * a * 30 + 0.5 * (b * b * 60 - a * a * 30)"},
            {"forward": "CASE WHEN fv >= 0 THEN sqrt(fv) END", "at45": "CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN tv >= 0 THEN sqrt(tv / 45) END"},
            final="SELECT ticker, date, " + S.rounded("forward", "at45") + " FROM {at}",
        ),
    ),
    "P18_trade_costs": (
        _costs,
        S.query(
            {"n": "close * 10", "adv": "close * volume * 40"},
            {"tiered": "abs(n) * (CASE WHEN adv IS NULL OR adv <= 0 THEN 8 WHEN adv >= 20e6 THEN 1 WHEN adv >= 5e6 THEN 3 WHEN adv >= 1e6 THEN 8 ELSE 20 END + 0.2) / 10000", "liquid": "abs(n) * greatest(1, least(50, 50 / sqrt(greatest(adv / 1e6, 1e-6)))) / 10000"},
            final="SELECT ticker, date, round(tiered, 9) + 0.0 AS tiered, round(liquid, 9) + 0.0 AS liquid FROM {at}",
        ),
    ),
    "P21_html_to_text": (
        lambda s, d: tables.table(s, d, "pages").select("page_id", T.html_to_text("html").alias("text")),
        r"SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages",
    ),
    "P24_tokens": (
        lambda s, d: filings(s, d).select("seq", F.size(T.words("text")).cast("long").alias("n_words"), F.size(F.array_distinct(T.words("text"))).cast("long").alias("n_distinct")),
        f"WITH {FILINGS}, w AS (SELECT seq, {WORDS} AS w FROM filings) SELECT seq, len(w) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM w",
    ),
    "T2_similarity_to_prior": (
        lambda s, d: rounded(T.similarity_to_prior(filings(s, d)), ["ticker", "seq"], ["value"]),
        f"WITH {FILINGS}, w AS (SELECT ticker, seq, list_distinct({WORDS}) AS w FROM filings WHERE length(text) >= 100), p AS (SELECT *, lag(w) OVER (PARTITION BY ticker ORDER BY seq) AS p FROM w), x AS (SELECT ticker, seq, len(list_intersect(w, p)) AS i, len(w) AS a, len(p) AS b FROM p) SELECT ticker, seq, round(i / nullif(a + b - i, 0), 6) + 0.0 AS value FROM x",
    ),
    "T1_tfidf_cosine": (
        lambda s, d: rounded(T.tfidf_cosine(filings(s, d)), ["ticker", "seq"], ["value"]),
        f"""WITH {FILINGS}, u AS (SELECT ticker, seq, text AS t, lag(text) OVER (PARTITION BY ticker ORDER BY seq) AS pr FROM filings WHERE length(text) >= 100),
b AS (SELECT ticker, seq, 0 AS side, t AS text FROM u WHERE pr IS NOT NULL UNION ALL SELECT ticker, seq, 1, pr FROM u WHERE pr IS NOT NULL), w AS (SELECT ticker, seq, side, unnest({WORDS}) AS word FROM b),
c AS (SELECT ticker, seq, word, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM w GROUP BY 1, 2, 3), i AS (SELECT *, ln(3.0 / (1 + CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END)) + 1 AS idf FROM c)
SELECT ticker, seq, round(sum(a * b * idf * idf) / nullif(sqrt(sum(pow(a * idf, 2))) * sqrt(sum(pow(b * idf, 2))), 0), 6) + 0.0 AS value FROM i GROUP BY 1, 2""",
    ),
    "T5_tone": (
        _tone,
        f"""WITH {FILINGS}, dict(word, category) AS (VALUES """ + ", ".join(f"('{w}', '{c}')" for w, c in TONE) + f"""), w AS (SELECT ticker, seq, unnest({WORDS}) AS word FROM filings),
g AS (SELECT ticker, seq, count(*) AS n_words, count(*) FILTER (category = 'positive') AS p, count(*) FILTER (category = 'negative') AS n, count(*) FILTER (category = 'uncertainty') AS u FROM w LEFT JOIN dict USING (word) GROUP BY 1, 2),
r AS (SELECT ticker, seq, n_words, CASE WHEN n_words >= 100 THEN p / n_words END AS positive, CASE WHEN n_words >= 100 THEN n / n_words END AS negative, CASE WHEN n_words >= 100 THEN u / n_words END AS uncertainty FROM g), z AS (SELECT *, positive - negative AS net FROM r)
SELECT ticker, seq, n_words, {S.rounded('positive', 'negative', 'uncertainty', 'net')} FROM z""",
    ),
    "L1_graded_labels": (
        _labels,
        S.query(
            {"f": f"CASE WHEN count(ret) OVER ({S.ORDER} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN round(sum(ret) OVER ({S.ORDER} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 9) END"},
            {"r": S.rank_pct("f")},
            {"value": "CASE WHEN r IS NOT NULL THEN " + " + ".join(f"CASE WHEN r > {g} THEN 1 ELSE 0 END" for g in L.GRADES) + " END"},
            final="SELECT ticker, date, CAST(value AS BIGINT) AS value FROM {at}",
        ),
    ),
    "L3_folds": (
        lambda s, d: L.folds(calendar(s, d), 504, 63, 5).select(F.col("fold").cast("long").alias("fold"), "train_from", "train_to", "test_from", "test_to").withColumnsRenamed({c: f"{c}_date" for c in ("train_from", "train_to", "test_from", "test_to")}),
        f"WITH {CAL}, k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM cal), m AS (SELECT max(k) AS m FROM k), s AS (SELECT unnest(range(509, m + 1, 63)) AS s, m FROM m) SELECT (s - 509) // 63 AS fold, (SELECT date FROM k WHERE k = s - 509) AS train_from_date, (SELECT date FROM k WHERE k = s - 6) AS train_to_date, (SELECT date FROM k WHERE k = s) AS test_from_date, (SELECT date FROM k WHERE k = least(s + 62, m)) AS test_to_date FROM s",
    ),
    "L4_uniqueness": (
        lambda s, d: rounded(L.uniqueness(tables.bars(s, d).select("date")), ["date"], ["value"]),
        f"WITH {S.DAILY}, p AS (SELECT date, count(*) AS n FROM bars GROUP BY date), c AS (SELECT date, sum(n) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM p) SELECT date, round(avg(1.0 / c) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) + 0.0 AS value FROM c",
    ),
    "M1_macro_zscore": (
        _macro_z,
        f"WITH {MACRO}, a AS (SELECT *, {S.avg('x', 60)} AS mu, {S.std('x', 60)} AS sd FROM macro) SELECT ticker, date, round(CASE WHEN sd > 0 THEN greatest(-4, least(4, (x - mu) / sd)) END, 6) + 0.0 AS value FROM a",
    ),
    "R3_sector_zscore": (
        _sector_z,
        f"WITH {S.MONTHLY}, {S.SECTORS}, b AS (SELECT ticker, date, sector, round(ret, 9) AS r FROM bars JOIN sectors USING (ticker)) SELECT ticker, date, round({S.zscore('r', 3.0, 'date, sector')}, 6) + 0.0 AS value FROM b",
    ),
    "A23_option_totals": (
        on_chain(O.volume_totals, ["ticker", "date", "call_volume", "put_volume", "call_oi", "put_oi"], []),
        f"WITH {CHAIN} SELECT ticker, date, " + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN {x} ELSE 0 END) AS BIGINT) AS {n}" for n, k, x in (("call_volume", "c", "volume"), ("put_volume", "p", "volume"), ("call_oi", "c", "oi"), ("put_oi", "p", "oi"))) + " FROM chain GROUP BY 1, 2",
    ),
    "P10_quality_filter": (on_chain(lambda c: O.quality_filter(c).groupBy("ticker", "date").agg(F.count("*").alias("n")), ["ticker", "date", "n"], []), f"WITH {CHAIN} SELECT ticker, date, count(*) AS n FROM chain WHERE oi >= 10 AND iv > 0 AND iv < 5 GROUP BY 1, 2"),
    "O22_bracket_expiries": (
        on_chain(lambda c: O.bracket_expiries(c).withColumns({k: F.col(k).cast("long") for k in ("near", "far")}), ["ticker", "date", "near", "far"], []),
        f"WITH {CHAIN} SELECT ticker, date, CAST(max(CASE WHEN dte <= 30 THEN dte END) AS BIGINT) AS near, CAST(min(CASE WHEN dte >= 30 THEN dte END) AS BIGINT) AS far FROM chain GROUP BY 1, 2",
    ),
    "O23_smile_fit": (
        on_chain(lambda c: O.smile_fit(c).filter("n >= 4 and slope is not null").withColumn("dte", F.col("dte").cast("long")), ["ticker", "date", "dte", "n"], ["slope", "level"], 8),
        f"WITH {CHAIN}, f AS (SELECT ticker, date, CAST(dte AS BIGINT) AS dte, count(*) AS n, regr_slope(iv, delta) AS slope, regr_intercept(iv, delta) AS level FROM chain GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND isfinite(regr_slope(iv, delta))) SELECT ticker, date, dte, n, round(slope, 8) + 0.0 AS slope, round(level, 8) + 0.0 AS level FROM f",
    ),
    "O24_delta_bucket": (
        on_chain(lambda c: O.delta_bucket(c, 0.25).withColumn("dte", F.col("dte").cast("long")), ["ticker", "date", "dte"], ["value"]),
        f"WITH {CHAIN}, a AS (SELECT ticker, date, dte, arg_min(delta, {{'d': -delta, 'v': iv}}) FILTER (delta <= 0.25) AS d0, arg_min(iv, {{'d': -delta, 'v': iv}}) FILTER (delta <= 0.25) AS v0, arg_min(delta, {{'d': delta, 'v': iv}}) FILTER (delta >= 0.25) AS d1, arg_min(iv, {{'d': delta, 'v': iv}}) FILTER (delta >= 0.25) AS v1 FROM chain GROUP BY 1, 2, 3) SELECT ticker, date, CAST(dte AS BIGINT) AS dte, round(v0 + coalesce((0.25 - d0) / nullif(d1 - d0, 0), 0) * (v1 - v0), 6) + 0.0 AS value FROM a",
    ),
    "O36_atm_volatility": (
        on_chain(lambda c: O.atm_volatility(c).withColumn("dte", F.col("dte").cast("long")), ["ticker", "date", "dte"], ["value"]),
        f"WITH {CHAIN}, a AS (SELECT ticker, date, dte, kind, arg_min(iv, {{'a': round(abs(delta - 0.5), 4), 's': strike, 'v': iv}}) AS iv FROM chain GROUP BY 1, 2, 3, 4) SELECT ticker, date, CAST(dte AS BIGINT) AS dte, round(avg(iv), 6) + 0.0 AS value FROM a GROUP BY 1, 2, 3",
    ),
    "O29_trapezoid_variance": (
        on_chain(lambda c: O.trapezoid_variance(c).withColumn("dte", F.col("dte").cast("long")), ["ticker", "date", "dte", "n"], ["value"]),
        f"WITH {CHAIN}, o AS (SELECT ticker, date, dte, strike, avg(mid) AS mid FROM chain GROUP BY 1, 2, 3, 4), s AS (SELECT *, avg(strike) OVER (PARTITION BY ticker, date, dte) AS s FROM o), f AS (SELECT *, 2 * (1 - ln(strike / s)) / (strike * strike) * mid AS f FROM s), a AS (SELECT *, (f + lag(f) OVER w) / 2 * (strike - lag(strike) OVER w) AS a FROM f WINDOW w AS (PARTITION BY ticker, date, dte ORDER BY strike)) SELECT ticker, date, CAST(dte AS BIGINT) AS dte, count(*) AS n, round(sum(a), 6) + 0.0 AS value FROM a GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    ),
}

"""Queries of put-call parity and of filings' items, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators import parity as P
from tidepanel.operators import text as T
from tidepanel.plans.cross import rounded
from tidepanel.sources import tables

DAY = ["date", "ticker"]
KNOTS = {"1-URGENT": 30, "2-HIGH": 60, "3-MEDIUM": 90}


def quotes(s: SparkSession, d: str) -> DataFrame:
    """Line items of every tenth supplier together as quotes: month, line number as expiry, strikes on a grid of 200."""
    i = tables.table(s, d, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return i.select(F.trunc("l_shipdate", "month").alias("date"), (F.col("l_suppkey") % 10).alias("ticker"), (F.col("l_linenumber") * 15).cast("int").alias("dte"), (F.floor(unit / 200) * 200.0).alias("strike"), F.when(F.col("l_returnflag") == "N", "c").otherwise("p").alias("kind"), (F.col("l_quantity") * 4).alias("mid"), unit.alias("unit"))


def spots(s: SparkSession, d: str) -> DataFrame:
    return quotes(s, d).groupBy(*DAY).agg(F.avg("unit").alias("spot"))


def curves(s: SparkSession, d: str) -> DataFrame:
    knot = F.create_map(*[x for k, v in KNOTS.items() for x in (F.lit(k), F.lit(v))])
    o = tables.table(s, d, "orders")
    whole = o.groupBy(F.trunc("o_orderdate", "month").alias("date"), knot[F.col("o_orderpriority")].alias("dte")).agg((F.avg("o_totalprice") / 4e6).alias("rate")).filter("dte is not null")
    return whole.withColumn("n", F.count("*").over(Window.partitionBy("date"))).filter("n = 3").drop("n")


def payments(s: SparkSession, d: str) -> DataFrame:
    i = tables.table(s, d, "lineitem")
    return i.select((F.col("l_suppkey") % 10).alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_tax") * 10).alias("amount"))


PAIRS = """q AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey % 10 AS ticker, l_linenumber * 15 AS dte, floor(l_extendedprice / l_quantity / 200) * 200 AS strike, l_returnflag = 'N' AS is_call, l_quantity * 4 AS mid, l_extendedprice / l_quantity AS unit FROM lineitem),
s AS (SELECT date, ticker, avg(unit) AS spot FROM q GROUP BY 1, 2),
c AS (SELECT date, ticker, dte, strike, avg(mid) AS call FROM q WHERE is_call AND mid > 0 GROUP BY ALL), p AS (SELECT date, ticker, dte, strike, avg(mid) AS put FROM q WHERE NOT is_call AND mid > 0 GROUP BY ALL),
pairs AS (SELECT * FROM c JOIN p USING (date, ticker, dte, strike) JOIN s USING (date, ticker) WHERE abs(strike / spot - 1) <= 0.5)"""
IMPLIED = f"""{PAIRS}, k AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 4e6 AS r30, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 4e6 AS r60, avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') / 4e6 AS r90 FROM orders GROUP BY 1 HAVING r30 + r60 + r90 IS NOT NULL),
x AS (SELECT p.*, coalesce(CASE WHEN dte <= 30 THEN r30 WHEN dte >= 90 THEN r90 WHEN dte <= 60 THEN r30 + (r60 - r30) * (dte - 30) / 30 ELSE r60 + (r90 - r60) * (dte - 60) / 30 END, 0) AS r FROM pairs p LEFT JOIN k USING (date)),
v AS (SELECT date, ticker, dte, (spot * exp(r * dte / 365) - strike - (call - put) * exp(r * dte / 365)) * 365 / dte AS v FROM x WHERE dte BETWEEN 30 AND 180),
b AS (SELECT *, count(*) FILTER (dte >= 60) OVER (PARTITION BY date, ticker) AS n60 FROM v), u AS (SELECT * FROM b WHERE n60 < 2 OR dte >= 60),
z AS (SELECT date, ticker, count(*) AS pairs, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM u GROUP BY 1, 2),
implied AS (SELECT p.date, p.ticker, coalesce(any_value(z.pairs), 0) AS pairs, CASE WHEN any_value(z.pairs) >= 2 THEN avg(greatest(0, greatest(lo, least(hi, v)))) END AS value FROM (SELECT DISTINCT date, ticker FROM pairs) p LEFT JOIN u USING (date, ticker) LEFT JOIN z USING (date, ticker) GROUP BY 1, 2)"""


def pairs(s: SparkSession, d: str) -> DataFrame:
    return P.call_put_pairs(quotes(s, d), spots(s, d), 0.5)


def implied(s: SparkSession, d: str) -> DataFrame:
    return P.implied_dividend(pairs(s, d), curves(s, d), least_dte=60, least_pairs=2)


def o34(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.dividend_surprise(implied(s, d), payments(s, d)), DAY, ["value", "paid", "surprise", "rank"])


def filings(s: SparkSession, d: str) -> DataFrame:
    """Pages as filings: each paragraph starts an item 1A, each section and division an item 7, each heading an item 2."""
    html = F.col("html")
    for tag, item in (("p", "1A"), ("h[1-6]", "2"), ("(?:section|div|article)", "7")):
        html = F.regexp_replace(html, rf"(?i)<{tag}\b", rf" Item {item}. $0")
    return tables.table(s, d, "pages").select("page_id", T.html_to_text(html).alias("text"))


def p22(s: SparkSession, d: str) -> DataFrame:
    return T.extract_items(filings(s, d), ["1A", "2", "7", "9"]).select("page_id", "item_1a", "item_2", "item_7", "item_9")


def _item(x: str, higher: str) -> str:
    """Pieces from the last one of an item up to the first later one of a higher item."""
    return f"""SELECT page_id, trim(string_agg(piece, '' ORDER BY k)) AS t FROM (SELECT page_id, piece, k, first_k, min(CASE WHEN k > first_k AND {higher} THEN k END) OVER (PARTITION BY page_id) AS stop FROM (SELECT *, max(CASE WHEN item = '{x}' THEN k END) OVER (PARTITION BY page_id) AS first_k FROM pieces))
WHERE k >= first_k AND (stop IS NULL OR k < stop) GROUP BY 1"""


HIGHER_1A, HIGHER_2 = "item IN ('2', '7')", "item = '7'"
TABLE = {
    "J5_call_put_pairs": (lambda s, d: rounded(pairs(s, d), [*DAY, "dte"], ["strike", "spot", "call", "put"]), f"WITH {PAIRS} SELECT date, ticker, CAST(dte AS INT) AS dte, round(strike, 6) + 0.0 AS strike, round(spot, 6) + 0.0 AS spot, round(call, 6) + 0.0 AS call, round(put, 6) + 0.0 AS put FROM pairs"),
    "O32_implied_dividend": (lambda s, d: rounded(implied(s, d), [*DAY, "pairs"], ["value"], 5), f"WITH {IMPLIED} SELECT date, ticker, pairs, round(value, 5) + 0.0 AS value FROM implied"),
    "O34_dividend_surprise": (
        o34,
        f"""WITH {IMPLIED}, y AS (SELECT i.date, i.ticker, i.value, coalesce(sum(l_tax * 10), 0) AS paid FROM implied i LEFT JOIN lineitem l ON l_suppkey % 10 = i.ticker AND CAST(l_shipdate AS DATE) <= i.date AND CAST(l_shipdate AS DATE) > i.date - 365 GROUP BY 1, 2, 3),
w AS (SELECT *, value - paid AS surprise, round(value - paid, 9) AS x FROM y), r AS (SELECT *, CASE WHEN x IS NOT NULL THEN (rank() OVER (PARTITION BY date, x IS NULL ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(x) OVER (PARTITION BY date) END AS rank FROM w)
SELECT date, ticker, round(value, 6) + 0.0 AS value, round(paid, 6) + 0.0 AS paid, round(surprise, 6) + 0.0 AS surprise, round(rank, 6) + 0.0 AS rank FROM r""",
    ),
    "P22_items": (
        p22,
        r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<p\b', ' Item 1A. \0', 'g'), '(?i)<h[1-6]\b', ' Item 2. \0', 'g'), '(?i)<(?:section|div|article)\b', ' Item 7. \0', 'g') AS html FROM pages),
t AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM h),
a AS (SELECT page_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '(?i)\bitem\s+(\d+[a-z]?)\b[.:\s]', chr(1) || '\0', 'g'), chr(1)) AS p FROM t),
pieces AS (SELECT page_id, piece, k, CASE WHEN k > 1 THEN upper(regexp_extract(piece, '(?i)\bitem\s+(\d+[a-z]?)\b[.:\s]', 1)) ELSE '' END AS item FROM (SELECT page_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS k FROM a)),
"""
        + f"i1 AS ({_item('1A', HIGHER_1A)}), i2 AS ({_item('2', HIGHER_2)}), i7 AS ({_item('7', 'false')}) "
        + "SELECT page_id, coalesce(i1.t, '') AS item_1a, coalesce(i2.t, '') AS item_2, coalesce(i7.t, '') AS item_7, '' AS item_9 FROM t LEFT JOIN i1 USING (page_id) LEFT JOIN i2 USING (page_id) LEFT JOIN i7 USING (page_id)",
    ),
}

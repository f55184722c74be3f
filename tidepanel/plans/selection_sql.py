"""Queries from scores to books, and the SQL that checks them; the greedy choice walks the candidates one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import rank_pct
from tidepanel.operators import selection as K
from tidepanel.plans import sql as S
from tidepanel.plans.cross import PANEL, panel, rounded
from tidepanel.sources import tables

N, POOL, MOST, BACK = 8, 16, 0.3, 24
RULES = dict(quality="quality", first_date="first_date", earnings="earnings", traded="traded", pool=70, least_traded=1_000_000.0, vol="vol", most_vol=0.9)


def scored(s: SparkSession, d: str) -> DataFrame:
    """Monthly bars with momentum as score, ranks of low and closing price as quality and nearness to earnings, and money traded."""
    b = panel(s, d).withColumn("score", F.col("mom")).withColumn("first_date", F.min("date").over(Window.partitionBy("ticker"))).withColumn("traded", F.round(F.col("volume") * F.col("close"), 4))
    return b.withColumn("_l", F.round("low", 6)).withColumn("_c", F.round("close", 6)).withColumn("quality", rank_pct("_l")).withColumn("earnings", rank_pct("_c")).drop("_l", "_c")


SCORED = f"""WITH RECURSIVE {S.MONTHLY}, {PANEL}, s0 AS (SELECT *, mom AS score, min(date) OVER (PARTITION BY ticker) AS first_date, round(volume * close, 4) AS traded, round(low, 6) AS lo, round(close, 6) AS cl FROM panel),
scored AS (SELECT * EXCLUDE (lo, cl), {S.rank_pct('lo')} AS quality, {S.rank_pct('cl')} AS earnings FROM s0)"""


def _funnel() -> str:
    place = "(rank() OVER (PARTITION BY date, dropped IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY date, dropped IS NULL, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date, dropped IS NULL)"
    known = "dropped IS NULL AND traded IS NOT NULL"
    ctes = ["k0 AS (SELECT *, CASE WHEN score IS NULL OR count(score) OVER (PARTITION BY date) < 16 THEN 0 END AS dropped FROM scored)"]
    steps = [
        (f"{place} > 0.2", 24), ("quality > 0.5", 24), ("first_date <= date - 270", 24), (f"NOT coalesce(earnings >= 0.9, false) OR {place} >= 0.99", 24),
        (f"count(*) FILTER ({known}) OVER (PARTITION BY date) <= 70 OR ({known} AND row_number() OVER (PARTITION BY date, {known} ORDER BY traded DESC, ticker) <= 70)", 16), ("traded >= 1000000", 16), ("vol <= 0.9", 16),
    ]
    for k, (x, need) in enumerate(steps, 1):
        ctes.append(f"o{k} AS (SELECT *, dropped IS NULL AND coalesce({x}, false) AS ok FROM k{k - 1})")
        ctes.append(f"k{k} AS (SELECT * EXCLUDE (dropped, ok), CASE WHEN dropped IS NULL AND NOT ok AND count(*) FILTER (ok) OVER (PARTITION BY date) >= {need} THEN {k} ELSE dropped END AS dropped FROM o{k})")
    return ", ".join(ctes)


FUNNEL = f"{SCORED}, {_funnel()}"


def greedy(source: str) -> str:
    """Steps over ``source(date, ticker, place)`` and the monthly returns, ending in ``chosen(date, ticker, picked)``."""
    return f"""days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
cand AS (SELECT c.date, c.ticker, c.place, i < {BACK} AS early, i FROM {source} c JOIN days USING (date) WHERE c.place <= {POOL}),
win AS (SELECT c.date, c.ticker, c.place, d.i AS row, b.ret FROM cand c JOIN days d ON NOT c.early AND d.i BETWEEN c.i - {BACK} AND c.i - 1 JOIN bars b ON b.ticker = c.ticker AND b.date = d.date),
bad AS (SELECT date, t, list(u) AS us FROM (SELECT a.date, a.ticker AS t, b.ticker AS u FROM win a JOIN win b ON a.date = b.date AND a.row = b.row AND b.place < a.place WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1 AND stddev_pop(a.ret) > 0 AND stddev_pop(b.ret) > 0 AND abs(corr(a.ret, b.ret)) > {MOST}) GROUP BY 1, 2),
walk AS (SELECT DISTINCT date, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS sel FROM cand
    UNION ALL SELECT w.date, c.place, CASE WHEN len(w.sel) < {N} AND NOT list_has_any(w.sel, coalesce(b.us, CAST([] AS BIGINT[]))) THEN list_append(w.sel, c.ticker) ELSE w.sel END FROM walk w JOIN cand c ON c.date = w.date AND c.place = w.place + 1 LEFT JOIN bad b ON b.date = c.date AND b.t = c.ticker),
ends AS (SELECT date, max_by(sel, place) AS sel FROM walk GROUP BY 1),
chosen AS (SELECT date, unnest(sel) AS ticker, unnest(range(1, len(sel) + 1)) AS picked FROM ends)"""


def best(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return scored(s, d).filter("score is not null").withColumn("place", F.row_number().over(order)).select("date", "ticker", "place", "score")


BEST = "best AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM scored WHERE score IS NOT NULL)"


def tk3(s: SparkSession, d: str) -> DataFrame:
    return K.funnel(scored(s, d), "score", N, **RULES).select("ticker", "date", "dropped_by")


def tk4(s: SparkSession, d: str) -> DataFrame:
    return K.uncorrelated(best(s, d), tables.bars(s, d, True), N, POOL, MOST, BACK).select("date", "ticker", F.col("picked").cast("long").alias("picked"))


def tk14(s: SparkSession, d: str) -> DataFrame:
    out = K.select_and_weight(scored(s, d), tables.bars(s, d, True), N, most=MOST, lookback=BACK, **RULES)
    return rounded(out, ["ticker", "date"], ["score", "weight"])


def tk11(s: SparkSession, d: str) -> DataFrame:
    m = tables.macro(s, d)
    half = lambda x: m.filter(F.col("series_id") == x).select("date", "value")
    w = tables.bars(s, d).select("ticker", "date", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
    return rounded(K.credit_overlay(w, half("1-URGENT"), half("2-HIGH"), 200_000.0, 210_000.0), ["ticker", "date"], ["weight"], 9)


def _weights(source: str, rounds: int = 5) -> str:
    """Signal weights of ``source``, capped by money traded, clipped and scaled until they fit."""
    ctes = [f"w0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS r FROM {source})", "w1 AS (SELECT *, r / sum(r) OVER (PARTITION BY date) AS raw FROM w0)"]
    ctes.append("v0 AS (SELECT *, CASE WHEN traded > 0 THEN least(raw, greatest(0.02, least(0.15, 0.01 * sqrt(traded / 1e6)))) ELSE raw END AS w, false AS done FROM w1)")
    for k in range(1, rounds + 1):
        ctes.append(f"c{k} AS (SELECT *, CASE WHEN done THEN w ELSE greatest(0.02, least(0.15, w)) END AS c FROM v{k - 1})")
        ctes.append(f"x{k} AS (SELECT * EXCLUDE (w, c), CASE WHEN done THEN w ELSE c / sum(c) OVER (PARTITION BY date) END AS w FROM c{k})")
        ctes.append(f"v{k} AS (SELECT * EXCLUDE (done), done OR (max(w) OVER (PARTITION BY date) <= 0.15 + 1e-6 AND min(w) OVER (PARTITION BY date) >= 0.02 - 1e-6) AS done FROM x{k})")
    return ", ".join(ctes) + f", weighted AS (SELECT ticker, date, score, w AS weight FROM v{rounds})"


TABLE = {
    "TK3_funnel": (tk3, f"{FUNNEL} SELECT ticker, date, dropped AS dropped_by FROM k7"),
    "TK4_uncorrelated": (tk4, f"{SCORED}, {BEST}, {greedy('best')} SELECT date, ticker, picked FROM chosen"),
    "TK14_select_and_weight": (
        tk14,
        f"""{FUNNEL}, left_in AS (SELECT *, greatest(1, floor(least(16, count(*) OVER (PARTITION BY date)) * 0.3)) AS cap, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS k FROM k7 WHERE dropped IS NULL),
ranked AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS place FROM left_in WHERE k <= cap), {greedy('ranked')},
book AS (SELECT l.* FROM left_in l JOIN chosen USING (date, ticker)), {_weights('book')} SELECT ticker, date, {S.rounded('score', 'weight')} FROM weighted""",
    ),
    "TK11_credit_overlay": (
        tk11,
        f"""WITH {S.DAILY}, m AS (SELECT o_orderpriority AS id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
d AS (SELECT DISTINCT date FROM bars), r AS (SELECT d.date, coalesce(a.v > 200000, false) OR coalesce(b.v > 210000, false) AS off FROM d ASOF LEFT JOIN (SELECT * FROM m WHERE id = '1-URGENT') a ON d.date >= a.date ASOF LEFT JOIN (SELECT * FROM m WHERE id = '2-HIGH') b ON d.date >= b.date)
SELECT ticker, date, round(CASE WHEN off THEN 0.5 ELSE 1 END / count(*) OVER (PARTITION BY date), 9) + 0.0 AS weight FROM bars JOIN r USING (date)""",
    ),
}

"""Queries of signals over joined tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import lag
from tidepanel.operators import joins as J
from tidepanel.operators import signals as G
from tidepanel.plans import sql as S
from tidepanel.plans.cross import DAILY, FILLS, PANEL, WEIGHTS, market, panel, rounded, weights
from tidepanel.plans.tables_sql import BOOKS, FACTS, facts, month_book
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
TD = ["ticker", "date"]


def _macro_change(s: SparkSession, d: str) -> DataFrame:
    m = tables.macro(s, d).filter("series_id = '1-URGENT'").select(F.col("series_id").alias("ticker"), "date", "value")
    return m.select("date", F.round(F.col("value") / lag("value") - 1, 9).alias("x")).filter("x is not null")


CHANGE = "m0 AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), m AS (SELECT * FROM (SELECT date, round(value / " + S.lag("value") + " - 1, 9) AS x FROM m0) WHERE x IS NOT NULL)"
FRAME = f"OVER ({S.ORDER} ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"


def _series(s: SparkSession, d: str) -> DataFrame:
    m = market(s, d).withColumn("ticker", F.lit(0))
    past = G.by_ticker().rowsBetween(-10_000_000, 0)
    return m.withColumn("level", F.round(F.sum(F.log1p(F.col("ret") * 0.02)).over(past), 9))


def _regime(s: SparkSession, d: str) -> DataFrame:
    return G.combined_regime(_series(s, d)).select("date", "value")


def beta(cond: str) -> str:
    x, y = f"CASE WHEN {cond} AND ret IS NOT NULL THEN mkt END", f"CASE WHEN {cond} THEN ret END"
    return f"(covar_pop({y}, {x}) {FRAME} / nullif(var_pop({x}) {FRAME}, 0))"


def _events(s: SparkSession, d: str) -> DataFrame:
    return facts(s, d).select("ticker", "date", F.when(F.col("fact") > 200_000, 1.0).otherwise(-0.5).alias("score"))


def _trailing(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.trailing_sum(facts(s, d), "fact"), TD, ["trailing"], 4)


def _ratios(s: SparkSession, d: str) -> DataFrame:
    return panel(s, d).withColumn("a", F.col("ret")).withColumn("b", F.col("mom"))


def _match(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars(s, d, True).filter("ret is not null").select(F.col("ticker").alias("id"), F.col("date").alias("month"), "ret")
    noise = ((F.col("id") * 7 + F.month("month") * 3) % 11 - 5) / F.lit(500.0)
    renamed = b.select((F.col("id") + 1000).alias("id"), "month", (F.col("ret") + noise).alias("ret"))
    return rounded(G.match_by_returns(b, renamed), ["id", "other", "n"], ["score"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    t = J.trades(month_book(s, d, 2), month_book(s, d, 3)).withColumn("money", F.round("money", 4))
    out = G.order_chunks(t, 250.0)
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("part", "parts")}), ["ticker", "side", "part", "parts"], ["money"])


def _mismatch(s: SparkSession, d: str) -> DataFrame:
    f = tables.fills(s, d)
    orders = f.groupBy("order_id").agg(F.sum(F.when(F.col("fill_id") % 10 > 0, F.col("qty")).otherwise(F.when(F.col("order_id") % 2 == 0, F.col("qty")).otherwise(0.0))).alias("ordered"))
    return rounded(G.quantity_mismatch(orders, f), ["order_id"], ["ordered", "filled"])


def _breadth(s: SparkSession, d: str) -> DataFrame:
    per = tables.bars(s, d).groupBy("date").agg(F.avg((F.col("ret") > 0).cast("double")).alias("up"), F.avg("volume").alias("vol")).withColumn("ticker", F.lit(0))
    return rounded(G.breadth_z(per, ["up", "vol"]), ["date"], ["value"])


def _bands(s: SparkSession, d: str) -> DataFrame:
    return rounded(G.band_energy(tables.bars(s, d)), TD, ["band0", "band1", "band2", "band3"])


IC2 = ["mom", "vol"]
LOCAL = "OVER (PARTITION BY date)"


def _ic_weighted(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).withColumn("fwd", F.round(lag("ret", -1), 9))
    return rounded(G.ic_weighted(p, IC2, "fwd"), TD, ["value"])


ZO = "OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
TABLE: dict[str, tuple[Query, str]] = {
    "M3_macro_beta": (
        lambda s, d: rounded(G.rolling_beta_to(tables.bars(s, d), _macro_change(s, d)), TD, ["value"]),
        f"WITH {S.DAILY}, {CHANGE}, j AS (SELECT b.ticker, b.date, ret, x FROM bars b JOIN m USING (date)) SELECT ticker, date, round(CASE WHEN count(CASE WHEN x IS NOT NULL THEN ret END) {FRAME} >= 60 THEN covar_samp(ret, x) {FRAME} / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN x END) {FRAME}, 0) END, 6) + 0.0 AS value FROM j",
    ),
    "W40_downside_beta_spread": (
        lambda s, d: rounded(G.downside_beta_spread(tables.bars(s, d)), TD, ["value"]),
        S.query({"mkt": "avg(ret) OVER (PARTITION BY date)"}, {"mu": S.avg("mkt", 126)}, {"dn": "mkt < mu"}, {"value": f"{beta('dn')} - {beta('NOT dn')}"}),
    ),
    "W50_combined_regime": (
        _regime,
        f"WITH {S.DAILY}, {DAILY}, l AS (SELECT 0 AS ticker, date, bench AS ret, round(sum(ln(1 + bench * 0.02)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 9) AS level FROM market), v AS (SELECT *, {S.avg('level', 40)} AS ma, {S.std('ret', 21)} AS v FROM l), z AS (SELECT *, {S.avg('v', 252, 1)} AS mv FROM v) SELECT date, CASE WHEN ma IS NULL THEN 'unknown' WHEN level > ma THEN 'bull' ELSE 'bear' END || '_' || CASE WHEN v IS NULL THEN 'unknown' WHEN v <= mv THEN 'calm' ELSE 'volatile' END AS value FROM z",
    ),
    "A20_trailing_sum": (_trailing, f"WITH {FACTS} SELECT ticker, date, round(sum(fact) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW), 4) + 0.0 AS trailing FROM facts"),
    "A21_event_pressure": (
        lambda s, d: rounded(G.event_pressure(tables.bars(s, d), _events(s, d)), TD, ["value"]),
        f"WITH {S.DAILY}, {FACTS}, e AS (SELECT ticker, date, sum(CASE WHEN fact > 200000 THEN 1.0 ELSE -0.5 END) AS s FROM facts GROUP BY 1, 2), j AS (SELECT b.ticker, b.date, CAST(coalesce(s, 0) AS DOUBLE) AS s FROM bars b LEFT JOIN e ON b.ticker = e.ticker AND b.date = e.date), t AS (SELECT *, round({S.total('s', 60, 1)}, 9) AS t FROM j) SELECT ticker, date, round({S.rank_pct('t')}, 6) + 0.0 AS value FROM t",
    ),
    "F19_difference_rank": (
        lambda s, d: rounded(G.difference_rank(tables.bars(s, d), "volume"), TD, ["value"]),
        S.query({"d": f"round(-(volume - {S.lag('volume', 21)}), 9)"}, {"value": S.rank_pct("d")}),
    ),
    "F12_ratio_change": (
        lambda s, d: rounded(G.ratio_change_rank(panel(s, d), "volume", "close"), TD, ["value"]),
        S.query({"d": f"round((volume - {S.lag('volume', 12)}) / nullif((close + {S.lag('close', 12)}) / 2, 0), 9)"}, {"value": S.rank_pct("d")}, base=S.MONTHLY, extra=PANEL, source="panel"),
    ),
    "F4_weighted_score": (
        lambda s, d: rounded(G.weighted_score(panel(s, d), {"mom": 1.2, "vol": 1.4, "size": 3.3}), TD, ["value"]),
        S.query({"value": "CASE WHEN mom IS NOT NULL AND vol IS NOT NULL THEN greatest(-20, least(20, 1.2 * mom + 1.4 * vol + 3.3 * size)) END"}, base=S.MONTHLY, extra=PANEL, source="panel"),
    ),
    "F1_flags_score": (
        lambda s, d: G.flags_score(panel(s, d), ["ret", "mom", "size"]).select("ticker", "date", F.col("value").cast("long").alias("value")),
        S.query(
            {"value": " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END + CASE WHEN {c} > {S.lag(c, 12)} THEN 1 ELSE 0 END" for c in ("ret", "mom", "size"))},
            base=S.MONTHLY, extra=PANEL, source="panel", final="SELECT ticker, date, CAST(value AS BIGINT) AS value FROM {at}",
        ),
    ),
    "R12_ic_weighted": (
        _ic_weighted,
        f"WITH {S.MONTHLY}, {PANEL}, p AS (SELECT *, round({S.lag('ret', -1)}, 9) AS fwd FROM panel), r AS (SELECT ticker, date, {S.rank_pct('mom')} AS r1, {S.rank_pct('vol')} AS r2, {S.rank_pct('fwd')} AS f FROM p), "
        "c AS (SELECT date, CASE WHEN isfinite(corr(r1, f)) THEN corr(r1, f) END AS c1, CASE WHEN isfinite(corr(r2, f)) THEN corr(r2, f) END AS c2 FROM r GROUP BY date), "
        f"a AS (SELECT date, CASE WHEN count(c1) {ZO} >= 3 THEN avg(c1) {ZO} END AS a1, CASE WHEN count(c2) {ZO} >= 3 THEN avg(c2) {ZO} END AS a2 FROM c), "
        "w AS (SELECT date, coalesce(greatest(lag(a1) OVER (ORDER BY date), 0), 0) AS w1, coalesce(greatest(lag(a2) OVER (ORDER BY date), 0), 0) AS w2 FROM a), "
        "n AS (SELECT date, CASE WHEN w1 + w2 > 0 THEN w1 / (w1 + w2) ELSE 0.5 END AS w1, CASE WHEN w1 + w2 > 0 THEN w2 / (w1 + w2) ELSE 0.5 END AS w2 FROM w) "
        "SELECT ticker, date, round(w1 * r1 + w2 * r2, 6) + 0.0 AS value FROM r JOIN n USING (date)",
    ),
    "TK9_volatility_target": (
        lambda s, d: rounded(G.volatility_target(weights(s, d).withColumn("v", F.round(F.abs("ret"), 9)), "v", 0.16), TD, ["value"]),
        f"WITH {S.MONTHLY}, {WEIGHTS}, x AS (SELECT *, weight * coalesce(round(abs(ret), 9), 0) AS v FROM weights), y AS (SELECT *, 0.45 * pow(sum(v) {LOCAL}, 2) + 0.55 * sum(v * v) {LOCAL} AS var FROM x) SELECT ticker, date, round(weight * coalesce(CASE WHEN var > 0 THEN least(1.3, 0.16 / sqrt(var)) END, 1), 6) + 0.0 AS value FROM y",
    ),
    "J7_match_by_returns": (
        _match,
        f"WITH {S.MONTHLY}, b AS (SELECT ticker AS id, date AS month, ret FROM bars WHERE ret IS NOT NULL), o AS (SELECT id, month, ret + ((id * 7 + month(month) * 3) % 11 - 5) / 500.0 AS ret FROM b), s AS (SELECT a.id, o.id + 1000 AS other, corr(a.ret, o.ret) AS score, count(*) AS n FROM b a JOIN o USING (month) GROUP BY 1, 2 HAVING count(*) >= 24 AND corr(a.ret, o.ret) >= 0.9), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS i FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY score DESC, id) AS j FROM k WHERE i = 1) SELECT id, other, n, round(score, 6) + 0.0 AS score FROM m WHERE j = 1",
    ),
    "G21_order_chunks": (
        _chunks,
        f"WITH {S.MONTHLY}, {BOOKS}, x AS (SELECT coalesce(t.ticker, p.ticker) AS ticker, (coalesce(t.weight, 0) - coalesce(p.weight, 0)) * 100000 AS delta FROM t FULL JOIN p ON t.ticker = p.ticker), y AS (SELECT ticker, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, round(abs(delta), 4) AS money, CAST(greatest(1, ceil(round(abs(delta), 4) / 250)) AS BIGINT) AS parts FROM x WHERE abs(delta) >= 50), z AS (SELECT *, unnest(range(1, parts + 1)) AS part FROM y) SELECT ticker, side, part, parts, round(money / parts, 6) + 0.0 AS money FROM z",
    ),
    "G4_quantity_mismatch": (
        _mismatch,
        f"WITH {FILLS}, o AS (SELECT order_id, sum(CASE WHEN fill_id % 10 > 0 OR order_id % 2 = 0 THEN qty ELSE 0 END) AS ordered, sum(qty) AS filled FROM fills GROUP BY 1) SELECT order_id, round(ordered, 6) + 0.0 AS ordered, round(filled, 6) + 0.0 AS filled FROM o WHERE abs(filled - ordered) > greatest(0.005 * ordered, 1e-6)",
    ),
    "A10_breadth_z": (
        _breadth,
        f"WITH {S.DAILY}, p AS (SELECT 0 AS ticker, date, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS up, avg(volume) AS vol FROM bars GROUP BY date) SELECT date, round((" + S.div(f"up - {S.avg('up', 60)}", S.std("up", 60)) + " + " + S.div(f"vol - {S.avg('vol', 60)}", S.std("vol", 60)) + ") / 2, 6) + 0.0 AS value FROM p",
    ),
    "A15_correlated_pairs": (
        lambda s, d: G.correlated_pairs(panel(s, d), ["mom", "vol", "size"]).select("left", "right", (F.round("corr", 6) + 0.0).alias("corr"), "close"),
        f"WITH {S.MONTHLY}, {PANEL}, c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", corr({a}, {b}) AS corr FROM panel" for a, b in (("vol", "mom"), ("size", "mom"), ("size", "vol"))) + ') SELECT "left", "right", round(corr, 6) + 0.0 AS corr, abs(corr) > 0.7 AS close FROM c',
    ),
    "W42_band_energy": (_bands, ""),
}

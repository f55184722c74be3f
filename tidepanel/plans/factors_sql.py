"""Queries of factor exposures, factor momentum and volatility regimes, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.columns import lag
from tidepanel.operators import factors as X
from tidepanel.operators import macro_signals as M
from tidepanel.plans import sql as S
from tidepanel.plans.cross import DAILY, daily, rounded
from tidepanel.sources import tables

TD = ["ticker", "date"]
SERIES = {"f1": "1-URGENT", "f2": "2-HIGH", "f3": "3-MEDIUM"}
NAMES = list(SERIES)


def changes(s: SparkSession, d: str) -> DataFrame:
    held = M.on_calendar(tables.bars(s, d), tables.macro(s, d), SERIES)
    return held.select("date", *[(F.try_divide(F.col(c), lag(c)) - 1).alias(c) for c in NAMES])


def _market(s: SparkSession, d: str) -> DataFrame:
    return tables.bars(s, d).groupBy("date").agg(F.avg("ret").alias("ret")).filter("ret is not null")


def w46(s: SparkSession, d: str) -> DataFrame:
    f = changes(s, d)
    out = X.momentum_signals(X.rolling_betas(tables.bars(s, d).select(*TD, "ret"), f, NAMES), X.factor_momentum(f, NAMES), NAMES)
    return rounded(out, TD, ["value", *[f"value_{c}" for c in NAMES]], 5)


def w48(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.volatility_regime(_market(s, d)), ["date", "regime"], ["vol", "rank"])


def w55(s: SparkSession, d: str) -> DataFrame:
    return rounded(X.strategy_beta(daily(s, d), _market(s, d).withColumnRenamed("ret", "mkt")), ["strategy_id", "date"], ["beta"])


CHANGES = """series AS (SELECT o_orderpriority AS id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
wide AS (SELECT date, max(v) FILTER (id = '1-URGENT') AS a1, max(v) FILTER (id = '2-HIGH') AS a2, max(v) FILTER (id = '3-MEDIUM') AS a3 FROM series GROUP BY 1),
cal AS (SELECT date, last_value(a1 IGNORE NULLS) OVER w AS a1, last_value(a2 IGNORE NULLS) OVER w AS a2, last_value(a3 IGNORE NULLS) OVER w AS a3 FROM (SELECT DISTINCT date FROM bars) LEFT JOIN wide USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)),
f AS (SELECT date, a1 / lag(a1) OVER w - 1 AS f1, a2 / lag(a2) OVER w - 1 AS f2, a3 / lag(a3) OVER w - 1 AS f3 FROM cal WINDOW w AS (ORDER BY date))"""
MOM = ", ".join(f"CASE WHEN count({c}) OVER w >= 126 THEN sum({c}) OVER w END AS m_{c}" for c in NAMES)
BETA = ", ".join(f"CASE WHEN regr_count(ret, {c}) OVER w >= 126 AND isfinite(regr_slope(ret, {c}) OVER w) THEN regr_slope(ret, {c}) OVER w END AS b_{c}" for c in NAMES)
PARTS = ", ".join(f"b_{c} * m_{c} AS p_{c}" for c in NAMES)
TOTAL = " + ".join(f"coalesce(p_{c}, 0)" for c in NAMES)
SCORES = ", ".join(f"round({S.zscore(x, 2.0)}, 5) + 0.0 AS {n}" for x, n in [("p", "value"), *[(f"p_{c}", f"value_{c}") for c in NAMES]])
TABLE = {
    "W46_factor_momentum_signal": (
        w46,
        f"""WITH {S.DAILY}, {CHANGES}, m AS (SELECT date, {MOM} FROM f WINDOW w AS (ORDER BY date ROWS 251 PRECEDING)),
b AS (SELECT ticker, date, {BETA} FROM bars JOIN f USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)), q AS (SELECT ticker, date, {PARTS} FROM b JOIN m USING (date)),
t AS (SELECT *, CASE WHEN coalesce({', '.join(f'p_{c}' for c in NAMES)}) IS NOT NULL THEN {TOTAL} END AS p FROM q) SELECT ticker, date, {SCORES} FROM t""",
    ),
    "W48_volatility_regime": (
        w48,
        f"""WITH {S.DAILY}, m AS (SELECT date, avg(ret) AS ret FROM bars GROUP BY 1 HAVING avg(ret) IS NOT NULL), v AS (SELECT date, CASE WHEN count(ret) OVER w >= 21 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM m WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)),
l AS (SELECT *, list(vol) OVER (ORDER BY date ROWS 251 PRECEDING) AS h FROM v), n AS (SELECT *, len(list_filter(h, lambda x: x IS NOT NULL)) AS n, len(list_filter(h, lambda x: x < vol)) AS below, len(list_filter(h, lambda x: x = vol)) AS ties FROM l),
r AS (SELECT date, vol, CASE WHEN vol IS NOT NULL AND n >= 63 THEN (below + (ties + 1) / 2.0) / n END AS rank FROM n)
SELECT date, CASE WHEN rank <= 0.33 THEN 'low_vol' WHEN rank >= 0.67 THEN 'high_vol' ELSE 'med_vol' END AS regime, {S.rounded('vol', 'rank')} FROM r""",
    ),
    "W55_strategy_beta": (
        w55,
        f"""WITH {S.DAILY}, {DAILY}, j AS (SELECT strategy_id, date, ret, bench FROM daily JOIN market USING (date)), b AS (SELECT strategy_id, date, CASE WHEN count(*) OVER w >= 63 THEN covar_samp(ret, bench) OVER w / nullif(var_samp(bench) OVER w, 0) END AS beta FROM j WINDOW w AS (PARTITION BY strategy_id ORDER BY date ROWS 125 PRECEDING))
SELECT strategy_id, date, {S.rounded('beta')} FROM b WHERE beta IS NOT NULL""",
    ),
}

"""Queries of cross-sectional operators, aggregates and metrics, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import lag, mean, momentum, norm_cdf, norm_ppf, rolling, std
from tidepanel.operators import aggregates as A
from tidepanel.operators import cross_section as R
from tidepanel.operators import metrics as X
from tidepanel.plans import sql as S
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, keys: list[str], values: list[str], places: int = 6) -> DataFrame:
    return df.select(*keys, *[(F.round(v, places) + 0.0).alias(v) for v in values])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars with their sector, momentum ``mom``, volatility ``vol`` and log volume ``size``."""
    b = tables.bars(spark, sf_dir, month=True).join(tables.sectors(spark, sf_dir), "ticker")
    return b.withColumn("mom", F.round(momentum("close", 3), 9)).withColumn("vol", F.round(std("ret", 6), 9)).withColumn("size", F.round(F.ln("volume"), 9))


PANEL = S.SECTORS + ", " + ", ".join([
    "p0 AS (SELECT b.*, sector, industry FROM bars b JOIN sectors USING (ticker))",
    f"panel AS (SELECT *, round({S.momentum('close', 3)}, 9) AS mom, round({S.std('ret', 6)}, 9) AS vol, round(ln(volume), 9) AS size FROM p0)",
])


def on_panel(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(op(panel(spark, sf_dir)), ["ticker", "date"], ["value"])


def sql(*steps, **kw) -> str:
    return S.query(*steps, base=S.MONTHLY, extra=PANEL, source="panel", **kw)


def ols(y: str, x: str, least: int, strength: float = 1.0) -> list[dict[str, str]]:
    w = "OVER (PARTITION BY date)"
    return [
        {"ok": f"({x} IS NOT NULL AND {y} IS NOT NULL)", "sl": f"regr_slope({y}, {x}) {w}", "ic": f"regr_intercept({y}, {x}) {w}"},
        {"res": f"CASE WHEN sum(CASE WHEN ok THEN 1 ELSE 0 END) {w} >= {least} AND isfinite(sl) AND ok THEN {y} - {strength} * (ic + sl * {x}) ELSE {y} END"},
    ]


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight return of each sector (strategy) and date."""
    b = tables.bars(spark, sf_dir).join(tables.sectors(spark, sf_dir), "ticker")
    return b.groupBy(F.col("sector").alias("strategy_id"), "date").agg(F.avg("ret").alias("ret")).filter("ret is not null")


def calm(df: DataFrame) -> DataFrame:
    """A fiftieth of the returns: compounded over years, those of this data overflow any rounding."""
    return df.withColumn("ret", F.col("ret") * 0.02)


DAILY = S.SECTORS + """, market AS (SELECT date, avg(ret) AS bench FROM bars GROUP BY date HAVING avg(ret) IS NOT NULL),
daily AS (SELECT sector AS strategy_id, date, avg(ret) AS ret FROM bars JOIN sectors USING (ticker) GROUP BY 1, 2 HAVING avg(ret) IS NOT NULL)"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.market_series(tables.bars(spark, sf_dir))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.bars(spark, sf_dir, month=True).join(tables.sectors(spark, sf_dir), "ticker")
    return b.withColumn("weight", F.col("volume") / F.sum("volume").over(Window.partitionBy("date")))


WEIGHTS = S.SECTORS + ", weights AS (SELECT b.*, sector, volume / sum(volume) OVER (PARTITION BY date) AS weight FROM bars b JOIN sectors USING (ticker))"
G = "ln(1 + greatest({}, -0.999999))"
COMP = "exp(sum(" + G + ")) - 1"


def _ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir).withColumn("fwd", F.round(lag("ret", -1), 9))
    return A.information_coefficient(p, "mom", "fwd")


IC = "ic AS (SELECT date, corr(a, b) AS ic, count(*) AS n FROM (SELECT date, " + S.rank_pct("mom") + " AS a, " + S.rank_pct("fwd") + f" AS b FROM (SELECT *, round({S.lag('ret', -1)}, 9) AS fwd FROM panel) WHERE mom IS NOT NULL AND fwd IS NOT NULL) GROUP BY date HAVING count(*) >= 10 AND isfinite(corr(a, b)))"
REGIME = f"CASE WHEN bench > avg(bench) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) THEN 'up' ELSE 'down' END"


def _regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = market(spark, sf_dir).withColumn("ticker", F.lit("market"))
    m = m.withColumn("regime", F.when(F.col("ret") > mean("ret", 21, 1), "up").otherwise("down"))
    return rounded(A.by_regime(m, "regime").withColumn("n", F.col("n").cast("long")), ["regime", "n"], ["ann_return", "ann_vol", "sharpe", "win_rate"])


PERIODS = [("early", "1995-02-01", "1995-06-30"), ("middle", "1998-01-01", "1998-12-31"), ("none", "2030-01-01", "2030-12-31")]


def _stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = spark.createDataFrame(PERIODS, "name string, first string, last string").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    return rounded(A.stress(calm(market(spark, sf_dir)), periods), ["name", "days"], ["total_return", "volatility"])


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.annual_returns(calm(daily(spark, sf_dir)), calm(market(spark, sf_dir)), ["strategy_id"])
    return rounded(out.withColumn("year", F.col("year").cast("long")), ["strategy_id", "year"], ["strategy", "benchmark", "alpha"])


def _tear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.tearsheet(daily(spark, sf_dir), market(spark, sf_dir).withColumnRenamed("ret", "bench"))


TEAR = ("sharpe", "sortino", "max_drawdown", "calmar", "information_ratio", "ann_return", "ann_vol", "win_rate", "profit_factor", "tail_ratio", "beta")
TEAR_SQL = f"""WITH {S.DAILY}, {DAILY}, lw AS (SELECT *, sum({G.format('ret')}) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS lw FROM daily),
dd AS (SELECT *, exp(lw - greatest(0, max(lw) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING))) - 1 AS dd FROM lw),
j AS (SELECT dd.*, bench, ret - bench AS act FROM dd JOIN market USING (date)),
t AS (SELECT strategy_id, count(ret) AS n, coalesce((avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe,
(avg(ret) - 0.02 / 252) / nullif(sqrt(avg(pow(least(ret - 0.02 / 252, 0), 2))), 0) * sqrt(252) AS sortino, min(dd) AS max_drawdown,
(pow(exp(sum({G.format('ret')})), 252.0 / count(ret)) - 1) / nullif(abs(min(dd)), 0) AS calmar, avg(act) / nullif(stddev_samp(act), 0) * sqrt(252) AS information_ratio,
pow(exp(sum({G.format('ret')})), 252.0 / count(ret)) - 1 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
sum(greatest(ret, 0)) / nullif(abs(sum(least(ret, 0))), 0) AS profit_factor, quantile_cont(ret, 0.95) / nullif(abs(quantile_cont(ret, 0.05)), 0) AS tail_ratio, covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta
FROM j GROUP BY strategy_id)
SELECT strategy_id, n, {S.rounded(*TEAR)} FROM t"""


def _psr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.probabilistic_sharpe(daily(spark, sf_dir)), ["strategy_id", "n"], ["skew", "kurt", "psr"])


def series_cdf(z: str) -> str:
    """The normal distribution function by its power series, which shares nothing with the plan's form."""
    terms = f"list_transform(range(0, 90), lambda k: pow(-1, k) * pow({z}, 2 * k + 1) / (gamma(k + 1) * pow(2, k) * (2 * k + 1)))"
    return f"(CASE WHEN abs({z}) > 6 THEN CAST({z} > 0 AS INTEGER) ELSE 0.5 + list_sum({terms}) / sqrt(2 * pi()) END)"


def series_ppf(p: str) -> list[dict[str, str]]:
    """Steps to its inverse ``x4``: Newton's method on the series, from Tukey's lambda form."""
    steps = [{"x0": f"4.91 * (pow({p}, 0.14) - pow(1 - {p}, 0.14))"}]
    return steps + [{f"x{k + 1}": f"x{k} - ({series_cdf(f'x{k}')} - {p}) * sqrt(2 * pi()) * exp(x{k} * x{k} / 2)"} for k in range(4)]


PSR_SQL = f"""WITH {S.DAILY}, {DAILY}, m AS (SELECT strategy_id, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, skewness(ret) AS skew, kurtosis(ret) + 3 AS kurt FROM daily GROUP BY 1 HAVING count(ret) > 3),
z AS (SELECT *, sr * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM m),
f AS (SELECT strategy_id, n, skew, kurt, {series_cdf('z')} AS psr FROM z) SELECT strategy_id, n, {S.rounded('skew', 'kurt', 'psr')} FROM f"""


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.drawdown_spells(daily(spark, sf_dir)), ["strategy_id", "spells"], ["mean_length"])


SPELLS_SQL = f"""WITH {S.DAILY}, {DAILY}, lw AS (SELECT *, sum({G.format('ret')}) OVER w AS lw FROM daily WINDOW w AS (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN exp(lw - greatest(0, max(lw) OVER (PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING))) - 1 < -1e-12 THEN 1 ELSE 0 END AS i FROM lw),
e AS (SELECT *, CASE WHEN i = 1 AND coalesce(lag(i) OVER (PARTITION BY strategy_id ORDER BY date), 0) = 0 THEN 1 ELSE 0 END AS s, max(date) OVER (PARTITION BY strategy_id) AS final FROM d),
f AS (SELECT *, sum(s) OVER (PARTITION BY strategy_id ORDER BY date) AS spell FROM e), g AS (SELECT strategy_id, spell, count(*) AS length FROM f WHERE i = 1 GROUP BY strategy_id, spell, final HAVING max(date) < final)
SELECT strategy_id, count(*) AS spells, round(avg(length), 6) + 0.0 AS mean_length FROM g GROUP BY strategy_id"""


def _fills(*keys: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(A.fills_by(tables.fills(spark, sf_dir), *keys), [*keys, "n_fills", "first_ts", "last_ts"], ["qty", "vwap", "notional", "net_cash"], 4)

    return run


FILLS = """fills AS (SELECT event_id AS fill_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS order_id, ts, user_id AS account, CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, value AS price, CAST(event_id % 7 + 1 AS DOUBLE) AS qty FROM events WHERE event_type IN ('purchase', 'error'))"""


def _fills_sql(*keys: str) -> str:
    k = ", ".join(keys)
    r = {"qty": "sum(qty)", "vwap": "sum(qty * price) / nullif(sum(qty), 0)", "notional": "sum(qty * price)", "net_cash": "sum(CASE WHEN side = 'BUY' THEN -qty * price ELSE qty * price END)"}
    return f"WITH {FILLS} SELECT {k}, count(*) AS n_fills, min(ts) AS first_ts, max(ts) AS last_ts, " + ", ".join(f"round({x}, 4) + 0.0 AS {c}" for c, x in r.items()) + f" FROM fills GROUP BY {k}"


def _slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.fills(spark, sf_dir)
    return rounded(A.slippage(f, f.groupBy("account").agg(F.avg("price").alias("expected"))), ["side", "n"], ["mean", "median", "least", "most", "std"], 4)


SLIP_SQL = f"""WITH {FILLS}, e AS (SELECT account, avg(price) AS expected FROM fills GROUP BY 1),
b AS (SELECT side, CASE WHEN side = 'BUY' THEN price - expected ELSE expected - price END / nullif(expected, 0) * 10000 AS bps FROM fills JOIN e USING (account))
SELECT side, count(*) AS n, round(avg(bps), 4) + 0.0 AS mean, round(median(bps), 4) + 0.0 AS median, round(min(bps), 4) + 0.0 AS least, round(max(bps), 4) + 0.0 AS most, round(stddev_samp(bps), 4) + 0.0 AS std FROM b WHERE bps IS NOT NULL GROUP BY side"""


def _allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.sector_allocation(weights(spark, sf_dir)), ["date", "sector"], ["value"])


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.portfolio_stats(weights(spark, sf_dir)), ["date", "positions"], ["exposure", "largest", "top_five"])


def _on_dates(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(op(tables.bars(spark, sf_dir)), ["date"], ["value"])


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.bars(spark, sf_dir).select("ticker", "date", (F.pmod(F.col("volume"), F.lit(97.0)) / 100 + 0.01).alias("p"))
    return rounded(b.withColumn("ppf", norm_ppf("p")).withColumn("cdf", norm_cdf("p")), ["ticker", "date"], ["ppf", "cdf"])


NORMAL_SQL = S.query(
    {"p": "(volume % 97) / 100 + 0.01"},
    *series_ppf("p"),
    {"ppf": "x4", "cdf": series_cdf("p")},
    final="SELECT ticker, date, " + S.rounded("ppf", "cdf") + " FROM {at}",
)


def _select(op: Callable[[DataFrame], DataFrame], *keys: str) -> Query:
    return lambda spark, sf_dir: op(panel(spark, sf_dir)).select("ticker", "date", *keys, F.col("value").cast("long").alias("value"))


NEUTRAL_2 = [
    {"ok": "(mom IS NOT NULL AND vol IS NOT NULL AND size IS NOT NULL)"},
    {k: f"CASE WHEN ok THEN {v} - avg(CASE WHEN ok THEN {v} END) OVER (PARTITION BY date) END" for k, v in (("a", "vol"), ("c", "size"), ("d", "mom"))},
    {k: f"sum({x}) OVER (PARTITION BY date)" for k, x in (("s11", "a * a"), ("s22", "c * c"), ("s12", "a * c"), ("s1y", "a * d"), ("s2y", "c * d"))} | {"cnt": "sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY date)"},
    {"b1": "(s1y * s22 - s2y * s12) / nullif(s11 * s22 - s12 * s12, 0)", "b2": "(s2y * s11 - s1y * s12) / nullif(s11 * s22 - s12 * s12, 0)"},
    {"value": "CASE WHEN cnt >= 12 AND b1 IS NOT NULL AND ok THEN d - b1 * a - b2 * c ELSE mom END"},
]
CAPPED: list[dict[str, str]] = [{"v0": "volume / nullif(sum(volume) OVER (PARTITION BY date), 0)"}]
for _k in range(5):
    CAPPED += [{f"c{_k}": f"greatest(0.02, least(0.15, v{_k}))"}, {f"v{_k + 1}": f"c{_k} / nullif(sum(c{_k}) OVER (PARTITION BY date), 0)"}]

TABLE: dict[str, tuple[Query, str]] = {
    "R1_rank": (on_panel(lambda p: R.cross_rank(p, "mom")), sql({"value": S.rank_pct("mom")})),
    "R2_demean": (on_panel(lambda p: R.cross_demean(p, "mom")), sql({"value": "mom - avg(mom) OVER (PARTITION BY date)"})),
    "R3_zscore": (on_panel(lambda p: R.cross_zscore(p, "mom", 2.0)), sql({"value": S.zscore("mom", 2.0)})),
    "R4_winsorize": (
        on_panel(lambda p: R.winsorize(p, "mom", 0.05, 0.95)),
        sql({"value": "CASE WHEN mom IS NOT NULL THEN greatest(quantile_cont(mom, 0.05) OVER (PARTITION BY date), least(quantile_cont(mom, 0.95) OVER (PARTITION BY date), mom)) END"}),
    ),
    "P3_rank_normal": (
        on_panel(lambda p: R.rank_normal(p, "mom")),
        sql(
            {"p": f"greatest(0.0001, least(0.9999, {S.rank_pct('mom')}))"},
            *series_ppf("p"),
            {"value": "CASE WHEN mom IS NOT NULL THEN x4 END"},
        ),
    ),
    "P4_normal_functions": (_normal, NORMAL_SQL),
    "R6_sector_neutral": (
        on_panel(lambda p: R.group_neutral(p, "mom", "sector")),
        sql("SELECT p.*, k FROM {at} p JOIN (SELECT sector, count(DISTINCT ticker) AS k FROM panel GROUP BY sector) USING (sector)", {"value": "CASE WHEN k >= 3 THEN mom - avg(mom) OVER (PARTITION BY date, sector) ELSE mom END"}),
    ),
    "R7_size_neutral": (on_panel(lambda p: R.size_neutral(p, "mom", "size")), sql(*ols("mom", "size", 10), {"value": "res"})),
    "R8_two_factor_neutral": (on_panel(lambda p: R.two_factor_neutral(p, "mom", "vol", "size")), sql(*NEUTRAL_2)),
    "R10_partial_neutral": (on_panel(lambda p: R.partial_neutral(p, "mom", "size")), sql(*ols("mom", "size", 10, 0.5), {"value": "res"})),
    "R11_orthogonal_blend": (
        on_panel(lambda p: R.orthogonal_blend(p, "vol", "mom")),
        sql(*ols("mom", "vol", 10), {"bl": f"round(0.7 * {S.rank_pct('vol')} + (1 - 0.7) * {S.rank_pct('res')}, 9)"}, {"value": S.rank_pct("bl")}),
    ),
    "R13_composite": (
        on_panel(lambda p: R.weighted_composite(p, {"mom": 0.5, "vol": 0.25, "size": 0.25})),
        sql({"t": f"round(0.5 * {S.rank_pct('mom')} + 0.25 * {S.rank_pct('vol')} + 0.25 * {S.rank_pct('size')}, 9)"}, {"value": S.rank_pct("t")}),
    ),
    "R15_interaction": (on_panel(lambda p: R.interaction(p, "mom", "vol")), sql({"pr": "mom * vol"}, {"value": S.zscore("pr")})),
    "R16_quality_tilt": (on_panel(lambda p: R.quality_tilt(p, "mom", "size")), sql({"value": f"mom * greatest(0.1, 1 + 0.3 * coalesce({S.zscore('size', 2.0)}, 0))"})),
    "C11_investable": (on_panel(lambda p: R.investable(p, "volume")), sql({"value": f"coalesce(CASE WHEN {S.rank_pct('volume')} >= 0.5 THEN 1 ELSE 0 END, 0)"})),
    "TK1_sector_caps": (
        _select(lambda p: R.select_with_caps(p, "mom", "sector"), "sector"),
        f"WITH {S.MONTHLY}, {PANEL}, g AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY mom DESC, ticker) AS k FROM panel WHERE mom IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS value FROM g WHERE k <= 3) SELECT ticker, date, sector, value FROM h WHERE value <= 10",
    ),
    "TK2_vol_buckets": (
        _select(lambda p: R.volatility_buckets(p, "mom", "vol"), "bucket"),
        f"WITH {S.MONTHLY}, {PANEL}, g AS (SELECT *, CAST(least(5, ceil({S.rank_pct('vol')} * 5)) AS INTEGER) AS bucket FROM panel WHERE mom IS NOT NULL AND vol IS NOT NULL), h AS (SELECT *, row_number() OVER (PARTITION BY date, bucket ORDER BY mom DESC, ticker) AS value FROM g) SELECT ticker, date, bucket, value FROM h WHERE value <= 3",
    ),
    "TK5_capped_weights": (on_panel(lambda p: R.capped_weights(p, "volume")), sql(*CAPPED, {"value": "v5"})),
    "A1_monthly_returns": (
        lambda s, d: rounded(A.monthly_returns(tables.bars(s, d)), ["ticker", "month_end"], ["value"]),
        f"WITH {S.DAILY} SELECT ticker, last_day(date) AS month_end, round({COMP.format('ret')}, 6) + 0.0 AS value FROM bars GROUP BY 1, 2",
    ),
    "A2_monthly_table": (
        lambda s, d: (t := A.monthly_table(calm(market(s, d)))).select(F.col("year").cast("long").alias("year"), *[F.col(c).alias(f"m{c}" if c.isdigit() else c) for c in t.columns if c != "year"]),
        f"WITH {S.DAILY}, {DAILY} SELECT year(date) AS year, " + ", ".join(f"round(100 * (exp(sum(CASE WHEN month(date) = {m} THEN {G.format('bench * 0.02')} END)) - 1), 2) AS m{m}" for m in range(1, 13)) + f", round(100 * ({COMP.format('bench * 0.02')}), 2) AS ytd FROM market GROUP BY 1",
    ),
    "A3_annual_returns": (
        _annual,
        f"WITH {S.DAILY}, {DAILY}, y AS (SELECT strategy_id, year(date) AS year, {COMP.format('ret * 0.02')} AS strategy, {COMP.format('bench * 0.02')} AS benchmark FROM daily JOIN market USING (date) GROUP BY 1, 2), z AS (SELECT *, strategy - benchmark AS alpha FROM y) SELECT strategy_id, year, {S.rounded('strategy', 'benchmark', 'alpha')} FROM z",
    ),
    "A4_monthly_win_rate": (
        lambda s, d: rounded(A.win_rate_monthly(market(s, d)), ["months"], ["value"]),
        f"WITH {S.DAILY}, {DAILY}, m AS (SELECT last_day(date) AS m, {COMP.format('bench')} AS r FROM market GROUP BY 1) SELECT count(*) AS months, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM m",
    ),
    "A5_information_coefficient": (lambda s, d: rounded(_ic(s, d), ["date", "n"], ["ic"]), f"WITH {S.MONTHLY}, {PANEL}, {IC} SELECT date, n, {S.rounded('ic')} FROM ic"),
    "A6_ic_summary": (
        lambda s, d: rounded(A.ic_summary(_ic(s, d)), ["days"], ["mean_ic", "ir", "positive"]),
        f"WITH {S.MONTHLY}, {PANEL}, {IC}, t AS (SELECT count(*) AS days, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM ic) SELECT days, {S.rounded('mean_ic', 'ir', 'positive')} FROM t",
    ),
    "A7_above_average": (
        _on_dates(lambda b: A.breadth(b.withColumn("ma", mean("close", 200)), "ma")),
        f"WITH {S.DAILY}, m AS (SELECT *, {S.avg('close', 200)} AS ma FROM bars) SELECT date, round(avg(CASE WHEN close > ma THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM m GROUP BY date",
    ),
    "A8_highs_less_lows": (
        _on_dates(lambda b: A.highs_less_lows(b.withColumn("hi", rolling(F.max, "close", 60)).withColumn("lo", rolling(F.min, "close", 60)), "hi", "lo")),
        f"WITH {S.DAILY}, m AS (SELECT *, {S.roll('max({})', 'close', 60)} AS hi, {S.roll('min({})', 'close', 60)} AS lo FROM bars) SELECT date, round((sum(CASE WHEN close = hi THEN 1 ELSE 0 END) - sum(CASE WHEN close = lo THEN 1 ELSE 0 END)) / count(close), 6) + 0.0 AS value FROM m GROUP BY date",
    ),
    "A9_advance_decline": (_on_dates(A.advance_decline), f"WITH {S.DAILY} SELECT date, round(sum(CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END) / nullif(sum(CASE WHEN ret < 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END), 0), 6) + 0.0 AS value FROM bars GROUP BY date"),
    "A11_market_series": (lambda s, d: rounded(market(s, d), ["date"], ["ret"]), f"WITH {S.DAILY} SELECT date, round(avg(ret), 6) + 0.0 AS ret FROM bars GROUP BY date HAVING avg(ret) IS NOT NULL"),
    "A12_by_regime": (
        _regime,
        f"WITH {S.DAILY}, {DAILY}, r AS (SELECT *, {REGIME} AS regime FROM market), t AS (SELECT regime, count(*) AS n, avg(bench) * 252 AS ann_return, stddev_samp(bench) * sqrt(252) AS ann_vol, (avg(bench) - 0.02 / 252) / nullif(stddev_samp(bench), 0) * sqrt(252) AS sharpe, avg(CASE WHEN bench > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM r GROUP BY 1 HAVING count(*) >= 20) SELECT regime, n, {S.rounded('ann_return', 'ann_vol', 'sharpe', 'win_rate')} FROM t",
    ),
    "A13_stress": (
        _stress,
        f"WITH {S.DAILY}, {DAILY}, p(name, first, last) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + f"), t AS (SELECT name, count(bench) AS days, {COMP.format('bench * 0.02')} AS total_return, stddev_samp(bench * 0.02) * sqrt(252) AS volatility FROM p LEFT JOIN market ON date BETWEEN first AND last GROUP BY name) SELECT name, days, CASE WHEN days >= 5 THEN round(total_return, 6) + 0.0 END AS total_return, CASE WHEN days >= 5 THEN round(volatility, 6) + 0.0 END AS volatility FROM t",
    ),
    "A16_portfolio_stats": (
        _stats,
        f"WITH {S.MONTHLY}, {WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY weight DESC, ticker) AS k FROM weights), t AS (SELECT date, count(*) FILTER (weight > 0) AS positions, sum(weight) AS exposure, max(weight) AS largest, sum(CASE WHEN k <= 5 THEN weight END) AS top_five FROM k GROUP BY date) SELECT date, positions, {S.rounded('exposure', 'largest', 'top_five')} FROM t",
    ),
    "A17_sector_allocation": (_allocation, f"WITH {S.MONTHLY}, {WEIGHTS} SELECT date, sector, round(sum(weight), 6) + 0.0 AS value FROM weights GROUP BY date, sector"),
    "A18_fills_by_order": (_fills("order_id"), _fills_sql("order_id")),
    "A18_fills_by_account": (_fills("account", "side"), _fills_sql("account", "side")),
    "A19_slippage": (_slippage, SLIP_SQL),
    "X1_tearsheet": (lambda s, d: rounded(_tear(s, d), ["strategy_id", "n"], list(TEAR)), TEAR_SQL),
    "X12_probabilistic_sharpe": (_psr, PSR_SQL),
    "W53_drawdown_spells": (_spells, SPELLS_SQL),
}


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampled from the market returns; rows are numbered on a table of one row per trading date."""
    m = market(spark, sf_dir).withColumn("row", F.row_number().over(Window.orderBy("date")).cast("long") - 1)
    return rounded(X.block_bootstrap_means(m), [], ["low", "middle", "high"])


TABLE["X16_block_bootstrap"] = (_bootstrap, "")

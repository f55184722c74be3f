"""Queries of option, macro and fundamental signals, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import fundamentals as D
from tidepanel.operators import joins as J
from tidepanel.operators import macro_signals as M
from tidepanel.operators import option_signals as O  # noqa: E741,N812
from tidepanel.plans import sql as S
from tidepanel.plans.cross import rounded
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
TD = ["ticker", "date"]

VOLS = """v0 AS (SELECT l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_discount) AS ad, max(l_discount) AS xd, min(l_discount) AS nd, avg(l_tax) AS tt, max(l_tax) AS xt, min(l_tax) AS nt, max(l_quantity) AS mq,
    coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS call_oi, coalesce(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity END), 0) AS put_oi FROM lineitem GROUP BY 1, 2),
v AS (SELECT ticker, date, call_oi, put_oi, 0.1 + 5 * xd AS iv7, 0.1 + 5 * ad AS iv30, 0.1 + 6 * tt AS iv60, 0.1 + 5 * xt AS iv90, 0.1 + 3 * (ad + tt) AS iv180, 0.1 + 5 * nd + nt AS iv365, ad - tt AS slope, xd - xt AS cp_spread, mq / 100 AS implied_move, tt - xt AS implied_skew, 3 + xd - nd AS implied_kurt,
    0.1 + 5 * ad - tt / 10 AS call25, 0.1 + 5 * ad + xt / 10 AS put25, 0.1 + 5 * ad + xd AS put5, 0.1 + 5 * ad - nd / 2 AS event_free FROM v0),
options AS (SELECT v.*, b.ret FROM v JOIN bars b ON v.ticker = b.ticker AND v.date = b.date)"""


def _options(s: SparkSession, d: str) -> DataFrame:
    return tables.volatilities(s, d).join(tables.bars(s, d, True).select("ticker", "date", "ret"), TD)


def forward(a: str, ta: int, b: str, tb: int) -> str:
    return f"sqrt(greatest(({b} * {b} * {tb} - {a} * {a} * {ta}) / {tb - ta}.0, 0))"


def rv(n: int) -> str:
    return f"({S.std('ret', n, n)} * sqrt(252))"


OPTIONS = {
    "O1": ("smile_slope", "slope"),
    "O2": ("call_put_spread", "cp_spread"),
    "O3": ("realized_less_implied", f"{rv(21)} - iv30"),
    "O4": ("variance_premium", f"-(iv30 * iv30 - pow({rv(21)}, 2))"),
    "O5": ("term_slope", "iv60 - iv30"),
    "O6": ("term_convexity", "-(iv30 - 2 * iv60 + iv90)"),
    "O7": ("short_slope", "iv30 - iv7"),
    "O8": ("long_slope", "iv365 - iv90"),
    "O9": ("implied_move", "-implied_move"),
    "O10": ("implied_skew", "implied_skew"),
    "O11": ("implied_kurtosis", "implied_kurt"),
    "O12": ("forward_slope", f"-({forward('iv60', 60, 'iv90', 90)} - {forward('iv30', 30, 'iv60', 60)})"),
    "O13": ("realized_less_forward", f"{rv(30)} - {forward('iv30', 30, 'iv60', 60)}"),
    "O14": ("long_forward_premium", f"-({forward('iv90', 90, 'iv180', 180)} - iv30)"),
    "O15": ("risk_reversal", "-(call25 - put25)"),
    "O16": ("crash_risk", "put5 - iv30"),
    "O17": ("call_share", "call_oi / nullif(call_oi + put_oi, 0)"),
    "O18": ("event_premium", "-(iv30 - event_free)"),
}


def _option(name: str) -> Query:
    return lambda s, d: rounded(O.signal(_options(s, d), name), TD, ["value"])


def option_sql(x: str) -> str:
    return f"WITH {S.MONTHLY}, {VOLS}, x AS (SELECT ticker, date, round(CAST({x} AS DOUBLE), 9) AS x FROM options) SELECT ticker, date, round({S.rank_pct('x')}, 6) + 0.0 AS value FROM x"


def bundle_sql(of: dict[str, str], base: str, source: str) -> str:
    raw = ", ".join(f"round(CAST({x} AS DOUBLE), 9) AS x_{n}" for n, x in of.items())
    return f"WITH {base}, x AS (SELECT ticker, date, {raw} FROM {source}) SELECT ticker, date, " + ", ".join(f"round({S.rank_pct(f'x_{n}')}, 6) + 0.0 AS {n}" for n in of) + " FROM x"


SERIES = {"a": "1-URGENT", "b": "2-HIGH"}
CALENDAR = """series AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
wide AS (SELECT date, max(CASE WHEN series_id = '1-URGENT' THEN value END) AS a, max(CASE WHEN series_id = '2-HIGH' THEN value END) AS b FROM series GROUP BY 1),
days AS (SELECT d.date, a, b FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN wide USING (date)),
cal AS (SELECT 0 AS ticker, date, last_value(a IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS a, last_value(b IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS b FROM days)"""


def _macro(op: Callable[..., DataFrame], values: list[str], **kwargs) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        bars = tables.bars(s, d).select(*TD, "ret")
        return rounded(op(bars, M.on_calendar(bars, tables.macro(s, d), SERIES), **kwargs), TD, values)

    return run


def macro_sql(steps: list[dict[str, str]], columns: list[str], value: str | None = None, window: int = 756, out: list[str] | None = None) -> str:
    """Calendar columns step by step, beside the bars; with ``value``, an expression over beta, its rank."""
    ctes, at = [S.DAILY, CALENDAR], "cal"
    for k, step in enumerate(steps):
        ctes.append(f"c{k} AS (SELECT *, " + ", ".join(f"{x} AS {n}" for n, x in step.items()) + f" FROM {at})")
        at = f"c{k}"
    ctes.append(f"j AS (SELECT b.ticker, b.date, b.ret, {', '.join(f'c.{c}' for c in columns)} FROM bars b JOIN {at} c ON b.date = c.date)")
    shown = ", ".join(out or [])
    if value is None:
        return f"WITH {', '.join(ctes)} SELECT ticker, date, " + S.rounded(*(out or [])) + " FROM j"
    ctes.append("p AS (SELECT *, ret * x AS xy FROM j)")
    cov = f"({S.avg('xy', window, 252)} - {S.avg('ret', window, 252)} * {S.avg('x', window, 252)})"
    ctes.append(f"q AS (SELECT *, {S.div(cov, S.var('x', window, 252))} AS beta FROM p)")
    ctes.append(f"r AS (SELECT *, round({value}, 9) AS y FROM q)")
    return f"WITH {', '.join(ctes)} SELECT ticker, date, {S.rounded(*out) + ', ' if shown else ''}round({S.rank_pct('y')}, 6) + 0.0 AS value FROM r"


def pct(x: str, n: int = 1) -> str:
    return f"({S.div(x, S.lag(x, n))} - 1)"


def sign(x: str) -> str:
    return f"coalesce(sign({x}), 0)"


PERCENTILE = f"list(a) OVER ({S.ORDER} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
RATIO = [{"ratio": S.div("a", "b")}, {"z": S.clip(S.div(f"ratio - {S.avg('ratio', 252, 63)}", S.std("ratio", 252, 63)), -4.0, 4.0), "roc": pct("ratio", 63), "x": pct("ratio")}]

STATEMENTS = """f0 AS (SELECT (o_custkey % (SELECT count(*) FROM supplier)) + 1 AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS revenue, CAST(count(*) AS DOUBLE) AS shares, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS issuance, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS debt_issued, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS debt_repaid,
    sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS gross_profit, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) AS sga, sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) AS rd, sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_totalprice END) AS dividends, sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS buybacks FROM orders GROUP BY 1, 2),
f1 AS (SELECT *, sum(revenue) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS assets FROM f0),
statements AS (SELECT *, assets * 0.4 + coalesce(debt_issued, 0) AS liabilities, assets * 0.5 - coalesce(rd, 0) AS equity, coalesce(gross_profit, 0) - coalesce(sga, 0) / 2 AS net_income, revenue / 10 AS operating_cf, coalesce(sga, 0) / 5 AS taxes, revenue / 20 AS interest, assets / 8 AS cash FROM f1),
held AS (SELECT b.ticker, b.date, b.close, b.volume, b.ret, s.* EXCLUDE (ticker, date), b.close * s.shares AS me FROM bars b ASOF LEFT JOIN statements s ON b.ticker = s.ticker AND b.date >= s.date)"""
PAID, RAISED = "coalesce(dividends, 0) + coalesce(buybacks, 0)", "coalesce(issuance, 0) - coalesce(dividends, 0) - coalesce(buybacks, 0) + coalesce(debt_issued, 0) - coalesce(debt_repaid, 0)"
EQUITY, DEBT = "greatest(me, 1e-6)", "greatest(coalesce(liabilities, 0) - 0.5 * coalesce(debt_issued, 0), 1e-6)"
VOL = f"({S.std('ret', 12, 3)} * sqrt(252))"
ASSET_VOL = f"({EQUITY} / ({EQUITY} + {DEBT}) * {VOL} + {DEBT} / ({EQUITY} + {DEBT}) * (0.05 + 0.25 * {VOL}))"
DTD = f"CASE WHEN me IS NOT NULL THEN (ln(({EQUITY} + {DEBT}) / {DEBT}) + ln(close / nullif({S.lag('close', 12)}, 0)) - 0.5 * pow({ASSET_VOL}, 2)) / nullif({ASSET_VOL}, 0) END"
FUNDAMENTALS = {
    "F4_altman": ("altman", S.clip("(1.2 * (assets - liabilities) / nullif(assets, 0) + 1.4 * equity / nullif(assets, 0) + 3.3 * (coalesce(net_income, 0) + coalesce(interest, 0)) / nullif(assets, 0) + 0.6 * me / nullif(liabilities, 0) + revenue / nullif(assets, 0))", -20.0, 20.0)),
    "F6_payout": ("payout", S.clip(f"(({PAID}) / nullif({S.lag('me', 6)}, 0))", -1.0, 5.0)),
    "F7_net_payout": ("net_payout", S.clip(f"(({PAID} - coalesce(issuance, 0)) / nullif({S.lag('me', 6)}, 0))", -1.0, 5.0)),
    "F8_external_financing": ("external_financing", "-" + S.clip(f"(({RAISED}) / nullif(assets, 0))", -2.0, 2.0)),
    "F9_cash_flow_yield": ("cash_flow_yield", S.clip("(operating_cf / nullif(me, 0))", -5.0, 5.0)),
    "F10_research_adjusted_profit": ("research_adjusted_profit", S.clip("((gross_profit - coalesce(sga, 0) + coalesce(rd, 0)) / nullif(assets, 0))", -2.0, 5.0)),
    "F11_tax_share": ("tax_share", S.clip("(taxes / nullif(0.21 * net_income, 0))", -2.0, 5.0)),
    "F3_distance_to_default": ("distance_to_default", DTD),
}
DISTRESS = f"""WITH {S.MONTHLY}, {STATEMENTS}, a AS (SELECT *, row_number() OVER ({S.ORDER}) AS rn, me + liabilities AS mta, coalesce(avg(ret) OVER (PARTITION BY date), 0) AS mkt, sum(me) OVER (PARTITION BY date) AS total FROM held),
b AS (SELECT *, net_income / nullif(mta, 0) AS ni, ret - mkt AS ex FROM a),
c AS (SELECT *, CASE WHEN count(ex) OVER ({S.ORDER} ROWS UNBOUNDED PRECEDING) >= 3 THEN {S.ewm('ex', 1 - 0.5 ** (1 / 3), True)} END AS excess FROM b),
d AS (SELECT ticker, date, round(-9.164 - 20.264 * {S.avg('ni', 12, 3)} + 1.416 * liabilities / nullif(mta, 0) - 7.129 * excess + 1.411 * {S.std('ret', 3, 2)} * sqrt(252) - 0.045 * ln(me / nullif(total, 0)) - 2.132 * coalesce(cash, 0) / nullif(mta, 0) + 0.075 * {S.clip('(me / nullif(equity, 0))', -50.0, 50.0)} - 0.058 * ln(least(close, 15)), 9) AS x FROM c)
SELECT ticker, date, round({S.rank_pct('x')}, 6) + 0.0 AS value FROM d"""


def held(s: SparkSession, d: str) -> DataFrame:
    """Monthly bars with the last statement of the ticker that was known."""
    f = tables.fundamentals(s, d)
    items = [c for c in f.columns if c not in TD]
    one = J.as_of(tables.bars(s, d, True), f.select(*TD, F.struct(*items).alias("items")), "items")
    return one.select(*TD, "close", "volume", "ret", *[F.col(f"items.{c}").alias(c) for c in items])


def _fundamental(name: str) -> Query:
    return lambda s, d: rounded(D.signal(held(s, d), name), TD, ["value"])


def held_sql(x: str) -> str:
    return f"WITH {S.MONTHLY}, {STATEMENTS}, x AS (SELECT ticker, date, round(CAST({x} AS DOUBLE), 9) AS x FROM held) SELECT ticker, date, round({S.rank_pct('x')}, 6) + 0.0 AS value FROM x"


def _sector_spread(s: SparkSession, d: str) -> DataFrame:
    bars = tables.bars(s, d)
    out = M.sector_spread(bars, tables.sectors(s, d), M.on_calendar(bars, tables.macro(s, d), SERIES), ["ASIA", "AFRICA"])
    return rounded(out, TD, ["value"])


SHORT = "(volume / nullif(shares, 0))"
TABLE: dict[str, tuple[Query, str]] = {
    **{f"{k}_{name}": (_option(name), option_sql(x)) for k, (name, x) in OPTIONS.items()},
    "O19_option_bundle": (
        lambda s, d: rounded(O.signals(_options(s, d), [n for n, _ in OPTIONS.values()]), TD, [n for n, _ in OPTIONS.values()]),
        bundle_sql(dict(OPTIONS.values()), f"{S.MONTHLY}, {VOLS}", "options"),
    ),
    "M2_volatility_features": (
        _macro(M.volatility_features, ["term_slope", "percentile", "change_5d"]),
        macro_sql([{"f": PERCENTILE, "term_slope": f"{S.div('b', 'a')} - 1", "change_5d": pct("a", 5)}, {"percentile": "len(list_filter(f, lambda v: v <= a)) / nullif(len(list_filter(f, lambda v: v IS NOT NULL)), 0)"}], ["term_slope", "percentile", "change_5d"], out=["term_slope", "percentile", "change_5d"]),
    ),
    "M3_currency_regime": (_macro(M.currency_regime, ["value"]), macro_sql([{"x": pct("a"), "sg": sign(pct("a", 63))}], ["x", "sg"], "-beta * sg")),
    "M5_ratio_regime": (_macro(M.ratio_regime, ["z", "roc", "value"]), macro_sql(RATIO, ["z", "roc", "x"], "beta", 1260, ["z", "roc"])),
    "M6_spread_beta": (_macro(M.spread_beta, ["value"]), macro_sql([{"gap": "a - b"}, {"x": f"gap - {S.lag('gap')}"}], ["x"], "beta")),
    "M7_year_momentum": (_macro(M.year_momentum, ["mom_a", "mom_b"], columns=["a", "b"]), macro_sql([{"mom_a": S.momentum("a", 231, 21), "mom_b": S.momentum("b", 231, 21)}], ["mom_a", "mom_b"], out=["mom_a", "mom_b"])),
    "M8_signed_beta": (_macro(M.signed_beta, ["value"]), macro_sql([{"x": f"a - {S.lag('a')}"}, {"sg": sign("x")}], ["x", "sg"], "beta * sg", 1260)),
    "M9_momentum_beta": (_macro(M.momentum_beta, ["value"]), macro_sql([{"x": pct("a"), "sg": sign(pct("a", 21))}], ["x", "sg"], "beta * sg", 1260)),
    "M10_ratio_change": (_macro(M.ratio_change, ["ratio", "ratio_5d"]), macro_sql([{"ratio": S.div("a", "b")}, {"ratio_5d": f"ratio - {S.lag('ratio', 5)}"}], ["ratio", "ratio_5d"], out=["ratio", "ratio_5d"])),
    "M11_sector_spread": (
        _sector_spread,
        f"WITH {S.DAILY}, {S.SECTORS}, {CALENDAR}, c AS (SELECT date, -(a - {S.lag('a', 21)}) AS fa, -(b - {S.lag('b', 21)}) AS fb FROM cal), x AS (SELECT b.ticker, b.date, round(CASE WHEN sector IN ('ASIA', 'AFRICA') THEN fa ELSE fb END, 9) AS x FROM bars b JOIN c ON b.date = c.date JOIN sectors s ON b.ticker = s.ticker) SELECT ticker, date, round({S.rank_pct('x')}, 6) + 0.0 AS value FROM x",
    ),
    "M12_difference_beta": (_macro(M.difference_beta, ["value"]), macro_sql([{"x": f"a - {S.lag('a')}"}], ["x"], "beta")),
    **{k: (_fundamental(name), held_sql(x)) for k, (name, x) in FUNDAMENTALS.items()},
    "F2_distress": (lambda s, d: rounded(D.distress(held(s, d)), TD, ["value"]), DISTRESS),
    "F13_accounting_bundle": (
        lambda s, d: rounded(D.signals(held(s, d), [n for n, _ in FUNDAMENTALS.values()]), TD, [n for n, _ in FUNDAMENTALS.values()]),
        bundle_sql(dict(FUNDAMENTALS.values()), f"{S.MONTHLY}, {STATEMENTS}", "held"),
    ),
    "F20_short_interest_change": (lambda s, d: rounded(D.short_interest(held(s, d), "volume", "shares", 3), TD, ["value"]), held_sql(f"-({SHORT} - lag({SHORT}, 3) OVER ({S.ORDER}))")),
    "F21_short_interest_level": (lambda s, d: rounded(D.short_interest(held(s, d), "volume", "shares"), TD, ["value"]), held_sql(f"-{SHORT}")),
}

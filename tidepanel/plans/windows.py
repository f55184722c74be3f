"""Queries of the time-window signals and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import windows as W
from tidepanel.plans import sql as S
from tidepanel.sources import tables

Query = Callable[[SparkSession, str], DataFrame]


def panel(op: Callable[..., DataFrame], month: bool = False, with_sectors: bool = False, **kwargs) -> Query:
    """Apply an operator to the bars and return its rounded value by ticker and date."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = tables.bars(spark, sf_dir, month)
        out = op(bars, tables.sectors(spark, sf_dir), **kwargs) if with_sectors else op(bars, **kwargs)
        return out.select("ticker", "date", (F.round("value", 6) + 0.0).alias("value"))

    return run


MKT = {"mkt": "avg(ret) OVER (PARTITION BY date)"}
EXC = {"excess": "ret - mkt"}
RN = {"rn": f"row_number() OVER ({S.ORDER})"}
H = f"OVER ({S.ORDER} ROWS UNBOUNDED PRECEDING)"


def _spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.spells(W.trend_regime(tables.bars(spark, sf_dir), 40))
    return out.select("ticker", F.col("value").cast("long").alias("state"), "first_date", "last_date", F.col("length").cast("long").alias("length"))


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.semi_betas(tables.bars(spark, sf_dir))
    return out.select("ticker", "date", *[(F.round(c, 6) + 0.0).alias(c) for c in ("beta_n", "beta_p", "beta_mn", "beta_mp")])



LOCAL = "PARTITION BY date, sector"
TABLE: dict[str, tuple[Query, str]] = {
    "W1_momentum": (panel(W.momentum_signal), S.query({"value": S.momentum("close", 21)})),
    "W2_short_momentum": (panel(W.short_momentum), S.query({"value": f"({S.momentum('close', 5)} + {S.momentum('close', 10)} + {S.momentum('close', 21)}) / 3"})),
    "W3_long_momentum": (panel(W.long_momentum), S.query({"value": f"({S.momentum('close', 63, 21)} + {S.momentum('close', 126, 21)}) / 2"})),
    "W4_zscore_reversion": (panel(W.zscore_reversion), S.query({"value": "-" + S.div(f"close - {S.avg('close', 20)}", S.std("close", 20))})),
    "W5_rolling_rank": (
        panel(W.rolling_rank, lookback=60, least=20),
        S.query({"f": f"list(close) OVER ({S.ORDER} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"}, {"value": "CASE WHEN len(f) >= 20 THEN (len(list_filter(f, lambda x: x < close)) + (len(list_filter(f, lambda x: x = close)) + 1) / 2.0) / len(f) END"}),
    ),
    "W6_rsi": (
        panel(W.rsi),
        S.query(
            {**RN, "d": f"close - {S.lag('close')}"},
            {"g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "rn0": "2", "seen": f"count(d) {H}"},
            {"eg": S.ewm("g", 1 / 14, False), "el": S.ewm("l", 1 / 14, False)},
            {"value": "CASE WHEN seen >= 14 THEN 50 - (100 - 100 / (1 + eg / nullif(el, 0))) END"},
        ),
    ),
    "W7_macd": (
        panel(W.macd),
        S.query({**RN, "rn0": "1"}, {"m": f"{S.ewm('close', 2 / 13, False)} - {S.ewm('close', 2 / 27, False)}"}, {"value": f"m - {S.ewm('m', 2 / 10, False)}"}),
    ),
    "W8_ema_smooth": (panel(W.ema_smooth), S.query(RN, {"value": S.ewm("ret", 1 - 0.5 ** (1 / 5.0), True)})),
    "W9_fill_forward": (
        panel(lambda b: W.fill_forward(b.withColumn("x", F.when(F.col("volume") > 60, F.col("close"))), "x", 3)),
        S.query({"x": "CASE WHEN volume > 60 THEN close END"}, {"value": f"last_value(x IGNORE NULLS) OVER ({S.ORDER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"}),
    ),
    "W10_mean_reversion": (
        panel(W.mean_reversion),
        S.query(
            {**RN, "d": f"close - {S.lag('close')}", "z": "-" + S.div(f"close - {S.avg('close', 20)}", S.std("close", 20))},
            {"g": "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", "l": "CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END", "rn0": "2", "seen": f"count(d) {H}"},
            {"eg": S.ewm("g", 1 / 14, False), "el": S.ewm("l", 1 / 14, False)},
            {"r": "CASE WHEN seen >= 14 THEN 50 - (100 - 100 / (1 + eg / nullif(el, 0))) END"},
            {"value": f"({S.rank_pct('z')} + {S.rank_pct('r')}) / 2"},
        ),
    ),
    "W11_realized_volatility": (panel(W.realized_volatility), S.query({"value": f"{S.std('ret', 21)} * sqrt(252)"})),
    "W12_volatility_regime": (panel(W.volatility_regime), S.query({"value": "-" + S.div(S.std("ret", 10), S.std("ret", 60))})),
    "W13_price_to_high": (panel(W.price_to_high), S.query({"p": S.lag("close")}, {"value": S.div("p", S.roll("max({})", "p", 252))})),
    "W14_max_return": (panel(W.max_return), S.query({"r0": f"{S.div('close', S.lag('close'))} - 1"}, {"r": S.lag("r0")}, {"value": "-" + S.roll("max({})", "r", 21)})),
    "W15_amihud": (panel(lambda b: W.amihud(b).withColumn("value", F.col("value") * 1e6)), S.query({"i": S.div("abs(ret)", "close * volume")}, {"value": f"{S.avg('i', 21)} * 1e6"})),
    "W16_idiosyncratic_volatility": (panel(W.idiosyncratic_volatility), S.query(MKT, EXC, {"value": "-" + S.std("excess", 21)})),
    "W17_volume_spike": (panel(W.volume_spike), S.query({"value": S.div("volume", S.avg("volume", 20))})),
    "W18_volume_price_trend": (
        panel(W.volume_price_trend),
        S.query({"v": f"({S.div('close', S.lag('close'))} - 1) * volume"}, {"t": S.total("v", 20)}, {"value": S.div(f"t - {S.avg('t', 60, 20)}", S.std("t", 60, 20))}),
    ),
    "W19_market_beta": (
        panel(W.market_beta),
        S.query(MKT, {"xy": "ret * mkt"}, {"value": "-" + S.div(f"{S.avg('xy', 63)} - {S.avg('ret', 63)} * {S.avg('mkt', 63)}", S.var("mkt", 63))}),
    ),
    "W20_obv": (
        panel(W.obv),
        S.query({"s": "coalesce(sign(ret) * volume, 0)"}, {"o": f"sum(s) {H}"}, {"value": S.div(f"o - {S.avg('o', 60, 20)}", S.std("o", 60, 20))}),
    ),
    "W21_bollinger": (panel(W.bollinger), S.query({"value": "-" + S.div(f"close - ({S.avg('close', 20)} - 2 * {S.std('close', 20)})", f"4 * {S.std('close', 20)}")})),
    "W22_residual_momentum": (panel(W.residual_momentum), S.query(MKT, EXC, {"x": S.lag("excess")}, {"value": S.total("x", 21)})),
    "W23_price_acceleration": (panel(W.price_acceleration), S.query({"value": f"{S.momentum('close', 21)} - {S.momentum('close', 21, 22)}"})),
    "W24_volume_trend": (
        panel(W.volume_trend),
        S.query({"m": S.avg("volume", 21)}, {"g": f"{S.div('m', S.lag('m', 21))} - 1"}, {"value": S.div(f"g - {S.avg('g', 63, 21)}", S.std("g", 63, 21))}),
    ),
    "W25_efficiency_ratio": (panel(W.efficiency_ratio), S.query({"d": f"abs(close - {S.lag('close')})"}, {"value": S.div(f"abs(close - {S.lag('close', 21)})", S.total("d", 21))})),
    "W26_ma_distance": (panel(W.ma_distance), S.query({"value": "-" + S.div(f"close - {S.avg('close', 50)}", S.avg("close", 50))})),
    "W27_vol_of_vol": (panel(W.vol_of_vol), S.query({"v": S.std("ret", 5)}, {"value": "-" + S.std("v", 21)})),
    "W28_tail_risk": (panel(W.tail_risk), S.query({"r": S.lag("ret")}, {"value": "-" + S.roll("quantile_cont({}, 0.05)", "r", 21)})),
    "W29_short_reversal": (panel(W.short_reversal), S.query({"r": S.lag("ret")}, {"value": "-" + S.total("r", 5, 1)})),
    "W30_volume_reversal": (panel(W.volume_reversal), S.query({"a": S.avg("volume", 20)}, {"value": f"-{S.lag('ret')} * " + S.clip(S.div(S.lag("volume"), S.lag("a")), 0.5, 3.0)})),
    "W31_sector_relative_momentum": (
        panel(W.sector_relative_momentum, with_sectors=True),
        S.query(
            "SELECT b.*, s.sector, n FROM {at} b JOIN sectors s USING (ticker) JOIN (SELECT sector, count(*) AS n FROM sectors GROUP BY sector) USING (sector)",
            {"r": S.lag("ret")},
            {"sm": f"avg(r) OVER ({LOCAL})"},
            {"value": f"CASE WHEN n >= 3 THEN {S.total('r', 63)} - {S.total('sm', 63)} ELSE {S.total('r', 63)} END"},
            extra=S.SECTORS,
        ),
    ),
    "W32_hurst": (
        panel(W.hurst),
        S.query(
            {"l": f"ln(close / {S.lag('close')})"},
            {"a": S.total("l", 10, 10)},
            {"q": S.div(S.var("a", 63), f"10 * {S.var('l', 63)}")},
            {"value": "CASE WHEN q IS NOT NULL THEN greatest(0, least(1, 0.5 * log2(greatest(q, 1e-6)))) END"},
        ),
    ),
    "W34_realized_skewness": (panel(W.realized_skewness), S.query({"r2": "ret ** 2", "r3": "ret ** 3"}, {"value": "-" + S.div(S.avg("r3", 21), f"pow({S.avg('r2', 21)}, 1.5)")})),
    "W35_coskewness": (
        panel(W.coskewness),
        S.query(MKT, {"e": f"ret - {S.avg('ret', 126)}", "d": f"mkt - {S.avg('mkt', 126)}"}, {"x": "e * d ** 2"}, {"value": "-" + S.div(S.avg("x", 126), f"({S.std('ret', 126)} * {S.var('mkt', 126)})")}),
    ),
    "W36_semi_betas": (
        _semi,
        S.query(
            MKT,
            {"n": "CASE WHEN ret IS NOT NULL THEN least(ret, 0) * least(mkt, 0) END", "p": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0) * greatest(mkt, 0) END", "mn": "CASE WHEN ret IS NOT NULL THEN -least(ret, 0) * greatest(mkt, 0) END", "mp": "CASE WHEN ret IS NOT NULL THEN -greatest(ret, 0) * least(mkt, 0) END", "m2": "CASE WHEN ret IS NOT NULL THEN mkt ** 2 END"},
            {f"beta_{k}": S.div(S.total(k, 126), S.total("m2", 126)) for k in ("n", "p", "mn", "mp")},
            final="SELECT ticker, date, " + S.rounded("beta_n", "beta_p", "beta_mn", "beta_mp") + " FROM {at}",
        ),
    ),
    "W37_tail_dependence": (
        panel(W.tail_dependence),
        S.query(MKT, {"i": S.roll("quantile_cont({}, 0.1)", "ret", 126), "m": S.roll("quantile_cont({}, 0.1)", "mkt", 126)}, {"j": "CASE WHEN ret <= i AND mkt <= m THEN 1.0 ELSE 0.0 END"}, {"value": f"{S.total('j', 126)} / 12.6"}),
    ),
    "W38_signed_jumps": (
        panel(W.signed_jumps, threshold=2.0),
        S.query({"s": S.std("ret", 21)}, {"j": "CASE WHEN ret IS NOT NULL THEN CASE WHEN abs(ret) > 2 * s THEN sign(ret) * ret ** 2 ELSE 0 END END"}, {"value": S.total("j", 21)}),
    ),
    "W39_down_up_ratio": (
        panel(W.down_up_ratio),
        S.query({"d": "CASE WHEN ret < 0 THEN ret ** 2 WHEN ret IS NOT NULL THEN 0 END", "u": "CASE WHEN ret > 0 THEN ret ** 2 WHEN ret IS NOT NULL THEN 0 END"}, {"value": S.div(f"sqrt({S.total('d', 63)})", f"sqrt({S.total('u', 63)})")}),
    ),
    "W41_lottery": (
        panel(W.lottery),
        S.query(MKT, EXC, {"e2": "excess ** 2", "e3": "excess ** 3"}, {"v": S.std("excess", 21), "k": S.div(S.avg("e3", 21), f"pow({S.avg('e2', 21)}, 1.5)")}, {"value": f"-({S.zscore('v', None)} + {S.zscore('k', None)} - {S.zscore('close', None)})"}),
    ),
    "W44_rolling_beta": (
        panel(W.rolling_covariance_beta),
        S.query(MKT, {"m": "CASE WHEN ret IS NOT NULL THEN mkt END"}, {"value": S.roll("covar_samp({}, mkt)", "ret", 126, 60) + f" / nullif({S.var('m', 126, 1)}, 0)"}),
    ),
    "W45_factor_momentum": (
        panel(W.factor_momentum, lookback=84),
        S.query({"l": "ln(1 + CASE WHEN ret > -1 THEN ret END)"}, {"s": S.total("l", 63, 63)}, {"value": f"exp({S.lag('s', 21)}) - 1"}),
    ),
    "W49_trend_regime": (panel(W.trend_regime), S.query({"m": S.avg("close", 200, 100)}, {"value": "CASE WHEN m IS NULL THEN 0 WHEN close > m THEN 1 ELSE -1 END"})),
    "W51_spells": (
        _spells,
        S.query(
            {"m": S.avg("close", 40, 20)},
            {"state": "CASE WHEN m IS NULL THEN 0 WHEN close > m THEN 1 ELSE -1 END"},
            {"new": f"CASE WHEN state IS NOT DISTINCT FROM {S.lag('state')} THEN 0 ELSE 1 END"},
            {"run": f"sum(new) {H}"},
            final="SELECT ticker, CAST(state AS BIGINT) AS state, min(date) AS first_date, max(date) AS last_date, count(*) AS length FROM {at} GROUP BY ticker, run, state",
        ),
    ),
    "W52_drawdown": (panel(W.drawdown), S.query({"value": f"close / nullif(max(close) {H}, 0) - 1"})),
    "W54_rolling_sharpe": (panel(W.rolling_sharpe), S.query({"value": f"{S.div(S.avg('ret', 126, 126), S.std('ret', 126, 126))} * sqrt(252)"})),
    "W56_wealth": (
        panel(lambda b: W.wealth(b, 1.0).withColumn("value", F.ln("value"))),
        S.query({"g": "ln(1 + greatest(coalesce(ret, 0), -0.999999))"}, {"value": f"sum(g) {H}"}),
    ),
    "W57_change_rank": (panel(W.change_rank), S.query({"c": f"round(ln(1 + volume) - ln(1 + {S.lag('volume', 5)}), 9)"}, {"value": S.rank_pct("c")})),
    "W59_momentum_rank": (panel(W.momentum_rank), S.query({"m": S.momentum("close", 231, 21)}, {"value": S.rank_pct("m")})),
    "W60_leave_one_out_sector": (
        panel(W.leave_one_out_sector, with_sectors=True),
        S.query("SELECT b.*, s.sector FROM {at} b JOIN sectors s USING (ticker)", {"s": S.total("ret", 63)}, {"value": f"(sum(s) OVER ({LOCAL}) - s) / nullif(count(s) OVER ({LOCAL}) - 1, 0)"}, extra=S.SECTORS),
    ),
    "W63_month_season": (
        panel(W.month_season, month=True),
        S.query(
            {f"p{k}": S.lag("ret", 12 * k) for k in range(1, 5)},
            {"n": " + ".join(f"CASE WHEN p{k} IS NULL THEN 0 ELSE 1 END" for k in range(1, 5))},
            {"value": "CASE WHEN n >= 2 THEN (" + " + ".join(f"coalesce(p{k}, 0)" for k in range(1, 5)) + ") / n END"},
            base=S.MONTHLY,
        ),
    ),
    "W66_forward_return": (
        panel(W.forward_return),
        S.query({"value": f"CASE WHEN count(ret) OVER ({S.ORDER} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN sum(ret) OVER ({S.ORDER} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END"}),
    ),
    "W67_dollar_volume": (panel(W.dollar_volume), S.query({"d": "close * volume"}, {"value": S.avg("d", 30, 10)})),
}

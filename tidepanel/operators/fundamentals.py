"""Signals from statements as of the date: ``(ticker, date, close, ret, assets, ...)``, ranked on the date.

``year`` and ``half`` are rows of the panel; a null item of a sum counts as nothing where the definition says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.columns import TRADING_DAYS, by_date, by_ticker, clip, div, lag, mean, rank_pct, std
from tidepanel.functions.linear_time import with_ewm, with_ranks


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def with_market_value(panel: DataFrame) -> DataFrame:
    return panel.withColumn("me", F.col("close") * F.col("shares"))


def altman() -> Column:
    # fixed values of the score
    parts = {1.2: div(F.col("assets") - F.col("liabilities"), "assets"), 1.4: div("equity", "assets"), 3.3: div(zero("net_income") + zero("interest"), "assets"), 0.6: div("me", "liabilities"), 1.0: div("revenue", "assets")}
    return clip(sum((w * x for w, x in parts.items()), F.lit(0.0)), -20.0, 20.0)


def payout(half: int = 6) -> Column:
    return clip(div(zero("dividends") + zero("buybacks"), lag("me", half)), -1.0, 5.0)


def net_payout(half: int = 6) -> Column:
    return clip(div(zero("dividends") + zero("buybacks") - zero("issuance"), lag("me", half)), -1.0, 5.0)


def external_financing() -> Column:
    raised = zero("issuance") - zero("dividends") - zero("buybacks") + zero("debt_issued") - zero("debt_repaid")
    return -clip(div(raised, "assets"), -2.0, 2.0)


def cash_flow_yield() -> Column:
    return clip(div("operating_cf", "me"), -5.0, 5.0)


def research_adjusted_profit() -> Column:
    cost = F.col("revenue") - F.col("gross_profit")
    return clip(div(F.col("revenue") - cost - (zero("sga") - zero("rd")), "assets"), -2.0, 5.0)


def tax_share(rate: float = 0.21) -> Column:
    return clip(div("taxes", rate * F.col("net_income")), -2.0, 5.0)


def distance_to_default(year: int = 12, least: int = 3, periods: int = TRADING_DAYS) -> Column:
    """Naive distance: log assets over debt and last year's drift, in asset volatilities."""
    equity, debt = F.greatest(F.col("me"), F.lit(1e-6)), F.greatest(zero("liabilities") - 0.5 * zero("debt_issued"), F.lit(1e-6))
    whole = equity + debt
    vol = std("ret", year, least) * F.sqrt(F.lit(float(periods)))
    asset_vol = equity / whole * vol + debt / whole * (0.05 + 0.25 * vol)
    drift = F.ln(div("close", lag("close", year)))
    return F.when(F.col("me").isNotNull(), div(F.ln(whole / debt) + drift - 0.5 * asset_vol**2, asset_vol))


#: Name to the value whose rank is the signal, for panels with ``me``.
SIGNALS: dict[str, Callable[[], Column]] = {
    "altman": altman,
    "payout": payout,
    "net_payout": net_payout,
    "external_financing": external_financing,
    "cash_flow_yield": cash_flow_yield,
    "research_adjusted_profit": research_adjusted_profit,
    "tax_share": tax_share,
    "distance_to_default": distance_to_default,
}


def signal(panel: DataFrame, name: str) -> DataFrame:
    b = with_market_value(panel).withColumn("_x", F.round(SIGNALS[name](), 9))
    return with_ranks(b, {"value": "_x"}, kept=[c for c in b.columns if c not in ("_x", "value")])


def signals(panel: DataFrame, names: list[str]) -> DataFrame:
    raw = with_market_value(panel).withColumns({f"_{n}": F.round(SIGNALS[n](), 9) for n in names})
    return with_ranks(raw, {n: f"_{n}" for n in names}, kept=["ticker", "date"])


def distress(panel: DataFrame, year: int = 12, quarter: int = 3, least: int = 3, periods: int = TRADING_DAYS) -> DataFrame:
    """Distress probability score of eight variables, ranked; high is distressed."""
    b = with_market_value(panel)
    b = b.withColumns({"_mta": F.col("me") + F.col("liabilities"), "_mkt": F.coalesce(F.avg("ret").over(by_date()), F.lit(0.0)), "_all": F.sum("me").over(by_date())})
    b = b.withColumns({"_ni": div("net_income", "_mta"), "_ex": F.col("ret") - F.col("_mkt")})
    b = with_ewm(b, {"_smooth": ("_ex", 1 - 0.5 ** (1 / quarter), True)})
    excess = F.when(F.count("_ex").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) >= quarter, F.col("_smooth"))
    # fixed values of the score
    score = (
        F.lit(-9.164) - 20.264 * mean("_ni", year, least) + 1.416 * div("liabilities", "_mta") - 7.129 * excess + 1.411 * std("ret", quarter, 2) * F.sqrt(F.lit(float(periods)))
        - 0.045 * F.ln(div("me", "_all")) - 2.132 * div(zero("cash"), "_mta") + 0.075 * clip(div("me", "equity"), -50.0, 50.0) - 0.058 * F.ln(F.least(F.col("close"), F.lit(15.0)))
    )
    return b.withColumn("_x", F.round(score, 9)).withColumn("value", rank_pct("_x")).select(*panel.columns, "value")


def short_interest(panel: DataFrame, shorted: str, outstanding: str, lookback: int | None = None) -> DataFrame:
    """Negative rank of shares sold short over shares outstanding, or of that ratio's difference over ``lookback`` rows."""
    b = panel.withColumn("_r", div(shorted, outstanding))
    x = F.col("_r") if lookback is None else F.col("_r") - lag("_r", lookback)
    return b.withColumn("_x", F.round(-x, 9)).withColumn("value", rank_pct("_x")).drop("_r", "_x")

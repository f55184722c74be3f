"""Tax lots: which bought shares each sale takes, what it realises, and what stays open."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.finance import defer_sale

#: Tax rates of gains held up to a year and longer: federal, investment and state tax of a usual case.
SHORT_RATE, LONG_RATE = 0.328, 0.188
#: A lot is long-term once held more days than this.
YEAR_DAYS = 365
#: A ticker sold at a loss is not to be bought again for so many days.
WASH_DAYS = 31
#: Fewer shares than this count as none.
DUST = 1e-8
MATCH_SCHEMA = "account {account}, ticker {ticker}, lot_id long, bought date, cost double, sale_id long, sold date, price double, qty double, gain double, long_term boolean"


@dataclass
class Lots:
    """The open lots of one account's ticker, in order of purchase."""

    ids: list[int] = field(default_factory=list)
    days: list[int] = field(default_factory=list)
    costs: list[float] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)

    def buy(self, lot_id: int, day: int, price: float, qty: float) -> None:
        self.ids.append(lot_id)
        self.days.append(day)
        self.costs.append(price)
        self.shares.append(qty)

    def sell(self, day: int, price: float, qty: float, short_rate: float, long_rate: float) -> Iterator[tuple[int, int, float, float, bool]]:
        """``(lot_id, bought, cost, shares, long_term)`` of the lots that the sale takes, the one whose whole sale would cost the least tax first."""
        cost, held = np.array(self.costs), np.array(self.shares)
        long_term = day - np.array(self.days, np.int64) > YEAR_DAYS
        tax = (price - cost) * held * np.where(long_term, long_rate, short_rate)
        left = qty
        for k in np.argsort(tax, kind="stable").tolist():
            if left <= DUST:
                break
            take = min(self.shares[k], left)
            left -= take
            self.shares[k] -= take
            yield self.ids[k], self.days[k], self.costs[k], take, bool(long_term[k])
        kept = [k for k, s in enumerate(self.shares) if s >= DUST]
        if len(kept) < len(self.ids):
            for name in ("ids", "days", "costs", "shares"):
                old = getattr(self, name)
                setattr(self, name, [old[k] for k in kept])


def match_lots(fills: DataFrame, short_rate: float = SHORT_RATE, long_rate: float = LONG_RATE) -> DataFrame:
    """``(account, ticker, lot_id, bought, cost, sale_id, sold, price, qty, gain, long_term)``: one row per sale and lot it takes from, and one with null ``sale_id`` per lot that stays open.

    ``fills(account, ticker, date, fill_id, side, qty, price)``. The fills of an account's ticker are taken in order of
    date and id. A BUY opens a lot; a SELL takes shares from the open lots, the lot with the least tax first (losses
    before gains, those at the higher rate first), the older of equals. ``gain`` of an open lot is null.

    A sale of more than is held takes what is held, and the rest is ignored, as is one without lots. Fills with a null
    or non-positive quantity or price, a null date or another side are left out; null accounts and tickers are a
    group each. Two fills with the same date and id are taken in order of side, quantity and price. An empty table
    gives an empty result; other columns are not read.

    Rows are dealt by account and ticker and sorted within a task, which reads them as a stream: it holds the open
    lots of one account's ticker, never the history.
    """
    ok = F.col("side").isin("BUY", "SELL") & (F.col("qty") > 0) & (F.col("price") > 0) & F.col("date").isNotNull()
    rows = fills.filter(ok).select("account", "ticker", F.col("date").cast("date").alias("date"), F.col("fill_id").cast("long").alias("fill_id"), (F.col("side") == "BUY").alias("buy"), F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    order = rows.repartition("account", "ticker").sortWithinPartitions("account", "ticker", "date", "fill_id", F.desc("buy"), "qty", "price")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("account", "ticker")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lots = None, Lots()
        types = None
        out: list[tuple] = []

        def still_open() -> None:
            if key is not None:
                out.extend((*key, i, d, c, None, None, None, s, None, None) for i, d, c, s in zip(lots.ids, lots.days, lots.costs, lots.shares, strict=True))

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, list(types))

        for b in batches:
            if types is None:
                days, ids, real = pa.date32(), pa.int64(), pa.float64()
                types = {"account": b.schema.field(0).type, "ticker": b.schema.field(1).type, "lot_id": ids, "bought": days, "cost": real, "sale_id": ids, "sold": days, "price": real, "qty": real, "gain": real, "long_term": pa.bool_()}
            account, ticker = b.column(0).to_pylist(), b.column(1).to_pylist()
            day, fill, buy, qty, price = (b.column(2).cast(pa.int32()).to_pylist(), *(b.column(k).to_pylist() for k in (3, 4, 5, 6)))
            for k in range(b.num_rows):
                if key != (account[k], ticker[k]):
                    still_open()
                    key, lots = (account[k], ticker[k]), Lots()
                if buy[k]:
                    lots.buy(fill[k], day[k], price[k], qty[k])
                else:
                    for i, d, c, s, is_long in lots.sell(day[k], price[k], qty[k], short_rate, long_rate):
                        out.append((*key, i, d, c, fill[k], day[k], price[k], s, (price[k] - c) * s, is_long))
                if len(out) >= 4096:
                    yield batch_of()
        still_open()
        if out:
            yield batch_of()

    return order.mapInArrow(run, MATCH_SCHEMA.format(**kinds))


def sales(matches: DataFrame) -> DataFrame:
    """One row per sale that took shares: quantity, gain at either rate, number of lots, and the day until which a loss bars a new purchase."""
    short = F.coalesce(F.sum(F.when(~F.col("long_term"), F.col("gain"))), F.lit(0.0))
    long = F.coalesce(F.sum(F.when(F.col("long_term"), F.col("gain"))), F.lit(0.0))
    per = matches.filter("sale_id is not null").groupBy("account", "ticker", "sale_id", "sold").agg(F.sum("qty").alias("qty"), short.alias("short_gain"), long.alias("long_gain"), F.count("*").alias("lots"))
    return per.withColumn("gain", F.col("short_gain") + F.col("long_gain")).withColumn("barred_until", F.when(F.col("gain") < 0, F.date_add("sold", WASH_DAYS)))


def positions(matches: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """Open lots by account and ticker at ``prices(ticker, price)``: shares, cost, value, gain, whether a short-term lot stands at a loss, days until the first lot is long-term, lots of either kind, and whether a loss bars a purchase.

    Tickers without a price are left out. Days are negative for lots that are long-term already, 999 at most.
    """
    held = F.datediff(as_of, F.col("bought"))
    lots = matches.filter("sale_id is null").join(prices.select("ticker", F.col("price").alias("now")), "ticker")
    gain = (F.col("now") - F.col("cost")) * F.col("qty")
    out = lots.groupBy("account", "ticker").agg(
        F.sum("qty").alias("shares"), F.sum(F.col("qty") * F.col("cost")).alias("cost"), F.sum(F.col("qty") * F.col("now")).alias("value"), F.sum(gain).alias("gain"),
        F.max((held <= YEAR_DAYS) & (gain < 0)).alias("has_short_loss"), F.least(F.lit(999), F.min(YEAR_DAYS - held)).alias("days_to_long"),
        F.count(F.when(held <= YEAR_DAYS, 1)).alias("short_lots"), F.count(F.when(held > YEAR_DAYS, 1)).alias("long_lots"),
    )
    last_loss = sales(matches).filter("gain < 0").groupBy("account", "ticker").agg(F.max_by("barred_until", F.struct("sold", "sale_id")).alias("_until"))
    both = out.join(last_loss, (out["account"].eqNullSafe(last_loss["account"])) & (out["ticker"].eqNullSafe(last_loss["ticker"])), "left")
    return both.select(*[out[c] for c in out.columns], F.coalesce(as_of < F.col("_until"), F.lit(False)).alias("barred"))


def harvest(held: DataFrame, least: float = 500.0, least_share: float = 0.02, rate: float = SHORT_RATE) -> DataFrame:
    """Positions whose loss is large enough to sell for the tax benefit, those barred left out; ``place`` orders an account's by benefit."""
    loss = -F.col("gain")
    big = (F.col("gain") < 0) & (loss >= least) & (F.when(F.col("cost") > 0, loss / F.col("cost")).otherwise(0.0) >= least_share)
    out = held.filter(big & ~F.col("barred")).withColumn("benefit", loss * rate)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("benefit"), "ticker")))


def tax_position(matches: DataFrame, prices: DataFrame, as_of: Column, **harvest_rule) -> DataFrame:
    """One row per account: positions, lots and their share of long-term ones, cost, value and gain, this year's realised gains, positions to harvest and their benefit, barred tickers.

    Accounts without an open lot that has a price have zeros; a null account is left out.
    """
    matches = matches.filter("account is not null")
    held = positions(matches, prices, as_of)
    per = held.groupBy("account").agg(F.count("*").alias("positions"), F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.sum("gain").alias("gain"), F.sum(F.col("barred").cast("int")).alias("barred_held"))
    lots = matches.filter("sale_id is null").groupBy("account").agg(F.count("*").alias("lots"), F.count(F.when(F.datediff(as_of, F.col("bought")) > YEAR_DAYS, 1)).alias("long_lots"))
    year = sales(matches).groupBy("account").agg(*[F.coalesce(F.sum(F.when(F.year("sold") == F.year(as_of), F.col(c))), F.lit(0.0)).alias(f"year_{c}") for c in ("short_gain", "long_gain")])
    chosen = harvest(held, **harvest_rule).groupBy("account").agg(F.count("*").alias("to_harvest"), F.sum("benefit").alias("benefit"))
    out = per.join(lots, "account", "full").join(year, "account", "full").join(chosen, "account", "left")
    counts = ("positions", "lots", "long_lots", "to_harvest", "barred_held")
    sums = ("value", "cost", "gain", "year_short_gain", "year_long_gain", "benefit")
    zero = [*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums]]
    return out.select("account", *zero).withColumn("long_share", F.col("long_lots") / F.greatest(F.lit(1), F.col("lots"))).withColumn("gain_share", F.when(F.col("cost") > 0, F.col("gain") / F.col("cost")).otherwise(0.0))


def after_tax(matches: DataFrame, capital: DataFrame, short_rate: float = SHORT_RATE, long_rate: float = LONG_RATE) -> DataFrame:
    """Realised gains of ``capital(account, start, final, years)``, losses of one rate set off against gains of the other, the tax on what is left, and yearly growth before and after it.

    Growth is 0 where years, capital or what is left after tax is not positive.
    """
    per = sales(matches).groupBy("account").agg(F.sum("short_gain").alias("short_gain"), F.sum("long_gain").alias("long_gain"), F.count("*").alias("n_sales"))
    both = capital.join(per, "account", "left").fillna(0, ["short_gain", "long_gain", "n_sales"])
    s, l = F.col("short_gain"), F.col("long_gain")  # noqa: E741
    due = F.when((l < 0) & (s > 0), F.greatest(F.lit(0.0), s + l)).otherwise(F.greatest(F.lit(0.0), s)) * short_rate + F.when((s < 0) & (l > 0), F.greatest(F.lit(0.0), l + s)).otherwise(F.greatest(F.lit(0.0), l)) * long_rate
    b = both.withColumn("tax", due).withColumn("left", F.col("final") - F.col("tax"))
    ok = (F.col("years") > 0) & (F.col("start") > 0) & (F.col("left") > 0)
    growth = lambda c: F.when(ok, F.pow(F.col(c) / F.col("start"), 1 / F.col("years")) - 1).otherwise(0.0)
    b = b.withColumn("growth", growth("final")).withColumn("growth_after", growth("left"))
    realised = s + l
    share = lambda x: F.when(realised > 0, x / realised).otherwise(0.0)
    b = b.withColumn("tax_rate", F.when(ok & (F.col("growth") > 0), 1 - F.col("growth_after") / F.col("growth")).otherwise(0.0))
    return b.select("account", "short_gain", "long_gain", "n_sales", "tax", "growth", "growth_after", "tax_rate", share(s).alias("short_share"), share(l).alias("long_share"))


def realised_by_day(matches: DataFrame) -> DataFrame:
    """``(account, date, pnl, total)``: realised profit of each day with a sale, and of all days up to it."""
    per = sales(matches).groupBy("account", F.col("sold").alias("date")).agg(F.sum("gain").alias("pnl"))
    return per.withColumn("total", F.sum("pnl").over(Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def tax_aware_weights(book: DataFrame, matches: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """``book(account, ticker, current, target)`` with ``weight``: no purchase of barred tickers, no sale of those with a lot worth waiting for, rescaled to one.

    Null weights count as 0. The positive weights of an account sum to one afterwards; where none is positive they stay.
    """
    keys = ["account", "ticker"]
    lots = matches.filter("sale_id is null").join(prices.select("ticker", F.col("price").alias("now")), "ticker")
    wait = lots.groupBy(*keys).agg(F.max(defer_sale((F.col("now") - F.col("cost")) * F.col("qty"), F.datediff(as_of, F.col("bought")), F.col("now") * F.col("qty"))).alias("_wait"))
    last = sales(matches).filter("gain < 0").groupBy(*keys).agg(F.max_by("barred_until", F.struct("sold", "sale_id")).alias("_until"))
    b = book.join(wait, keys, "left").join(last, keys, "left").withColumn("_c", F.coalesce("current", F.lit(0.0))).withColumn("_t", F.coalesce("target", F.lit(0.0)))
    bought = F.when((F.col("_t") > 0) & F.coalesce(as_of < F.col("_until"), F.lit(False)), 0.0).otherwise(F.col("_t"))
    kept = F.when((F.col("_c") > 0) & F.coalesce("_wait", F.lit(False)) & (bought < F.col("_c")), F.col("_c")).otherwise(bought)
    whole = F.sum(F.when(F.col("_w") > 0, F.col("_w"))).over(Window.partitionBy("account"))
    return b.withColumn("_w", kept).withColumn("weight", F.when(whole > 0, F.col("_w") / whole).otherwise(F.col("_w"))).select(*book.columns, "weight")

"""A loss breaker over the fill stream: one row per account, when its realised loss first reaches a limit."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.operators.lots import LONG_RATE, SHORT_RATE, Lots

#: Limits as shares of the account's capital; while a canary runs they are wider by a half.
TOTAL_LIMIT, DAY_LIMIT, CANARY = -0.30, -0.05, 1.5
BREACH_SCHEMA = "account long, ts timestamp, date date, fill_id long, decision string, day_pnl double, total_pnl double"
#: Accounts whose numbers agree but for so many last bits share a key of the state, 16 at most, and its calls.
SHARED_BITS = 4
#: Fills that are taken out of their bytes at once.
SLICE = 4096
#: What the state holds in bytes: fills that wait, open lots in order of purchase, and profit of accounts that have sold.
FILL = np.dtype([("account", "<i8"), ("us", "<i8"), ("fill_id", "<i8"), ("ticker", "<i8"), ("day", "<i4"), ("buy", "?"), ("qty", "<f8"), ("price", "<f8")])
LOT = np.dtype([("account", "<i8"), ("ticker", "<i8"), ("id", "<i8"), ("day", "<i4"), ("cost", "<f8"), ("shares", "<f8")])
PROFIT = np.dtype([("account", "<i8"), ("day", "<i4"), ("of_day", "<f8"), ("total", "<f8"), ("breached", "?")])
EPOCH = pd.Timestamp("1970-01-01").date().toordinal()


def decision(total: Column, day: Column, capital: float, canary: bool = False) -> Column:
    """Name of the limit that is reached, the total one first; null if none is."""
    wide = capital * (CANARY if canary else 1.0)
    return F.when(total <= TOTAL_LIMIT * wide, "total").when(day <= DAY_LIMIT * wide, "day")


class Breaker(StatefulProcessor):
    """Per account: fills that the watermark has not passed, open lots by ticker, profit of the day and in all.

    Fills wait until the watermark has passed them and are then taken in order of time and id, so how they were cut
    into batches, and how late they came within the watermark's delay, does not show. A key of the state holds up to 16
    accounts, for each call of the state costs far more than the rows it moves. One timer per key wakes it for the
    first fill that waits.
    """

    def __init__(self, capital: float, canary: bool = False):
        wide = capital * (CANARY if canary else 1.0)
        self.total_limit, self.day_limit = TOTAL_LIMIT * wide, DAY_LIMIT * wide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "fills binary")
        self.books = handle.getValueState("books", "lots binary, profits binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        packed, first = [], None
        for part in rows:
            if not len(part):
                continue
            fills = np.empty(len(part), FILL)
            for name in FILL.names:
                fills[name] = part[name].to_numpy()
            packed.append((fills.tobytes(),))
            least = int(fills["us"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.pending.appendList(packed)
            timer, wake = self.timer.get()[0] if self.timer.exists() else None, -(-first // 1000)
            if timer is None or wake < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wake)
                self.timer.update((wake,))
        return iter([])

    def _read(self) -> tuple[dict[tuple[int, int], Lots], dict[int, tuple[int, float, float, bool]]]:
        """Open lots by account and ticker, and day, its profit, all profit and whether a limit was reached by account."""
        lots: dict[tuple[int, int], Lots] = {}
        profits = {}
        if self.books.exists():
            packed_lots, packed_profits = self.books.get()
            for account, ticker, lot, day, cost, shares in np.frombuffer(packed_lots, LOT).tolist():
                lots.setdefault((account, ticker), Lots()).buy(lot, day, cost, shares)
            profits = {account: tuple(rest) for account, *rest in np.frombuffer(packed_profits, PROFIT).tolist()}
        return lots, profits

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.concatenate([np.frombuffer(packed, FILL) for (packed,) in self.pending.get()])
        waiting = waiting[np.lexsort((waiting["fill_id"], waiting["us"], waiting["account"]))]
        same = np.logical_and.reduce([waiting[name][1:] == waiting[name][:-1] for name in ("account", "us", "fill_id")])
        waiting = waiting[np.append(~same, True)]  # of a fill that came several times, the last
        ready, later = waiting[waiting["us"] <= passed], waiting[waiting["us"] > passed]
        lots, profits = self._read()
        out = []
        for account, us, fill, ticker, on, buy, qty, price in chain.from_iterable(ready[at : at + SLICE].tolist() for at in range(0, len(ready), SLICE)):
            day, of_day, total, breached = profits.get(account, (None, 0.0, 0.0, False))
            if breached:
                continue
            held = lots.setdefault((account, ticker), Lots())
            if buy:
                held.buy(fill, on, price, qty)
                continue
            taken = list(held.sell(on, price, qty, SHORT_RATE, LONG_RATE))
            if not taken:
                continue
            gain = sum((price - cost) * shares for _, _, cost, shares, _ in taken)
            of_day, total = (of_day if on == day else 0.0) + gain, total + gain
            kind = "total" if total <= self.total_limit else "day" if of_day <= self.day_limit else None
            profits[account] = on, of_day, total, kind is not None
            if kind:
                out.append((account, pd.Timestamp(us, unit="us"), pd.Timestamp.fromordinal(on + EPOCH).date(), fill, kind, of_day, total))
        gone = {account for account, profit in profits.items() if profit[-1]}  # nothing more will come of these
        if gone:
            later = later[~np.isin(later["account"], list(gone))]
        kept = [(*at, *lot) for at, x in lots.items() if at[0] not in gone for lot in zip(x.ids, x.days, x.costs, x.shares, strict=True)]
        self.books.update((np.array(kept, LOT).tobytes(), np.array([(account, *profit) for account, profit in profits.items()], PROFIT).tobytes()))
        if len(later):
            wake = -(-int(later["us"].min()) // 1000)
            self.pending.put([(later.tobytes(),)])
            self.handle.registerTimer(wake)
            self.timer.update((wake,))
        else:
            self.pending.clear()
            self.timer.clear()
        if out:
            yield pd.DataFrame(out, columns=["account", "ts", "date", "fill_id", "decision", "day_pnl", "total_pnl"])

    def close(self) -> None:
        pass


def breaches(fills: DataFrame, capital: float, late: str = "2 hours", canary: bool = False) -> DataFrame:
    """A stream of the first breach of each account. ``fills(account, ticker, ts, date, fill_id, side, qty, price)`` is a stream.

    Profit is that of tax lots, as ``lots.match_lots`` takes them, and a limit is looked at after each sale that took
    shares. A fill that comes within ``late`` of the latest one seen counts at its own time; a later one is dropped. The
    same id at the same time counts once, at another time it is another fill. Fills that can't be matched (null or
    non-positive quantity or price, another side, no date) are left out, as are those without account or ticker. After
    its row an account's lots go and its fills are ignored. Needs a state store that has timers and several
    values for a key (``rocksdb``).
    """
    ok = F.col("side").isin("BUY", "SELL") & (F.col("qty") > 0) & (F.col("price") > 0) & F.col("date").isNotNull() & F.col("account").isNotNull() & F.col("ticker").isNotNull()
    rows = fills.withWatermark("ts", late).filter(ok).select(
        F.col("account").cast("long").alias("account"), F.col("ticker").cast("long").alias("ticker"), "ts", F.unix_micros("ts").alias("us"), F.unix_date("date").alias("day"),
        F.col("fill_id").cast("long").alias("fill_id"), (F.col("side") == "BUY").alias("buy"), F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"),
    )
    return rows.withColumn("key", F.shiftright("account", SHARED_BITS)).groupBy("key").transformWithStateInPandas(Breaker(capital, canary), BREACH_SCHEMA, "Append", "EventTime")


def first_breaches(sales: DataFrame, capital: float, canary: bool = False) -> DataFrame:
    """The same of a table ``sales(account, sold, sale_id, gain)``, as ``lots.sales`` gives it: ``(account, date, fill_id, decision, day_pnl, total_pnl)``."""
    order = Window.partitionBy("account").orderBy("sold", "sale_id").rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy("account", "sold").orderBy("sale_id").rowsBetween(Window.unboundedPreceding, 0)
    b = sales.withColumn("total_pnl", F.sum("gain").over(order)).withColumn("day_pnl", F.sum("gain").over(day)).withColumn("decision", decision(F.col("total_pnl"), F.col("day_pnl"), capital, canary))
    hit = b.filter("decision is not null").groupBy("account").agg(F.min_by(F.struct(F.col("sold").alias("date"), F.col("sale_id").alias("fill_id"), "decision", "day_pnl", "total_pnl"), F.struct("sold", "sale_id")).alias("b"))
    return hit.select("account", "b.*")

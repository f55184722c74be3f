"""Lot matching against a ledger that walks the fills one by one, and its edge cases."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidepanel.operators import lots as L

DAY = dt.date(2020, 1, 1)
SCHEMA = "account long, ticker string, date date, fill_id long, side string, qty double, price double"


def ledger(rows):
    """Sales as (account, ticker, sale) to [shares, short gain, long gain], and open lots, by a plain loop."""
    held, sold = defaultdict(list), defaultdict(lambda: [0.0, 0.0, 0.0])
    for a, t, day, fill, side, qty, price in sorted(rows, key=lambda r: (r[2], r[3])):
        lots = held[a, t]
        if side == "BUY":
            lots.append([fill, day, price, qty])
            continue
        order = sorted(lots, key=lambda x: (price - x[2]) * x[3] * (0.188 if (day - x[1]).days > 365 else 0.328))
        for lot in order:
            if qty <= 1e-8:
                break
            take = min(lot[3], qty)
            qty -= take
            lot[3] -= take
            out = sold[a, t, fill]
            out[0] += take
            out[2 if (day - lot[1]).days > 365 else 1] += (price - lot[2]) * take
        held[a, t] = [x for x in lots if x[3] >= 1e-8]
    return sold, held


def some_fills(n=1500, seed=2):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.choice("XY"), DAY + dt.timedelta(rng.randrange(900)), k, rng.choice(["BUY", "BUY", "SELL"]), float(rng.randrange(1, 9)), round(rng.expovariate(1 / 30), 2) + 0.01) for k in range(n)]


def test_sales_and_open_lots_equal_a_plain_ledger(spark):
    rows = some_fills()
    sold, held = ledger(rows)
    m = L.match_lots(spark.createDataFrame(rows, SCHEMA).repartition(5)).cache()
    got = {(r["account"], r["ticker"], r["sale_id"]): r for r in L.sales(m).collect()}
    assert got.keys() == sold.keys()
    for k, (qty, short, long) in sold.items():
        r = got[k]
        assert abs(r["qty"] - qty) < 1e-9 and abs(r["short_gain"] - short) < 1e-6 and abs(r["long_gain"] - long) < 1e-6
        assert (r["barred_until"] is not None) == (short + long < 0)
    open_lots = sorted((r["account"], r["ticker"], r["lot_id"], round(r["qty"], 6)) for r in m.filter("sale_id is null").collect())
    assert open_lots == sorted((*k, x[0], round(x[3], 6)) for k, v in held.items() for x in v)


def test_the_least_tax_goes_first_and_more_than_held_is_ignored(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [(1, "X", day(0), 1, "BUY", 10.0, 10.0), (1, "X", day(300), 2, "BUY", 10.0, 10.0), (1, "X", day(310), 3, "BUY", 10.0, 60.0), (1, "X", day(400), 4, "SELL", 25.0, 50.0), (1, "X", day(401), 5, "SELL", 99.0, 50.0), (1, "X", day(402), 6, "SELL", 1.0, 50.0)]
    got = [(r["sale_id"], r["lot_id"], r["qty"], r["long_term"]) for r in L.match_lots(spark.createDataFrame(rows, SCHEMA)).orderBy("sale_id", F.desc("qty"), F.desc("lot_id")).collect()]
    assert sorted(got) == [(4, 1, 10.0, True), (4, 2, 5.0, False), (4, 3, 10.0, False), (5, 2, 5.0, False)]


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, "X", DAY, 1, "BUY", None, 5.0), (1, "X", DAY, 2, "BUY", 1.0, 0.0), (1, "X", None, 3, "BUY", 1.0, 5.0), (1, "X", DAY, 4, "HOLD", 1.0, 5.0), (None, None, DAY, 5, "BUY", 2.0, 5.0), (None, None, DAY, 5, "SELL", 1.0, 7.0), (2, "X", DAY, 7, "SELL", 1.0, 5.0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lot_id", F.lit("clash"))
    got = [(r["account"], r["lot_id"], r["sale_id"], r["qty"], r["gain"]) for r in L.match_lots(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 5, 5, 1.0, 2.0), (None, 5, None, 1.0, None)], key=str)
    assert L.match_lots(docs.limit(0)).collect() == []
    prices = spark.createDataFrame([("X", 4.0)], "ticker string, price double")
    assert L.positions(L.match_lots(docs), prices, F.lit(DAY)).collect() == []
    assert L.tax_position(L.match_lots(docs.limit(0)), prices, F.lit(DAY)).collect() == []


def test_a_lot_near_the_long_term_rate_is_not_sold_and_a_barred_ticker_not_bought(spark):
    rows = [(1, "W", DAY, 1, "BUY", 10.0, 10.0), (1, "B", DAY, 2, "BUY", 10.0, 10.0), (1, "B", DAY + dt.timedelta(320), 3, "SELL", 10.0, 5.0)]
    m = L.match_lots(spark.createDataFrame(rows, SCHEMA))
    prices = spark.createDataFrame([("W", 50.0), ("B", 5.0)], "ticker string, price double")
    book = spark.createDataFrame([(1, "W", 0.6, 0.1), (1, "B", 0.0, 0.5), (1, "C", None, 0.4)], "account long, ticker string, current double, target double")
    got = {r["ticker"]: round(r["weight"], 9) for r in L.tax_aware_weights(book, m, prices, F.lit(DAY + dt.timedelta(330))).collect()}
    assert got == {"W": 0.6, "B": 0.0, "C": 0.4}

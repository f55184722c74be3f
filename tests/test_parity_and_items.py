"""Put-call parity against a plain loop, and items of filings against positions found by a regular expression."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np

from tidepanel.operators import parity as P
from tidepanel.operators import text as T

DAY = dt.date(2024, 5, 1)
CHAIN = "date date, ticker string, dte int, strike double, kind string, mid double"


def quotes():
    rng = random.Random(2)
    rows = []
    for t in "ABCD":
        for dte in (10, 30, 45, 90, 200):
            for strike in (80.0, 95.0, 100.0, 105.0):
                for kind in "cp":
                    if rng.random() < (0.2 if t == "D" else 0.8):
                        rows.append((DAY, t, dte, strike, kind, round(rng.uniform(1, 12), 2)))
    return rows + [(DAY, "A", 45, 100.0, "c", None), (DAY, "A", 45, 100.0, "p", -1.0), (DAY, "A", -5, 100.0, "c", 1.0), (DAY, "Z", 45, 100.0, "c", 1.0)]


def loop(rows, t, spot, curve, low, least):
    side = lambda k: {(r[2], r[3]): r[5] for r in rows if r[1] == t and r[4] == k and r[5] and r[5] > 0 and r[2] > 0}
    calls, puts = side("c"), side("p")
    pairs = [(dte, k, calls[dte, k], puts[dte, k]) for dte, k in calls.keys() & puts.keys() if abs(k / spot - 1) <= 0.1]
    band = [p for p in pairs if low <= p[0] <= 180]
    if len(band) < least:
        band = [p for p in pairs if 30 <= p[0] <= 180]
    if len(band) < least:
        return None
    est = []
    for dte, k, c, p in band:
        r = np.interp(dte, list(curve), list(curve.values())) if curve else 0.0
        est.append((spot - k * math.exp(-r * dte / 365) - (c - p)) * math.exp(r * dte / 365) * 365 / dte)
    lo, hi = np.quantile(est, [0.1, 0.9])
    return float(np.mean(np.maximum(np.clip(est, lo, hi), 0)))


def test_implied_dividends_equal_a_loop(spark):
    rows, spot = quotes(), {"A": 100.0, "B": 101.0, "C": 97.0, "D": 100.0}
    chain = spark.createDataFrame(rows, CHAIN)
    spots = spark.createDataFrame([(DAY, t, s) for t, s in spot.items()] + [(DAY, "Z", 0.0)], "date date, ticker string, spot double")
    for curve in ({40: 0.03, 60: 0.05, 120: 0.04}, {}):
        rates = spark.createDataFrame([(DAY, d, r) for d, r in curve.items()] + [(DAY, None, 0.1)], "date date, dte int, rate double")
        for low, least in ((30, 2), (60, 3), (60, 9)):
            got = {r["ticker"]: r["value"] for r in P.implied_dividend(P.call_put_pairs(chain, spots), rates, least_dte=low, least_pairs=least).collect()}
            for t, s in spot.items():
                want = loop(rows, t, s, curve, low, least)
                assert (want is None and got.get(t) is None) or abs(got[t] - want) < 1e-9
            assert "Z" not in got
    assert P.implied_dividend(P.call_put_pairs(chain.limit(0), spots), rates).collect() == []


def test_paid_dividends_and_surprise(spark):
    imp = spark.createDataFrame([(DAY, "A", 3.0), (DAY, "B", 1.0), (DAY, "C", None)], "date date, ticker string, value double")
    pay = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY - dt.timedelta(364), 0.5), ("A", DAY - dt.timedelta(365), 9.0), ("A", DAY + dt.timedelta(1), 9.0), ("C", DAY, 1.0), ("C", DAY, None)], "ticker string, date date, amount double")
    got = {r["ticker"]: (r["paid"], r["surprise"], r["rank"]) for r in P.dividend_surprise(imp, pay).collect()}
    assert got == {"A": (1.5, 1.5, 1.0), "B": (0.0, 1.0, 0.5), "C": (1.0, None, None)}


def sections(text, wanted):
    found = [(m.group(1).upper(), m.start()) for m in re.finditer(r"(?i)\bitem\s+(\d+[a-z]?)\b[.:\s]", text)]
    order = lambda x: (int(re.match(r"\d+", x)[0]), re.match(r"\d+([A-Z]?)", x)[1])
    out = []
    for x in wanted:
        hits = [p for i, p in found if i == x]
        end = min((p for i, p in found if hits and p > hits[-1] and order(i) > order(x)), default=len(text))
        out.append(text[hits[-1] : end].strip(" ") if hits else "")
    return out


def test_items_equal_positions(spark):
    rng = random.Random(7)
    words = ["Item 1A.", "item 7:", "ITEM 7A ", "Item 2.", "Item 10.", "items 7", "Item 1B.", "risk", "and", "Item", "7.", "\u0001", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "Item 7."]
    rows = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "id int, text string, item_7 string").drop("item_7")
    got = T.extract_items(rows, ["1A", "7", "2"]).collect()
    for r in got:
        assert [r["item_1a"], r["item_7"], r["item_2"]] == sections((texts[r["id"]] or "").replace("\u0001", " "), ["1A", "7", "2"])
    assert T.extract_items(rows.limit(0), ["7"]).columns == ["id", "text", "item_7"]

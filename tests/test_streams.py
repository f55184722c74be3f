"""The breaker as a stream: restarts, late and repeated fills, and the same rows as the table form."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
import pytest

from tidepanel.operators import lots
from tidepanel.streaming import breaker, ledger

SCHEMA = "account long, ticker long, ts timestamp, date date, fill_id long, side string, qty double, price double"
START = dt.datetime(2024, 1, 1)


def fills(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        at = START + dt.timedelta(minutes=3 * k)
        out.append((rng.randrange(6), rng.randrange(2), at, (START + dt.timedelta(days=k // 20)).date(), k, rng.choice(["BUY", "SELL"]), float(rng.randrange(1, 5)), round(rng.uniform(5, 60), 2)))
    return out


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, **kw):
    raw = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return breaker.breaches(raw, 400.0, **kw)


def found(df):
    return sorted((r["account"], r["date"], r["fill_id"], r["decision"], round(r["day_pnl"], 6), round(r["total_pnl"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def want(spark):
    rows = [r for r in fills() if r[2] <= fills()[-1][2] - dt.timedelta(hours=2)]
    table = spark.createDataFrame(rows, SCHEMA)
    out = found(breaker.first_breaches(lots.sales(lots.match_lots(table)), 400.0))
    assert len(out) >= 4
    return out


def test_one_file_and_a_restart_between_shuffled_files_give_the_same(spark, tmp_path, want):
    rows = fills()
    land(spark, tmp_path / "one", "a", rows)
    assert found(ledger.run(stream(spark, tmp_path / "one"), str(tmp_path / "s1"))) == want
    rng, moved = random.Random(5), sorted(rows, key=lambda r: r[4])
    blocks = [moved[k : k + 30] for k in range(0, len(moved), 30)]  # an hour and a half each
    for b in blocks:
        rng.shuffle(b)
    swapped = [x for pair in zip(blocks[1::2], blocks[::2], strict=False) for x in pair] + ([blocks[-1]] if len(blocks) % 2 else [])
    land(spark, tmp_path / "many", "f00", swapped[0])
    for k, b in enumerate(swapped[1:7], 1):
        land(spark, tmp_path / "many", f"f{k:02}", b + b[:3])  # some fills twice
    ledger.run(stream(spark, tmp_path / "many", late="4 hours"), str(tmp_path / "s2"))
    for k, b in enumerate(swapped[7:], 7):
        land(spark, tmp_path / "many", f"f{k:02}", b)
    got = found(ledger.run(stream(spark, tmp_path / "many", late="4 hours"), str(tmp_path / "s2")))
    assert got == [r for r in want if r in got] and {r[0] for r in want if r[2] < 350} <= {r[0] for r in got}


def test_fills_that_cannot_be_matched_and_late_ones_are_left_out(spark, tmp_path):
    day, at = START.date(), lambda h: START + dt.timedelta(hours=h)
    land(spark, tmp_path / "in", "a", [(1, 1, at(0), day, 1, "BUY", 1.0, 900.0), (1, 1, at(1), day, 2, "SELL", 1.0, None), (1, None, at(1), day, 3, "SELL", 1.0, 5.0), (2, 1, at(1), day, 4, "SELL", 1.0, 5.0), (None, 1, at(1), day, 5, "BUY", 1.0, 5.0), (3, 1, at(9), day, 6, "BUY", 1.0, 5.0)])
    base = str(tmp_path / "s")
    assert found(ledger.run(stream(spark, tmp_path / "in"), base)) == []
    land(spark, tmp_path / "in", "b", [(1, 1, at(2), day, 7, "SELL", 1.0, 5.0), (1, 1, at(8), day, 8, "SELL", 1.0, 800.0), (3, 1, at(20), day, 9, "BUY", 1.0, 5.0)])
    assert found(ledger.run(stream(spark, tmp_path / "in"), base)) == [(1, day, 8, "day", -100.0, -100.0)]


def test_accounts_that_share_a_key_do_not_touch_each_other(spark, tmp_path):
    rng = random.Random(7)
    names = [*range(-70, -60), *range(60, 70), 1 << 40]
    rows = [(rng.choice(names), *r[1:]) for r in fills(1500, 9)]
    blocks = [rows[k : k + 300] for k in range(0, len(rows), 300)]
    for k, b in enumerate(blocks):
        land(spark, tmp_path / "in", f"f{k}", b + b[-5:])
    table = spark.createDataFrame([r for r in rows if r[2] <= rows[-1][2] - dt.timedelta(hours=2)], SCHEMA)
    want = found(breaker.first_breaches(lots.sales(lots.match_lots(table)), 400.0))
    assert len(want) >= 4 and len({r[0] >> breaker.SHARED_BITS for r in want}) >= 3
    assert found(ledger.run(stream(spark, tmp_path / "in"), str(tmp_path / "s"))) == want


class Counted:
    """A state variable or the handle itself, in memory, that counts calls."""

    def __init__(self):
        self.calls, self.value, self.timers, self.parts = 0, None, [], []

    def _part(self, *_):
        self.parts.append(Counted())
        return self.parts[-1]

    getListState = getValueState = getMapState = _part  # noqa: N815

    def _call(self, value):
        self.calls, self.value = self.calls + 1, value

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    update = put = _call

    def appendList(self, values):  # noqa: N802
        self._call((self.value or []) + values)

    def clear(self):
        self._call(None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 1 << 50


def test_calls_of_the_state_do_not_grow_with_fills_and_accounts_of_a_key():
    def calls(accounts, n):
        handle, one = Counted(), breaker.Breaker(1e9)
        one.init(handle)
        rows = [(a, 1000 * k, a * n + k, k % 3, k // 10, k % 2 == 0, 2.0, 10.0 + k % 5) for a in range(accounts) for k in range(n)]
        part = pd.DataFrame(rows, columns=["account", "us", "fill_id", "ticker", "day", "buy", "qty", "price"])
        assert list(one.handleInputRows((0,), iter([part]), handle)) == [] and handle.timers == [0]
        assert list(one.handleExpiredTimer((0,), handle, None)) == []
        return handle.calls + sum(p.calls for p in handle.parts)

    assert calls(1, 4) == calls(64, 40) < 20

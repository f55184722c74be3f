"""Filings cut into parts, and ids held against each other in a bounded number of blocks."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter

from tidepanel.operators import signals as G
from tidepanel.operators import text as T


def test_prior_filings_of_parts_are_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), k if k else None, " ".join(rng.choice(["one", "two's", "Three", "four", "5"]) for _ in range(30)) + f" x{k}") for k in range(90)]
    df = spark.createDataFrame(rows, "ticker string, seq long, text string").repartition(5)
    want, before = {}, {}
    for t, k, text in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0)):
        want[t, k], before[t] = before.get(t), text
    for parts in (7,):
        got = [(r["ticker"], r["seq"], r["prior"]) for r in T.with_prior(df, parts).collect()]
        assert len(got) == 90 and {(t, k): p for t, k, p in got} == want
    plan = T.tfidf_cosine(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # one row a word was shuffled before
    assert T.tfidf_cosine(df.limit(0)).collect() == []


def test_cosine_of_edge_cases(spark):
    long = lambda w: " ".join([w] * 60)
    rows = [("t", 1, long("same")), ("t", 2, long("same")), ("t", 3, long("55")), ("t", 4, long("66")), ("t", 5, long("other")), ("t", 6, "short")]
    got = {r["seq"]: r["value"] for r in T.tfidf_cosine(spark.createDataFrame(rows, "ticker string, seq long, text string")).collect()}
    assert got[3] is None and got[5] is None and 4 not in got and 6 not in got and abs(got[2] - 1) < 1e-12
    assert T.cosine(Counter(a=1), Counter(b=1)) == 0


def test_matches_do_not_hang_on_blocks(spark):
    rng = random.Random(6)
    months = [dt.date(2020 + k // 12, 1 + k % 12, 1) for k in range(36)]
    left = [(i, m, rng.gauss(0, 1)) for i in range(60) for m in months if rng.random() < 0.95]
    right = [(1000 + i, m, r + rng.gauss(0, 0.2)) for i, m, r in left]
    a, b = (spark.createDataFrame(x, "id long, month date, ret double") for x in (left, right))
    runs = [G.match_by_returns(a, b, block=n) for n in (2, 512)]
    got = [sorted((r["id"], r["other"], r["n"], r["score"]) for r in df.collect()) for df in runs]
    assert got[0] == got[1] and {(i, o) for i, o, _, _ in got[0]} == {(i, 1000 + i) for i in range(60)}
    last = re.findall(r"sequence\(0, (\d+)", runs[0]._jdf.queryExecution().analyzed().toString())
    assert last and max(map(int, last)) < 24  # 30 blocks of two ids would copy every id 30 times

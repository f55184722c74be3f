"""The Katz model against a direct computation, and its sums."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepanel.llm import katz

SCHEMA = "doc_id long, text string, score string"


def words(text):
    return (text or "").encode().lower().split() + [b"</s>"]


def is_held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def brute(rows, order):
    counts, contexts = [Counter() for _ in range(order + 1)], [defaultdict(dict) for _ in range(order + 1)]
    for doc, text in rows:
        if not is_held(doc):
            seq = [b"<s>"] * (order - 1) + words(text)
            for i in range(order - 1, len(seq)):
                for m in range(1, order + 1):
                    counts[m][tuple(seq[i - m + 1 : i + 1])] += 1
    ds = {}
    for m in range(1, order + 1):
        of = Counter(min(c, katz.CUTOFF + 2) for c in counts[m].values())
        ds[m] = katz.discounts([of.get(r, 0) for r in range(1, katz.CUTOFF + 3)] + [sum(counts[m].values())])
        for gram, c in counts[m].items():
            contexts[m][gram[:-1]][gram[-1]] = c
    total, vocabulary = sum(counts[1].values()), len(counts[1])

    def keep(m, c):
        return float(ds[m].kept(__import__("numpy").array([c]))[0])

    def p(m, context, w):
        if m == 1:
            if not total:
                return 1.0
            c = counts[1].get((w,), 0)
            return (keep(1, c) if c else sum(x - keep(1, x) for x in counts[1].values())) / total
        seen = contexts[m].get(context)
        if not seen:
            return p(m - 1, context[1:], w)
        n = sum(seen.values())
        if w in seen:
            return keep(m, seen[w]) / n
        left = sum(c - keep(m, c) for c in seen.values()) / n
        return left / (1 - sum(p(m - 1, context[1:], x) for x in seen)) * p(m - 1, context[1:], w)

    out = []
    for doc, text in rows:
        seq = [b"<s>"] * (order - 1) + words(text)
        grams = [(tuple(seq[i - order + 1 : i]), seq[i]) for i in range(order - 1, len(seq))]
        base = sum(math.log10((counts[1].get((w,), 0) + 0.1) / (total + 0.1 * (vocabulary + 1))) for _, w in grams)
        out.append((doc, is_held(doc), len(grams), sum((w,) in counts[1] for _, w in grams), total, base, sum(math.log10(p(order, c, w)) for c, w in grams)))
    sums = [sum(p(order, c, w) for w in [*(x for (x,) in counts[1]), b"?unknown"]) for c in [(b"<s>",) * (order - 1), *list(contexts[order])[:20], (b"?",) * (order - 1)]]
    return out, sums


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(f"W{int(rng.expovariate(0.15))}" for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return rows + [(3, rows[3][1]), (None, "w1 w2 w3"), (500, None), (501, ""), (510, "never seen this É\tw1")]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("block", [1 << 21, 40])
def test_scores_match_direct_computation(spark, monkeypatch, order, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    rows = corpus()
    want, sums = brute(rows, order)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in katz.katz_scores(df, order).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2:4])), sorted(want, key=lambda r: (str(r[0]), r[2:4])), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9)
        assert g[6] == pytest.approx(w[6], abs=1e-8)


def test_grouping_and_packing_of_keys():
    rng = np.random.default_rng(4)
    near = (np.uint64(1) << np.uint64(60)) + rng.integers(0, 9, 500, dtype=np.uint64)
    for keys in (np.zeros(0, np.uint64), near[:1], near, rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2), np.repeat(near, 3), np.concatenate([near, rng.integers(0, 1 << 63, 700, dtype=np.uint64)])):
        want = np.unique(keys, return_inverse=True)
        got = katz.grouped(keys)
        assert all((g == w).all() for g, w in zip(got, want, strict=True))
        assert not len(keys) or (katz._unpacked_keys(katz._packed_keys(want[0]), len(want[0])) == want[0]).all()
    for numbers in ([0], [-3, 127], [128], [-40_000], [1 << 40, -1]):
        assert katz._unpacked(katz._packed(np.array(numbers))).tolist() == numbers


def test_other_texts_are_scored_from_the_stored_tables(spark):
    """A model that is fitted to the training rows gives the held-out rows the scores that the one run gives them."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    train = [r for r in rows if not is_held(r[0])]
    model = katz.fit(spark.createDataFrame([(i, t, "clash") for i, t in train], SCHEMA))
    assert {r["order"] for r in model.counts.select("order").distinct().collect()} == {1, 2, 3}
    assert {r["order"] for r in model.weights.select("order").distinct().collect()} == {2, 3}
    want = {(r["id"], r["n_tokens"]): r["score"] for r in katz.katz_scores(df, 3).collect() if r["held_out"]}
    got = {(r["id"], r["n_tokens"]): r["score"] for r in katz.score(df.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 10 = 0"), model).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_no_block_table_is_left(spark):
    katz.katz_scores(spark.createDataFrame([(1, "a b", "x")], SCHEMA)).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("katz_blocks")]


def test_no_rows_and_no_training(spark):
    assert katz.katz_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if is_held(i))
    (row,) = katz.katz_scores(spark.createDataFrame([(held, "a b", "x")], SCHEMA)).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (3, 0, 0, 0.0)

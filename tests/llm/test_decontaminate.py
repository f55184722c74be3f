"""Decontamination against a word-by-word alignment of every offset."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate as D

DOCS, ITEMS = "doc_id long, text string, words string, seed string", "item_id long, text string, at string"


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower().replace("ß", "ss")) if w]


def brute(docs, items):
    out = set()
    for doc, text in docs:
        t = tokens(text)
        for item, itext in items:
            i = tokens(itext)
            size = min(13, len(i))
            if len(i) < 3:
                continue
            for d in range(-len(i), len(t) + 1):
                hits = [0 <= d + k < len(t) and t[d + k] == w for k, w in enumerate(i)]
                if any(sum(hits[s : s + size]) >= (size if size < 6 else 0.8 * size) for s in range(len(i) - size + 1)):
                    out.add((doc, item))
    return out


def cases():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([9, 12, 13, 14, 30])))) for k in range(12)] + [(50, "too short"), (51, None), (60, "k1 k2 k3"), (61, "k4 k5 k6 k7"), (62, "k8 k9 k10 k11 k12"), (66, "p1 p2 p3 p4 p5 p6"), (67, "q1 q2 q3 q4 q5 q6 q7"), (68, "r1 r2 r3 r4 r5 r6 r7 r8"), (1, "a b c d e f g h")]
    docs = []
    for k in range(120):
        body = [word() for _ in range(rng.randrange(0, 80))]
        if k % 3 == 0:
            leak = tokens(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 4)):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = leak[: rng.choice([len(leak), 10])]
        docs.append((k, (" " if k % 2 else "!! ").join(body).upper() if k % 4 == 0 else " ".join(body)))
    for n, (item, text) in enumerate([i for i in items if i[0] >= 60]):
        words = text.split()
        docs.append((1000 + 100 * n, f"w1 {text} w2"))
        for k in range(len(words)):  # one word substituted, wherever it stands
            docs.append((1001 + 100 * n + k, " ".join(["w3", *words[:k], "CHANGED", *words[k + 1 :], "w4"])))
    return docs + [(None, items[0][1]), (3, docs[3][1]), (300, None), (301, ""), (302, "?? !")], items


def test_matches_brute_force(spark):
    docs, items = cases()
    found = D.leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute(docs, items)


def test_join_without_broadcast_finds_the_same(spark):
    docs, items = cases()
    found = D.leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS), max_broadcast=0)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == brute(docs, items)


def test_clean_rows_stay_whole(spark):
    docs, items = cases()
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    kept = D.decontaminate(df, spark.createDataFrame([(*i, "z") for i in items], ITEMS))
    bad = {d for d, _ in brute(docs, items)}
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", 7, 8, 9), (2, "clean", 1, 2, 3)], "doc_id long, text string, __found int, __row int, doc_hash int")
    items = spark.createDataFrame([(1, "a b c d e f g h", 5)], "item_id long, text string, words int")
    assert [tuple(r) for r in D.decontaminate(df, items).collect()] == [(2, "clean", 1, 2, 3)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert D.leaks(docs, items).collect() == []
    one = spark.createDataFrame([(1, "some text here", "x", "y")], DOCS)
    assert D.decontaminate(one, items).count() == 1


def most_equal(doc, item, window):
    """The most equal words of a window at any offset."""
    t, i = tokens(doc), tokens(item)
    size = min(window, len(i))
    hits = ([0 <= d + k < len(t) and t[d + k] == w for k, w in enumerate(i)] for d in range(-len(i), len(t) + 1))
    return max(sum(h[s : s + size]) for h in hits for s in range(len(i) - size + 1))


def test_hits_are_counted_without_rows_of_their_words(spark):
    """A row for every hit held all words of the document, and those of one document were held together: a text of 1 MB filled an executor."""
    docs, items = cases()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = D.leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS))
        plan = found._jdf.queryExecution().executedPlan().toString()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(found._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = [re.search(r"\*\((\d+)\) " + node, plan) for node in (r"HashAggregate\(.*partial_max", "BroadcastHashJoin", "Generate posexplode")]
    assert all(stages) and len({m[1] for m in stages}) == 1
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))  # larger methods are never compiled


@pytest.mark.parametrize("window", [5, 13, 40])
@pytest.mark.parametrize("most", [D.MAX_BROADCAST_BYTES, 60_000, 0])
def test_equal_words_of_every_window_size_and_join(spark, window, most):
    """Long texts with many hits, by seeds with words, by seeds alone and by a shuffle of all."""
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(900)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([6, 13, 39, 41, 60])))) for k in range(12)]
    docs = []
    for k in range(5):
        body = [word() for _ in range(60)]
        for _ in range(5):
            leak = tokens(rng.choice(items)[1])
            for at in rng.sample(range(len(leak)), len(leak) // 12):
                leak[at] = "changed"
            body += [*leak, word()]
        docs.append((k, " ".join(body)))
    found = D.leaks(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*i, "z") for i in items], ITEMS), window=window, max_broadcast=most)
    assert most in (0, D.MAX_BROADCAST_BYTES) or "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["window"]) for r in found.collect()}
    sizes = {item: min(window, len(tokens(text))) for item, text in items}
    want = {(d, i): (most_equal(text, itext, window), sizes[i]) for d, text in docs for i, itext in items}
    assert got == {k: (m, n) for k, (m, n) in want.items() if m >= (n if n < 6 else 0.8 * n)} and len(got) > 10


def test_a_long_document_with_many_hits(spark):
    leak = " ".join(f"k{j}" for j in range(13))
    text = " ".join(f"{leak} w{k} " + " ".join(f"v{(k * j) % 997}" for j in range(40)) for k in range(1500))
    docs = spark.createDataFrame([(1, text, "x", "y"), (2, text.replace("k3 ", "c3 "), "x", "y"), (3, "none of it", "x", "y")], DOCS)
    items = spark.createDataFrame([(7, leak, "z"), (8, leak.replace("k12", "other"), "z"), (9, " ".join(f"n{j}" for j in range(13)), "z")], ITEMS)
    got = sorted((r["doc_id"], r["item_id"], r["matched"], r["window"]) for r in D.leaks(docs, items).filter(F.col("window") == 13).collect())
    assert got == [(1, 7, 13, 13), (1, 8, 12, 13), (2, 7, 12, 13), (2, 8, 11, 13)]

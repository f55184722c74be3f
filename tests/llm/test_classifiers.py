"""Toxicity and quality: contract columns by brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np

from tidepanel.llm import quality as Q
from tidepanel.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, score string, lang string", "doc_id long, quality int, toxic int, text string"
EDGES = [(None, "plain words"), (9000, None), (9001, ""), (9002, "vilework " * 3000), (5, "again plain")]


def corpus(n=500):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(n):
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randrange(60, 120))]
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vile", "VILEWORK", "nasty,", "vilest"])
        if bad:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        docs.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(*d, "s", "l") for d in docs + EDGES], DOCS), spark.createDataFrame([(*x, "t") for x in labels] + [(None, 1, 1, "t"), (9999, None, None, "t")], LABELS), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = frames(spark)
    out = T.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count()
    of = {k: t for k, _, t in truth}
    for r in out:
        assert r["held_out"] == (zlib.crc32(("" if r["id"] is None else str(r["id"])).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], of[r["id"]]) for r in out if r["held_out"] and r["id"] in of]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_toxic_rows_go_and_columns_stay(spark):
    docs, labels, truth = frames(spark)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {k for k, _, t in truth if not t}
    assert len(ids & clean) / len(clean) > 0.97 and len(ids & {k for k, _, t in truth if t}) < 10
    assert {None, 9000, 9001} <= ids


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels, _ = frames(spark)
    held = T.is_held_out("doc_id", 4, 2)
    flipped = labels.withColumn("toxic", T.F.when(held, 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = ({r["id"]: r["score"] for r in T.toxicity_scores(docs, x).filter("id < 500").collect()} for x in (labels, flipped))
    assert a == b


def test_risk_estimator_ignores_positives_hidden_in_the_unlabelled():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    x = np.where(y[:, None], rng.random((4000, 6)) < 0.8, rng.random((4000, 6)) < 0.2).astype(np.float32)
    w, bias = T.fit_nnpu(x[:2000][y[:2000]], x[2000:], 0.3)
    assert ((x @ w + bias > 0) == y).mean() > 0.95


def test_risk_and_gradient_match_direct_computation():
    rng = np.random.default_rng(5)
    xp, xu = (np.hstack([rng.integers(0, 2, (n, 5)), np.ones((n, 1))]) for n in (30, 70))
    w, prior = rng.normal(size=6), 0.3

    def direct(w):
        loss = lambda z: np.log(1 + np.exp(-z))
        of = lambda rows, sign: sum(loss(sign * sum(a * b for a, b in zip(r, w, strict=True))) for r in rows) / len(rows)
        return prior * of(xp, 1), of(xu, -1) - prior * of(xp, -1)

    marked, rest, grad_marked, grad_rest = T.risk_parts(w, xp, xu, prior)
    assert np.allclose((marked, rest), direct(w))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        up, down = direct(w + step), direct(w - step)
        assert np.allclose([grad_marked[k], grad_rest[k]], [(a - b) / 2e-6 for a, b in zip(up, down, strict=True)], atol=1e-6)


def test_a_model_that_learnt_nothing_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "vile", "s", "l"), (2, "fine", "s", "l")], DOCS)
    labels = spark.createDataFrame([(1, 1, 1, "t"), (2, 1, 0, "t")], LABELS)
    assert {r["doc_id"] for r in T.drop_toxic(docs, labels).collect()} == {1, 2}


def test_quality_features_match_direct_computation():
    rng = random.Random(2)
    size = 1 << Q.BITS
    for _ in range(100):
        text = "".join(rng.choice(["ab ", "b", "é", "日本", "\n", "😀 ", " "]) for _ in range(rng.randrange(30)))
        words = [zlib.crc32(w) for w in text.encode().split()]
        m = (1 << 32) - 1
        pairs = [((a * 0x9E3779B1 & m ^ b) * 0x85EBCA77 & m) >> 32 - Q.BITS for a, b in zip(words, words[1:], strict=False)]
        c = [ord(x) for x in text]
        grams = [(((x * 0x85EBCA77 & m ^ y) * 0xC2B2AE3D & m ^ z) * 0x9E3779B1 & m) >> 32 - Q.BITS for x, y, z in zip(c, c[1:], c[2:], strict=False)]
        want = {}
        for k, part in enumerate(([w & size - 1 for w in words], pairs, grams)):
            for h in part:
                want[k * size + h] = want.get(k * size + h, 0) + 1 / len(part)
        i, x = Q.features(text)
        assert dict(zip(i.tolist(), (x**2).round(9).tolist(), strict=True)) == {k: round(v, 9) for k, v in want.items()}


def test_no_positive_labels_and_no_rows(spark):
    docs, labels, _ = frames(spark)
    scores = {r["score"] for r in T.toxicity_scores(docs, labels.filter("toxic = 0")).collect()}
    assert len(scores) == 1
    assert T.toxicity_scores(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    assert Q.quality(spark.createDataFrame([], DOCS), Q.fit(docs, spark.createDataFrame([], LABELS))).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(x in lines[:i] and bool(re.search(r"[^\x20\x09-\x0D]", x)) for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(often)


def test_rule_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", "é# ", "x|y ", "\t", " ", "\n\n"]) for _ in range(rng.randrange(60)))
        assert Q.rule_counts(text) == brute_counts(text)


def test_quality_verdicts(spark):
    docs, labels, truth = frames(spark)
    out = Q.quality(docs, Q.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    good = {k: q for k, q, _ in truth}
    judged = [(r["kept"], good[r["id"]]) for r in out if r["id"] in good and not r["base_failed"]]
    assert sum(k == bool(g) for k, g in judged) / len(judged) > 0.95
    by = {r["id"]: r for r in out}
    assert by[9001]["base_failed"] and by[9000]["n_words"] == 0
    assert by[9002]["base_failed"] and by[9002]["n_repeat_words"] == 3000

"""Substring and line dedup against direct computations."""

from __future__ import annotations

import random

from tidepanel.llm import line_dedup as L
from tidepanel.llm import spans
from tidepanel.llm import substring_dedup as U

SCHEMA = "doc_id long, text string, start string, row string"


def texts():
    rng = random.Random(4)
    sentence = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    boiler = "All rights are reserved here."
    rows = []
    for k in range(40):
        lines = [" ".join(sentence(rng.randrange(2, 12)) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6))]
        if k % 5 == 0:
            lines[-1] += " " + passage
        if k % 2:
            lines.append(boiler)
        rows.append((k, "\n".join(lines)))
    return passage, [*rows, (100, rows[7][1]), (7, rows[7][1]), (None, rows[5][1]), (200, None), (201, ""), (202, "\n\n . "), (203, "x " * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)


def brute_units(rows):
    first, out = {}, {}
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in distinct:
        flags = []
        for s, e, w in U.units(text or ""):
            key = " ".join(w)
            flags.append((s, e, len(w), key in first))
            first.setdefault(key, doc)
        runs, now = [], []
        for f in [*flags, (0, 0, 0, False)]:
            if f[3]:
                now.append(f)
            elif now:
                if sum(x[2] for x in now) >= U.MIN_WORDS:
                    runs.append((now[0][0], now[-1][1]))
                now = []
        out[doc] = runs
    return out


def test_repeated_passages(spark):
    passage, rows = texts()
    got = {}
    for r in U.repeated_spans(frame(spark, rows)).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    want = {d: s for d, s in brute_units(rows).items() if s}
    assert {d: sorted(s) for d, s in got.items()} == want
    assert {5, 10, 15, 100, None} <= set(got) and 0 not in got


def test_removed_offsets_point_into_the_original(spark):
    passage, rows = texts()
    out = U.drop_repeats(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    of = {}
    for i, t in rows:
        of.setdefault(i, t)
    for r in out:
        t = of[r["doc_id"]]
        rest, at = "", 0
        for s, e in r["removed_spans"]:
            rest, at = rest + t[at:s], e
        assert r["text"] == (rest + t[at:] if t is not None else None)
        assert r["start"] == "a"
    assert sum(passage[:40] in (r["text"] or "") for r in out) == 1


def brute_chunks(rows):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e, n in L.chunks(text or ""):
            body = (text or "")[s:e].rstrip("\n")
            if n > 1 and body:
                if body in seen:
                    out.setdefault(doc, []).append((s, e))
                seen.setdefault(body, doc)
    return out


def line_rows():
    rng = random.Random(8)
    shared = [f"shared line {k} é" for k in range(30)]
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(4))] + shared[rng.randrange(5) : 20 + rng.randrange(10)] + [f"tail {k}"] * rng.randrange(3))) for k in range(30)]
    return [*rows, (3, rows[3][1]), (None, rows[4][1]), (99, None), (98, ""), (97, "\n\n\n\n"), (96, "one line")]


def test_repeated_chunks(spark):
    rows = line_rows()
    got = {}
    for r in L.repeated_chunks(frame(spark, rows)).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    assert {d: sorted(s) for d, s in got.items()} == brute_chunks(rows)
    assert sum(len(s) for s in got.values()) > 40


def brute_runs(rows):
    """The repeated lines of each document, from all pairs of lines in order."""
    first, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").splitlines()
        gone = set()
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(pair):
                at = first.setdefault(pair, (doc, k))
                gone |= set() if at == (doc, k) else {k + 1} if at == (doc, k - 1) else {k, k + 1}
        out[doc] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_every_repeated_run_goes_whatever_stands_around_it(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(rng.randrange(1, 5))] + [f"shared {k // 2} {j}" for j in range(2 + k // 2 % 4)] + [f"tail {k} {j}" for j in range(rng.randrange(3))])) for k in range(40)]
    rows += [*line_rows()[:20], (50, "same\nsame\nsame\nsame"), (51, "a\nb\na\nb\na"), (52, "\n\n\n\n"), (None, rows[4][1]), (99, None)]
    rows = [(k + 1000 if n >= 40 and k is not None and k < 40 else k, t) for n, (k, t) in enumerate(rows)]
    got = {r["doc_id"]: [x for x in (r["text"] or "").splitlines()] for r in L.drop_repeated_runs(frame(spark, rows)).collect()}
    assert got == brute_runs(rows)
    assert all(x.startswith(("own", "tail")) for k in range(1, 40, 2) for x in got[k])
    assert got[50] == ["same", "same"] and got[51] == ["a", "b"]


def test_runs_are_equal_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(L.xxhash, "xxh128_digest", lambda _: bytes(16))
    assert L.repeated_runs(frame(spark, [(1, "a\nb\nc\nd"), (2, "e\nf\ng\nh")])).collect() == []
    assert L.repeated_runs(frame(spark, [])).collect() == []


def test_chunks_cover_text_and_resist_shifts():
    text = "\n".join(f"line {k}" for k in range(200))
    parts = list(L.chunks(text))
    assert "".join(text[s:e] for s, e, _ in parts) == text
    moved = "inserted\n" + text
    a = {text[s:e] for s, e, _ in parts}
    b = {moved[s:e] for s, e, _ in L.chunks(moved)}
    assert len(a & b) > 0.8 * len(a)


def test_digests_alone_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(L.xxhash, "xxh128_digest", lambda _: bytes(16))
    rows = [(1, "a\nb\nc\nd"), (2, "e\nf\ng\nh")]
    assert L.repeated_chunks(frame(spark, rows)).collect() == []


def test_cut_and_empty(spark):
    df = frame(spark, [(1, "abcdef"), (2, None)])
    row = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string").select(spans.row_key("doc_id", "text")).first()[0]
    out = spans.cut(df, spark.createDataFrame([(row, 1, 3), (row, 4, 6)], "row long, start int, end int"))
    assert sorted(r["text"] or "" for r in out.collect()) == ["", "ad"]
    for f in (U.repeated_spans, L.repeated_chunks, U.drop_repeats, L.drop_repeated_chunks):
        assert f(frame(spark, [])).collect() == []

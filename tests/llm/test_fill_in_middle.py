"""Fill-in-middle forms against a plain construction over lists of units, and exact ways back."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidepanel.llm import fill_in_middle as M
from tidepanel.llm import queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_way(doc_id, text):
    """The form by its definition: units joined to segments, segments joined to the output."""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h3 % 100 >= 90 or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def samples():
    rng = random.Random(4)
    letters = "abcXYZ  \n.<>PSM/é日😀\x00́ß1"
    out = ["", " ", "a", "é", "日本", "<", "<P", "P><S", "<P>", "a<S>b", "x<M", "<<P", "word " * 30_000, "😀" * 999]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2_000)]


def test_forms_equal_the_plain_construction():
    seen = set()
    for k, text in enumerate(samples()):
        n, form, prefix, middle, output = M.transformed(text.encode(), k)
        body = text.encode()
        chars = (None, None) if form == "plain" else (len(body[:prefix].decode()), len(body[prefix : prefix + middle].decode()))
        assert (n, form, *chars, output.decode()) == plain_way(k, text)
        assert M.restored(output, form).decode() == text
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


@pytest.mark.parametrize("cuts", [(0, 0, 0), (0, 3, 3), (2, 2, 9), (1, 4, 8), (0, 5, 10), (3, 10, 10)])
def test_rotation_exchanges_two_blocks(cuts):
    i, m, j = cuts
    block = bytearray(b"0123456789")
    M.rotate(block, i, m, j)
    assert bytes(block) == b"0123456789"[:i] + b"0123456789"[m:j] + b"0123456789"[i:m] + b"0123456789"[j:]


def test_frames(spark):
    rows = [(7, "Hello, world"), (7, "Hello, world"), (None, "x y"), (3, None), (4, ""), (5, "a<M>b")]
    docs = spark.createDataFrame([(i, t, "f", "o") for i, t in rows], "doc_id long, text string, form string, output string")
    out = M.fill_in_middle(docs)
    back = M.restore(out).collect()
    assert sorted((r["id"] or 0, r["restored"]) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert {r["id"]: r["form"] for r in back if r["id"] in (3, 4, 5)} == {3: "plain", 4: "plain", 5: "plain"}
    assert M.fill_in_middle(docs.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, None, None), (2, "other", "t")], "id long, form string, output string")
    assert {r["id"]: r["restored"] for r in M.restore(odd).collect()} == {1: "", 2: "t"}
    assert M.restore(out.withColumnRenamed("output", "restored"), output_col="restored").columns.count("restored") == 1


def test_query_equals_the_plain_construction(spark):
    data = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        n, form, p, m, output = plain_way(r["doc_id"], r["text"] or "")
        want[r["doc_id"]] = (n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = queries.op13_fill_in_middle(spark, data).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in got} == want

"""Byte-level BPE against the public library, joins of chunks at every place, reuse of chunks, exact round trips."""

from __future__ import annotations

import hashlib
import random
from array import array

import pytest

tokenizers = pytest.importorskip("tokenizers")
from tidepanel.llm import bpe_codec as B  # noqa: E402
from tidepanel.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def v():
    return B.load().ready()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.MODEL_PATH)


def ids_of(text, v, special=True):
    return array("i", B.encode(text, v, special)).tolist()


def samples():
    rng = random.Random(12)
    letters = "abcdetheing   're'll'd'S.,!?\n\t\r  éüß日本😀́123٣ⅷ<|endoftext|>$"
    out = ["", " ", "   ", "\n \n", "a" * 5000, " " * 3000 + "x", "=" * 4999, "it's we'll they're I'd'", "<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|> c", "x\x00\x7f\x1c\x85y"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(1500)]
    return out + ["".join(rng.choice(["the ", "don't", "  ", "\n", "12", "é", "<|endoftext|>", "word", "'", "日"]) for _ in range(3000)) for _ in range(20)]


@pytest.mark.parametrize("sizes", [(64, 4096, 192), (1, 7, 2), (3, 3, 1)])
def test_ids_equal_the_library(v, library, monkeypatch, sizes):
    for name, value in zip(("MIN_BYTES", "MAX_BYTES", "DIVISOR"), sizes, strict=True):
        monkeypatch.setattr(B, name, value)
    for t in samples():
        ids = ids_of(t, v)
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert B.decode(ids, v) == t == library.decode(ids, skip_special_tokens=False)


def test_special_tokens_as_plain_text(v):
    library = tokenizers.Tokenizer.from_file(B.MODEL_PATH)
    library.encode_special_tokens = True
    for t in samples():
        assert ids_of(t, v, special=False) == library.encode(t, add_special_tokens=False).ids


def test_every_character_is_split_as_by_the_library(v, library):
    for first in range(0, 0x110000, 512):
        text = "".join(f"a{c}{c}1{c} x" for c in map(chr, range(first, first + 512)) if not "\ud800" <= c <= "\udfff")
        assert ids_of(text, v) == library.encode(text, add_special_tokens=False).ids, hex(first)


def test_long_parts(v, library, monkeypatch):
    monkeypatch.setattr(B, "PART_CHARS", 50)
    for t in samples()[:400]:
        assert ids_of(t, v) == library.encode(t, add_special_tokens=False).ids


def test_a_shared_passage_is_encoded_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000))
    v = B.load().ready()
    B.encode(passage, v)
    once = v.encoded
    for k in range(50):
        B.encode(f"{k} other words stand here {k * 7} " + passage[k:] + f" and there {k}", v)
    assert once > 50
    assert v.encoded < once + 50 * 4  # only the chunks at both ends are new


def test_bounds_follow_the_content():
    rng = random.Random(8)
    text = "".join(rng.choice("abc déf\n日") for _ in range(20_000))
    a, b = B.bounds(text), B.bounds("xyz" + text)
    assert len(set(a) & {k - 3 for k in b}) > 0.95 * len(a)
    assert a[-1] == len(text) and B.bounds("") == []


def test_frames(spark, v):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, sketch int, turn int")
    out = B.encoded(docs, v)
    assert sorted((r["id"] or 0, r["ids"]) for r in out.collect()) == sorted((i or 0, ids_of(t or "", v)) for i, t in rows)
    back = sorted((r["id"] or 0, r["text"]) for r in B.decoded(out, v).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    odd = spark.createDataFrame([(1, [None, -1, 10**6, 15496]), (2, None)], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in B.decoded(odd, v).collect()} == {1: "Hello", 2: ""}
    assert {r["id"]: r["n_tokens"] for r in B.digests(odd, v).collect()} == {1: 3, 2: 0}
    assert B.encoded(docs.limit(0), v).collect() == []


def test_query_equals_the_library(spark, library):
    data = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = queries.op12_bpe_codec(spark, data).collect()
    assert len(got) == len(want)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want

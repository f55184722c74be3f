"""Encoding against the public library's, streaming commits, and exact round trips."""

from __future__ import annotations

import random
from array import array

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
from tidepanel.llm import sentencepiece_codec as S  # noqa: E402


@pytest.fixture(scope="module")
def v():
    return S.load().ready()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)


def ids_of(text, v):
    return array("i", S.encode(text, v)).tolist()


def samples():
    rng = random.Random(6)
    letters = "abcdefghij theon ingre  .,!'\n\t▁éüß😀*$<>/\\0123XYZ"
    out = ["", " ", "   ", "\n", "▁", "<s> <0x41> </s>", "a" * 3000, "abcdefghijklmnopqrstuvwxyz" * 80, " " * 700 + "x", "\x00\x7f", "日本語 текст"]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(1500)]


@pytest.mark.parametrize("part", [S.PART_CHARS, 7])
def test_ids_equal_the_library(v, library, monkeypatch, part):
    monkeypatch.setattr(S, "PART_CHARS", part)
    for t in samples():
        ids = ids_of(t, v)
        assert ids == library.encode(t), t
        assert S.decode(ids, v) == t.replace("▁", " ")


def test_whole_words_are_not_split_where_pieces_mix_letters_and_others(v):
    mixed = S.Vocabulary(v.ids | {"a.": 1}, v.pieces, v.scores, v.byte_ids, v.surface, v.longest, v.alone, b"")
    assert S.unit_pattern(mixed).findall("▁▁ab.c▁d") == ["▁▁ab.c", "▁d"]
    assert v.pattern.findall("▁▁ab.c▁d") == ["▁▁ab", ".", "c", "▁d"]


def test_stream_commits_across_ordinary_words(v, library):
    rng = random.Random(3)
    words = ["the", "quick", "extraordinarily", "misunderstanding", "fox", "jumped", "over", "counterrevolutionaries"]
    text = " ".join(rng.choice(words) for _ in range(150_000))
    assert len(text) > 1_000_000
    held = []
    real = S._meet

    def watch(last, depth, v):
        held.append(len(last))
        return real(last, depth, v)

    S._meet = watch
    try:
        runs = list(S.stream("▁" + text.replace(" ", "▁"), v))
    finally:
        S._meet = real
    assert [k for r in runs for k in r] == library.encode(text)
    sizes = [sum(len(v.pieces[k]) for k in r) for r in runs]
    assert max(sizes) <= 2 * v.longest + 1  # commits come every few words
    assert max(held) <= 2 * v.longest + 1  # and no more than two windows are ever held


def test_stream_commits_inside_one_long_word(v, library):
    text = "theoningreaswhichhave" * 3000
    runs = list(S.stream("▁" + text, v))
    assert [k for r in runs for k in r] == library.encode(text)
    assert max(sum(len(v.pieces[k]) for k in r) for r in runs) <= 2 * v.longest + 1


def test_frames(spark, v):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, "x"), (2, None), (3, "")]
    out = S.encoded(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string"), v)
    got = out.collect()
    assert sorted((r["id"] or 0, r["n_ids"], r["exact"]) for r in got) == sorted((i or 0, len(ids_of(t or "", v)), True) for i, t in rows)
    back = {r["id"]: r["text"] for r in S.decoded(out, v).collect()}
    assert back == {1: "Hello  world", None: "x", 2: "", 3: ""}
    odd = spark.createDataFrame([(1, [None, -1, 10**6, 29871, 22172]), (2, None)], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in S.decoded(odd, v).collect()} == {1: S.decode([29871, 22172], v), 2: ""}
    assert S.encoded(spark.createDataFrame([], "doc_id long, text string"), v).collect() == []

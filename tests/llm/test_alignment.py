"""Alignment against common byte offsets by sets, links and corpus counts by plain counting over both libraries' ids."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from tidepanel.llm import alignment as A  # noqa: E402
from tidepanel.llm import bpe_codec, queries, sentencepiece_codec  # noqa: E402


class Brute:
    """Everything by its definition, from the libraries' ids."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(bpe_codec.MODEL_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
        letters = bpe_codec.byte_letters()
        self.bytes_a = {k: bytes(letters[c] for c in p) for p, k in self.a.get_vocab(with_added_tokens=False).items() if p != "<|endoftext|>"}

    def bytes_b(self, k):
        p = self.b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return [], [], []
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        parts_a, parts_b = [self.bytes_a[k] for k in ids_a], [self.bytes_b(k) for k in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            return [], [], []
        return ids_a, ids_b, by_sets(ids_a, list(map(len, parts_a)), ids_b, list(map(len, parts_b)))

    def rows(self, all_texts):
        found = [self.groups(t or "") for t in all_texts]
        links = [[(x, y) for a, b in g for x in a for y in b] for _, _, g in found]
        count = Counter(p for one in links for p in set(one))
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        for (ids_a, ids_b, g), one in zip(found, links, strict=True):
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
            best = sum(count[p] == most[p[0]] for p in one)
            yield len(ids_a), len(ids_b), len(g), len(one), best, sum(count[p] for p in one), hashlib.sha256(text.encode()).hexdigest() if g else ""


def by_sets(ids_a, sizes_a, ids_b, sizes_b):
    def ends(sizes):
        out, at = [], 0
        for s in sizes:
            at += s
            out.append(at)
        return out

    ends_a, ends_b = ends(sizes_a), ends(sizes_b)
    cuts, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for c in cuts:
        p, q = ends_a.index(c, i) + 1, ends_b.index(c, j) + 1
        out.append((ids_a[i:p], ids_b[j:q]))
        i, j = p, q
    return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.fixture(scope="module")
def models():
    return A.load()


def test_groups_equal_common_ends():
    rng = random.Random(11)
    for _ in range(3000):
        total = rng.randrange(1, 60)
        ends = [sorted({*rng.sample(range(1, total + 1), rng.randrange(0, total)), total}) for _ in range(2)]
        if rng.random() < 0.5:  # long stretches of equal tokens
            ends = [[*range(1, 200), *(199 + e for e in x)] for x in ends]
        sizes = [[y - x for x, y in zip([0, *e], e, strict=False)] for e in ends]
        ids = [list(range(len(e))) for e in ends]
        got, i, j = [], 0, 0
        for a, p, b, q in [*A.irregular_groups(*map(np.array, ends)), (len(ends[0]), 0, len(ends[1]), 0)]:
            got += [([x], [y]) for x, y in zip(range(i, a), range(j, b), strict=True)] + ([(list(range(a, p)), list(range(b, q)))] if p else [])
            i, j = p, q
        assert got == by_sets(ids[0], sizes[0], ids[1], sizes[1])
    assert A.irregular_groups(np.zeros(0, int), np.zeros(0, int)) == []


def samples():
    rng = random.Random(13)
    parts = ["the ", "extraordinarily ", "don't", "  ", "\n", "日本", "é", "😀", "x▁y", "<|endoftext|>", "12,000", "=====", "tionwhen ", "<0x41>"]
    out = [None, "", " ", "▁", "a", "a", "日本語 текст", "=" * 700, "\x00\x7f", " " * 300]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300)]


@pytest.mark.parametrize(("most", "group"), [(1 << 19, 1 << 16), (40, 2), (0, 1 << 16)])
def test_rows_equal_brute_force(spark, brute, models, monkeypatch, most, group):
    monkeypatch.setattr(A, "GROUP_PAIRS", group)
    all_texts = samples()
    docs = spark.createDataFrame([(k if k % 7 else None, t, "r", "p") for k, t in enumerate(all_texts)], "doc_id long, text string, row string, pairs string").repartition(3)
    got = sorted(((r["id"] if r["id"] is not None else -1), *list(r)[1:]) for r in A.linked(docs, models, most=most).collect())
    want = sorted((k if k % 7 else -1, *r) for k, r in enumerate(brute.rows(all_texts)))
    assert got == want


def test_units_encode_as_whole_texts(brute, models, monkeypatch):
    rng = random.Random(17)
    letters = [*"   ", "\n", "\t", "\r", "a", "Z", "é", "日", "'s", "'", "7", ".", "▁", "\xa0", "\x85", "\x1c", "\x1f", "\u3000", "\u2028", "\u200b", "\u180e", "\x00", "\u0301", "<s>", "<0x41>"]
    all_texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)]
    want = [brute.groups(t)[:2] for t in all_texts]
    for known, part in ((400_000, 1 << 20), (50, 5)):
        monkeypatch.setattr(A, "KNOWN_UNITS", known)
        monkeypatch.setattr(A, "PART_CHARS", part)
        both = A.Aligner(models)
        got = [ids for at in range(0, len(all_texts), 64) for ids in both.tokens(all_texts[at : at + 64])]
        assert [(a.tolist(), b.tolist()) for a, b in got] == want


def test_units_seen_before_are_not_encoded_again(models, monkeypatch):
    seen = []
    listed = bpe_codec.encode_listed
    monkeypatch.setattr(bpe_codec, "encode_listed", lambda new, v: seen.extend(new) or listed(new, v))
    both = A.Aligner(models)
    both.tokens(["the cat, sat", "on the\nmat"])
    both.tokens(["sat on sat the cat,"])
    assert sorted(seen) == ["cat,", "on", "sat", "the", "the\nmat"]


def test_empty_table_and_tables_without_tokens(spark, models):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "▁")], "doc_id long, text string")
    assert [tuple(r) for r in A.linked(docs, models).orderBy("id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 2, 3)]
    assert A.linked(docs.limit(0), models).collect() == []


def test_query_equals_brute_force(spark, brute):
    data = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r["doc_id"], *x) for r, x in zip(rows, brute.rows([r["text"] for r in rows]), strict=True))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in queries.op11_token_alignment(spark, data).collect()) == want

"""SimHash classes against brute force, and the defined edge cases."""

from __future__ import annotations

import random

import pytest
import xxhash

from tidepanel.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string"


def brute_print(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, prints[i], least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def classes(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in simhash.simhash_classes(df).collect()), key=str)


def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}É" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else "x" for w in base)) for i in range(80)]
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    return rows + [(7, rows[3][1]), (None, rows[4][1]), (900, None), (901, ""), (902, " \t\x0b\n"), (903, "A B"), (903, "a b"), (904, "only one"), (None, "alone here now")]


def test_classes_match_brute_force(spark):
    assert classes(spark, near_rows()) == brute_classes(near_rows())


def test_one_row_of_each_class_stays(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    found = [(r[0], r[1]) for r in kept.collect()]
    assert set(found) <= set(rows)
    whole = brute_classes(rows)
    assert len(found) == len({(c if c is not None else ("null", p)) for _, p, c in whole})
    assert sorted(i for i, _ in found if i is not None) == sorted({c for _, _, c in whole if c is not None})


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 5, 1])
def test_links_cover_dense_balls(spark, bucket):
    rng = random.Random(1)
    centre = rng.getrandbits(63)
    prints = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)}
    prints |= {(centre & 0xFFFFFFFF) | rng.getrandbits(31) << 32 for _ in range(60)}  # one segment in common, all else not
    prints = sorted(prints | {p - (1 << 63) for p in list(prints)[:40]})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    pairs = {(r[0], r[1]) for r in simhash.near_links(df, bucket).collect()}

    def apart(u, v):
        return ((u ^ v) & (1 << 64) - 1).bit_count()

    assert all(apart(u, v) <= 2 for u, v in pairs)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        root[find(u)] = find(v)
    for i, u in enumerate(prints):
        for v in prints[:i]:
            if apart(u, v) <= 2:
                assert find(u) == find(v)


def test_looked_up_fingerprints_can_be_too_far(spark):
    near, far = 0b111 << 32, 0b1 << 40
    df = spark.createDataFrame([(0,), (near,), (far,)], "fingerprint long")
    met = {tuple(sorted((r["u"], r["v"]))) for r in simhash.probes(df).selectExpr("key", "fingerprint u").join(simhash.segment_tables(df).selectExpr("key", "fingerprint v"), "key").collect()}
    assert (0, near) in met  # the lower segment is equal
    assert {tuple(sorted(r)) for r in simhash.near_links(df).collect()} == {(0, far)}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8), (2, "a b c", 9, 10)], "doc_id long, text string, keep_row int, __row int")
    assert [tuple(r) for r in simhash.drop_near_copies(df).collect()] == [(1, "a b c", 7, 8)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_classes(df).collect() == []
    assert simhash.drop_near_copies(df).collect() == []

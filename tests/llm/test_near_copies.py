"""Near copies of the pipeline's stage against exact similarities of all pairs."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import corpus_pipeline as P
from tidepanel.llm import near_copies as N

SCHEMA = "doc_id long, text string, fingerprint string"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}


def brute_kept(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


def test_planted_near_copies_go(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, planted = [], []
    for k in range(60):
        words = fresh(200)
        rows.append((k, " ".join(words)))
        # each changed word takes five shingles of 196 from both sides: 2 to 4 give 0.90 to 0.81, 5 to 8 less than 0.8
        for at in rng.sample(range(5, 190, 10), 2 + k % 7):
            words[at] = f"changed{k}"
        rows.append((100 + k, " ".join(words)))
        planted += [100 + k] if k % 7 <= 2 else []
    rows += [(300, "short"), (301, "SHORT"), (302, None), (303, ""), (304, "a b c d e f"), (305, "a b c d e g"), (306, " ".join(fresh(6)))]
    out = P.near_dedup(spark, spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA), "")
    assert out.columns == ["doc_id", "text", "fingerprint"]
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == brute_kept(rows)
    assert not set(planted) & set(kept) and len(planted) > 20


def test_empty_table(spark):
    assert P.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_pairs_of_crowded_bands_cross_roots(spark):
    rng = random.Random(5)
    rows = [(k, k % 7, [100 * b + rng.randrange(12) for b in range(3)] + [400 + k % 2]) for k in range(60)]
    got = {(r["u"], r["v"]) for r in N.crossing(spark.createDataFrame(rows, "node long, root long, bands array<long>"), 10).collect()}
    size = Counter(c for _, _, bands in rows for n in (1, 2) for c in itertools.combinations(sorted(bands), n))
    root = {node: r for node, r, _ in rows}
    small = set()
    for (a, ra, x), (b, rb, y) in itertools.combinations(rows, 2):
        common = sorted(set(x) & set(y))
        groups = [(c,) for c in common] + [c for c in itertools.combinations(common, 2) if any(size[(k,)] > 10 for k in c)]
        if ra != rb and any(size[g] <= 10 for g in groups):
            small.add((a, b))
    assert small <= got and all(u < v and root[u] != root[v] for u, v in got)
    assert max(size[(400,)], size[(401,)]) > 10


def test_classes_of_crowded_bands_are_whole(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(220)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(5, 210, 5), rng.choice([3, 5, 6, 7])):
            words[at] = f"changed{k}"
        rows.append((k, " ".join(words)))
    out = P.near_dedup(spark, spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == brute_kept(rows)


def test_columns_of_any_name_pass_through(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:59] + ["other"])), (4, "short text"), (None, None)]
    names = ["keep_row", "__row", "__kept", "row", "root", "rank", "id", "node"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = N.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 4]


def test_fingerprints_link_what_shingle_sets_do_not(spark):
    """A passage repeated 40 times decides the fingerprint, while the different ends decide the sets of shingles."""
    body = " ".join([f"b{k}" for k in range(11)] * 40)
    rows = [(k, body + " " + " ".join(f"e{k}x{j}" for j in range(14))) for k in range(3)] + [(9, " ".join(f"o{k}" for k in range(200)))]
    assert len(brute_kept(rows)) == 4
    out = P.near_dedup(spark, spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 9]


def test_large_groups_are_parted_by_each_two_bands_once(spark):
    """Every node has the same 16 large bands: 120 pairs of bands a node, none of them twice, and only three partners in each."""
    rows = [(k, k, list(range(16))) for k in range(80)]
    df = spark.createDataFrame(rows, "node long, root long, bands array<long>")
    made = []
    real, N._by_size = N._by_size, lambda entries, crowd: made.append(entries.count()) or real(entries, crowd)
    try:
        pairs = N.crossing(df, 10).count()
    finally:
        N._by_size = real
    assert made == [80 * 16, 80 * 120]
    assert 79 <= pairs <= 3 * 80


def sketches_of(texts):
    return [N.sketch(N.shingles(t.encode())).tolist() for t in texts]


def test_sketches_leave_all_similar_pairs_and_few_others(spark):
    """90 texts share four least values and none is like another but three pairs: 4,005 pairs were read and compared."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(3000)}" for _ in range(220)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.sample(range(5, 210, 5), 12):
            words[at] = f"changed{k}"
        texts.append(words)
    for k in range(3):
        texts[80 + k] = [*texts[k][:-1], "end"]
    texts = [" ".join(w) for w in texts]
    rows = [(k, k, [1, 100 + k // 50], s) for k, s in enumerate(sketches_of(texts))]
    df = spark.createDataFrame(rows, "node long, root long, bands array<long>, sketch array<long>")
    like = {(k, 80 + k) for k in range(3)}
    assert {(r["u"], r["v"]) for r in N.crossing(df, 100).collect()} == like
    assert N.crossing(df.drop("sketch"), 100).count() == 4005


def test_sketches_hold_at_the_bound_of_the_similarity(spark):
    """Random sets around a similarity of 0.8, small, large and empty: whatever is similar stays."""
    rng = random.Random(4)
    rows, similar = [], 0
    for _ in range(400):
        size = rng.choice([1, 2, 9, 40, 300, 5000])
        one = {rng.getrandbits(64) for _ in range(size)}
        changed = rng.randrange(size // 5 + 2)
        other = set(sorted(one)[changed:]) | {rng.getrandbits(64) for _ in range(rng.choice([0, changed // 2, changed]))}
        like = 5 * len(one & other) >= 4 * len(one | other)
        similar += like
        rows.append((like, *(N.sketch(N.np.array(sorted(x), dtype="<u8")).tolist() for x in (one, other))))
    df = spark.createDataFrame(rows, "like boolean, a array<long>, b array<long>")
    assert similar > 100 and df.filter("like").filter(~N.may_be_similar("a", "b")).count() == 0
    assert df.filter("not like").filter(~N.may_be_similar("a", "b")).count() > 50


def test_all_pairs_of_large_bands_cross_roots(spark):
    """80 nodes of different roots share all bands: each got three partners of 79."""
    rows = [(k, k, list(range(16))) for k in range(80)]
    got = [(r["u"], r["v"]) for r in N.rest(spark.createDataFrame(rows, "node long, root long, bands array<long>"), 10, 7).collect()]
    assert sorted(got) == list(itertools.combinations(range(80), 2))


def test_a_large_band_with_a_main_root_is_compared_across_roots_only(spark):
    rng = random.Random(2)
    root = {k: rng.choice([0, 0, 0, 0, 1, 2, 100 + k]) for k in range(150)}
    bands = {k: [k % 2, 7, 1000 + k // 9] for k in root}
    rows = [(k, root[k], bands[k]) for k in root]
    want = {(u, v) for u, v in itertools.combinations(root, 2) if root[u] != root[v]}
    for block in (1, 4, 10, 1000):
        got = [(r["u"], r["v"]) for r in N.rest(spark.createDataFrame(rows, "node long, root long, bands array<long>"), 20, block).collect()]
        assert len(got) == len(want) and set(got) == want
    one = spark.createDataFrame([(k, 5, [1, 2]) for k in range(50)] + [(k, k, [9]) for k in range(60, 70)], "node long, root long, bands array<long>")
    assert N.rest(one, 20).collect() == []


def template_rows(seed, pairs):
    """Pairs at a similarity of 0.8 to 0.86; two texts of different pairs have 0.72 to 0.78, and share most of their bands with over 64 others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(220)]
    rows = []
    for k in range(pairs):
        at = rng.randrange(5, 25)
        one = [*base[:at], *(f"u{k}x{j}" for j in range(26)), *base[at + 26 :]]
        two = list(one)
        for j in rng.sample(range(60, 210, 10), 3):
            two[j] = f"v{k}"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    return rows


def test_pairs_that_share_large_bands_only_are_found(spark):
    rows = template_rows(7, 220)
    kept = {r["doc_id"] for r in N.drop_near_copies(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()}
    sets = [grams(t) for _, t in rows]
    like = [k for k in range(0, len(rows), 2) if 9 * len(sets[k] & sets[k + 1]) >= 4 * (len(sets[k]) + len(sets[k + 1]))]
    assert len(like) > 200 and not [k for k in like if {k, k + 1} <= kept]
    assert kept <= set(brute_kept(rows)) and len(kept) > 150  # fingerprints link a few more

"""Near copies by SimHash fingerprints, and by exact similarity of word shingles, whose pairs MinHash bands find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh_name, materialise, slices, utf8
from tidepanel.llm.components import connected_components
from tidepanel.llm.simhash import fingerprint, fingerprint_roots
from tidepanel.llm.spans import keyed_texts, row_key

SEED = 42
WIDTH = 5
#: Words of a shingle of the fingerprints.
PRINT_WIDTH = 3
#: Texts are near copies from a Jaccard similarity of 4 / 5 of their shingle sets on.
SIMILAR = (4, 5)
#: A pair at similarity 0.8 shares none of 16 bands of 4 values once in 4,600 times, one at 0.9 practically never.
BANDS, BAND_VALUES = 16, 4
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 1 << 63, BANDS * BAND_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes that share a band of which all pairs are compared; larger groups are parted by a second band.
CROWD = 64
#: Nodes of a large band that are compared with as many others under one key; each two blocks of a band are a key of their own.
BLOCK = 512
SHIFTS = _random.integers(0, 1 << 63, BANDS * BAND_VALUES, dtype=np.uint64)
#: Shingles that are hashed at once; bounds the memory of long texts.
PART = 1 << 12
#: Bits of a sketch, which tells most pairs of less similar texts apart before their shingles are read.
SKETCH_BITS = 512


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    each = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in each], dtype="<u8"))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of the least values of each band, as signed integers."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), PART):
        np.minimum(least, (hashes[at : at + PART, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_VALUES)
    return [int(np.frombuffer(xxhash.xxh64_digest(r.tobytes(), k), "<i8")[0]) for k, r in enumerate(rows)]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The number of shingles, and for each bit whether an odd number of shingles fall on it, as 64-bit integers.

    Where the bits of two texts differ, a shingle is in one of them only, so texts differ in as many shingles at least.
    """
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.concatenate([[len(hashes)], np.packbits(odd.astype(bool), bitorder="little").view("<i8")])


def with_bands(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, node, fingerprint, bands, sketch)`` of every row; ``node`` is a hash of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, prints, found, sketches = [], [], [], []
            for t in utf8(b.column(2)):
                nodes.append(np.frombuffer(xxhash.xxh64_digest(b" ".join(t.lower().split())), "<i8")[0])
                prints.append(fingerprint(t, PRINT_WIDTH))
                hashes = shingles(t, width)
                found.append(bands(hashes))
                sketches.append(sketch(hashes))
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (found, sketches))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "node", "fingerprint", "bands", "sketch"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "id long, row long, node long, fingerprint long, bands array<long>, sketch array<long>")


def print_links(nodes: DataFrame) -> DataFrame:
    """Links ``(u, v)`` of ``nodes(node, fingerprint)`` whose fingerprints SimHash joins: each to the least node of its component."""
    rooted = nodes.select("node", "fingerprint").join(fingerprint_roots(nodes), "fingerprint")
    least = rooted.groupBy("root").agg(F.min("node").alias("v"))
    return rooted.join(least, "root").filter("node <> v").select(F.col("node").alias("u"), "v")


def with_shingles(rows: DataFrame, width: int) -> DataFrame:
    """``rows(node, text)`` to ``(node, shingles)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([shingles(t, width).view("<i8") for t in utf8(b.column(1))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)`` of ``nodes(node, bands)`` to compare first.

    Of the nodes that share a band, each is paired with the least, the largest and the one before it, however many
    they are. Most classes are whole after these; ``crossing`` and ``rest`` find what is left.
    """
    return beside(nodes.select("node", F.lit(None).cast("long").alias("root"), F.explode("bands").alias("entry")))


def beside(entries: DataFrame) -> DataFrame:
    """Pairs of each of ``entries(node, root, entry)`` with three others of its entry, not those of its own root, nor those that a ``sketch`` tells apart."""
    group = Window.partitionBy("entry").orderBy("root", "node")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = [c for c in ("node", "root", "sketch") if c in entries.columns]
    at = F.struct(*held)
    others = F.array(F.first(at).over(whole), F.last(at).over(whole), F.lag(at).over(group))
    pairs = entries.select(*held, others.alias("others")).select(*held, F.explode("others").alias("other"))
    apart = pairs.filter((F.col("node") != F.col("other.node")) & (F.col("root").isNull() | (F.col("root") != F.col("other.root"))))
    if "sketch" in held:
        apart = apart.filter(may_be_similar("sketch", "other.sketch"))
    return apart.select(F.least("node", "other.node").alias("u"), F.greatest("node", "other.node").alias("v")).distinct()


def may_be_similar(a: str, b: str) -> Column:
    """Whether two sketches leave it open that the texts have the similarity; of texts that have it, always.

    The shingles that only one of them has are as many as the bits that differ, and as the sizes differ by, at least.
    """
    share, whole = SIMILAR
    left, right = F.col(a), F.col(b)
    bits = reduce(add, (F.bit_count(left[k].bitwiseXOR(right[k])) for k in range(1, 1 + SKETCH_BITS // 64)))
    return F.greatest(bits.cast("long"), F.abs(left[0] - right[0])) * (share + whole) <= (left[0] + right[0]) * (whole - share)


def crossing(rooted: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs of ``rooted(node, root, bands)`` that share a band and not a root.

    All of them where at most ``crowd`` nodes share the band. The nodes of larger groups are grouped again by every
    two large bands that they share, each two once; a pair that shares a small band as well is among that band's pairs
    already. Two texts at similarity 0.8 that share one band share no second one once in 2,700 times. All pairs are
    made of at most ``crowd`` nodes there too; of more, which share eight least values, those of ``beside``, which link
    most of them; ``rest`` makes all the pairs that are left between roots. Groups of a single root give nothing. With a column ``sketch``, pairs that it tells apart are left out where they are met.
    """
    entries = rooted.select("node", "root", F.explode("bands").alias("entry"))
    few, many = _by_size(entries, crowd)
    shared = many.groupBy("node", "root").agg(F.array_sort(F.collect_set("entry")).alias("large")).filter(F.size("large") > 1)
    after = lambda b, k: F.transform(F.slice("large", k + 2, F.size("large")), lambda c: F.xxhash64(b, c))
    again = shared.select("node", "root", F.explode(F.flatten(F.transform("large", after))).alias("entry"))
    groups = [few, *_by_size(again, crowd)]
    if "sketch" in rooted.columns:  # only entries that are left need them
        groups = [g.join(rooted.select("node", "sketch"), "node") for g in groups]
    few, few_again, many_again = groups
    return _apart(few).union(_apart(few_again)).union(beside(many_again)).distinct()


def _by_size(entries: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The entries that hold more than one root: those of at most ``crowd`` nodes, and the others."""
    sizes = entries.groupBy("entry").agg(F.count("*").alias("n"), F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last").select("entry", "n")
    sized = materialise(entries.join(sizes, "entry"), "entries")
    return sized.filter(F.col("n") <= crowd).drop("n"), sized.filter(F.col("n") > crowd).drop("n")


def _apart(entries: DataFrame) -> DataFrame:
    names = {"node": "v", "root": "other", "sketch": "other_sketch"}
    a, b = entries, entries.withColumnsRenamed(names)
    pairs = a.join(b, "entry").filter((F.col("node") < F.col("v")) & (F.col("root") != F.col("other")))
    if "sketch" in entries.columns:
        pairs = pairs.filter(may_be_similar("sketch", "other_sketch"))
    return pairs.select(F.col("node").alias("u"), "v")


def rest(rooted: DataFrame, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Distinct pairs of ``rooted(node, root, bands, sketch)`` that share a band of over ``crowd`` nodes and not a root: all of them that the sketches leave.

    What steps before have linked has one root, mostly that of nearly all of a band's nodes (its main root). The others
    are compared with those of the main root and with each other, in blocks of ``block`` nodes, every two of which are
    a key of their own, so a band is dealt over many tasks. Without a column ``sketch`` all pairs are given.
    """
    held = [c for c in ("node", "root", "sketch") if c in rooted.columns]
    entries = rooted.select("node", "root", F.explode("bands").alias("entry"))
    counts = entries.groupBy("entry", "root").agg(F.count("*").alias("n"))
    size = counts.groupBy("entry").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).filter((F.col("n") > crowd) & (F.col("n") > F.col("main.n")))
    blocks = lambda n: F.ceil(n / block).cast("int")
    bands = size.select("entry", F.col("main.root").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("n") - F.col("main.n")).alias("others"))
    dealt = entries.join(bands, "entry")
    if "sketch" in held:
        dealt = dealt.join(rooted.select("node", "sketch"), "node")
    is_main = F.col("root") == F.col("main")
    dealt = materialise(dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")), "blocks")
    # blocks of the main root come first in ``a``, then the others, which ``b`` has too
    a = dealt.select("entry", *held, F.when(is_main, F.col("own")).otherwise(F.col("mains") + F.col("own")).alias("a"), F.explode(F.sequence(F.when(is_main, 0).otherwise(F.col("own")), F.col("others") - 1)).alias("b"))
    other = [F.col(c).alias(f"other_{c}") for c in held]
    b = dealt.filter(~is_main).select("entry", *other, F.explode(F.sequence(F.lit(0), F.col("mains") + F.col("own"))).alias("a"), F.col("own").alias("b"), (F.col("mains") + F.col("own")).alias("same"))
    pairs = a.join(b, ["entry", "a", "b"]).filter((F.col("root") != F.col("other_root")) & ((F.col("a") != F.col("same")) | (F.col("node") < F.col("other_node"))))
    if "sketch" in held:
        pairs = pairs.filter(may_be_similar("sketch", "other_sketch"))
    return pairs.select(F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs ``(u, v)`` whose shingle sets have the similarity; ``texts(row, text)`` holds the texts of ``nodes(node, rank)``."""
    compared = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    owners = nodes.join(compared, "node").select("node", F.col("rank.row").alias("row"))
    held = texts.join(owners, "row").dropDuplicates(["node"])
    sets = materialise(with_shingles(held, width), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    share, whole = SIMILAR
    common, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return both.filter(common * (share + whole) >= total * share).select("u", "v")


def with_roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the least node that links reach as ``root``."""
    roots = connected_components(links)
    joined = nodes.join(roots, nodes["node"] == roots["u"], "left").select(*nodes.columns, F.coalesce("root", "node").alias("root"))
    return materialise(joined, "rooted")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class of near copies; the columns stay.

    Near copies have SimHash fingerprints within two bits of each other (three-word shingles), or a similarity of 0.8
    or more between their sets of ``width``-word shingles, verified for each link; classes are what links of both
    kinds reach. Of texts that share a band, however many do, all pairs not yet in one class are compared. Words are in lower case (ASCII) and parted by white space. Texts of fewer words are one shingle; null
    texts and those without words are copies of each other. The row with the smallest id stays, a null id being the
    largest; rows that share it are told apart by a hash of their text, and of rows with equal id and text any one stays.
    """
    rows = materialise(with_bands(docs, width, id_col, text_col), "bands")
    rank = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("rank")
    nodes = materialise(rows.groupBy("node").agg(rank, F.any_value("fingerprint").alias("fingerprint"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "nodes")
    texts = keyed_texts(docs, id_col, text_col).select("row", "text")
    first = materialise(print_links(nodes).union(verified(materialise(candidates(nodes), "pairs"), nodes, texts, width)), "links")
    roots = with_roots(nodes, first)
    crossed = materialise(crossing(roots.select("node", "root", "bands", "sketch")), "pairs")
    second = materialise(first.union(verified(crossed, nodes, texts, width)), "links")
    roots = with_roots(nodes, second)
    left = materialise(rest(roots.select("node", "root", "bands", "sketch")).join(crossed, ["u", "v"], "left_anti"), "pairs")
    rooted = roots if left.isEmpty() else with_roots(nodes, second.union(verified(left, nodes, texts, width)))
    key, kept = fresh_name(docs, "__row"), fresh_name(docs, "__kept")
    keep = rooted.groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(kept))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    return keyed.join(keep, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key]).select(*docs.columns)

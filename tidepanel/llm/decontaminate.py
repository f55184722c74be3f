"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh_name

#: ``1`` marks a word position that is hashed, ``0`` one that is ignored. Together these find every 13-word
#: window with up to two substituted words (also 8 and 9 words with one, 10 to 12 with two), wherever those stand.
MASKS = ("111011", "11010011", "111001011")
#: Finds 6 and 7 words with one substituted word.
SHORT_MASK = "111"
#: Items of fewer words match as a whole only; of fewer than this many, never.
LONG_WORDS, SHORT_WORDS, LEAST_WORDS = 8, 6, 3
WINDOW_WORDS = 13
SIMILARITY = 0.8
#: Up to so many bytes of benchmark seeds (each with the words around it) go to every executor; beyond, the seeds
#: alone, which tell the documents' seeds that are shuffled; beyond that, all of those are.
MAX_BROADCAST_BYTES = 32 << 20
#: Flags of equal words in one integer.
BITS = 9


def masks_of(n: Column) -> list[tuple[str, Column]]:
    """Every mask with the numbers of item words that it serves."""
    whole = [("1" * k, n == k) for k in range(LEAST_WORDS, SHORT_WORDS)]
    return [*((m, n >= LONG_WORDS) for m in MASKS), (SHORT_MASK, (n >= SHORT_WORDS) & (n < LONG_WORDS)), *whole]


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words: runs of letters, marks and digits in lower case, sharp s as ss. Null is empty."""
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
    words = F.split(lowered, r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: dict[int, tuple[str, Column | None]]) -> DataFrame:
    """The rows, once for every word position and mask that fits there: ``seed`` and ``at`` (position)."""
    # outer, for else Spark adds a filter that computes the words a second time; without words no seed fits
    at = rows.select("*", F.posexplode_outer("words").alias("at", "_word"))

    def seed(number: int, mask: str, served: Column | None) -> Column:
        taken = [F.get("words", F.col("at") + k) for k, bit in enumerate(mask) if bit == "1"]
        fits = F.col("at") + len(mask) <= F.size("words")
        return F.when(fits if served is None else fits & served, F.xxhash64(F.lit(number), *taken))

    each = at.select("*", F.explode(F.array(*[seed(k, m, served) for k, (m, served) in masks.items()])).alias("seed"))
    return each.filter("seed is not null").drop("_word")


def _around(window: int) -> Column:
    """The words that share a window with the one at ``at``, null beyond the text's ends: a row of fixed size, however long the text."""
    return F.array(*[F.get("words", F.col("at") + k) for k in range(1 - window, window)])


def _most_equal(window: int, word: Callable[[int], Column]) -> Column:
    """The most words that a document and ``item`` have in common in a window around a hit; ``word(k)`` is the document's k words on.

    Equal words are bits of integers, ``BITS`` in each; those beyond the ends are never equal. An integer stands in all
    windows' counts, so Spark computes it once and in a method of its own: one for all would be too long to be compiled.
    """
    equal = [F.when(word(k) == F.get("item", F.lit(window - 1 + k)), F.lit(1 << (window - 1 + k) % BITS).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(1 - window, window)]
    parts = [reduce(Column.bitwiseOR, equal[k : k + BITS]) for k in range(0, len(equal), BITS)]

    def equal_from(start: int) -> Column:
        taken = ((1 << window) - 1) << start
        masks = [(taken >> n * BITS) & ((1 << BITS) - 1) for n in range(len(parts))]
        return reduce(add, (F.bit_count(part.bitwiseAND(F.lit(m).cast("long"))) for part, m in zip(parts, masks, strict=True) if m))

    return F.greatest(*map(equal_from, range(window))) if window > 1 else equal_from(0)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, similarity: float = SIMILARITY, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, doc_hash, item_id, matched, window)``: benchmark items that a document holds, aligned word by word.

    A document holds an item if some window of ``window`` item words (all words of a shorter item) meets the
    document's words at one offset with a share of ``similarity`` or more equal; of items of three to five words
    all must be equal. ``matched`` is the most equal words that a window has. Candidates are the offsets at which
    a masked hash of both sides is equal; only masks that some item needs are computed.

    Items of one or two words never match. Null texts are empty. Rows that share id and text
    are one document, whose ``doc_hash`` is a hash of both; a null id is an id like any other. Repeated items
    are read once; items that share an id give a row for each window size. Other columns are not
    read. If either table is empty, so is the result.
    """
    item_rows = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text_col)).alias("words")).distinct()
    masks = masks_of(F.size("words"))
    needed = [F.coalesce(F.bool_or(served), F.lit(False)).alias(f"m{k}") for k, (_, served) in enumerate(masks)]
    # a position of an item gives a seed for each of three masks at most, and each carries the words around it
    seeds = F.sum(F.size("words").cast("long") * len(MASKS))
    about = item_rows.agg(F.coalesce(seeds, F.lit(0)).alias("seeds"), *needed).first()
    used = {k: m for k, m in enumerate(masks) if about[f"m{k}"]} or {0: masks[0]}
    size = F.least(F.lit(window), F.size("words")).alias("window")
    item_seeds = _seeds(item_rows, used).select("seed", "item_id", size, _around(window).alias("item"))
    doc_rows = docs.select(F.col(id_col).alias("doc_id"), doc_hash(id_col, text_col).alias("doc_hash"), word_hashes(F.col(text_col)).alias("words"))
    doc_seeds = _seeds(doc_rows, {k: (m, None) for k, (m, _) in used.items()})
    word = lambda k: F.get("words", F.col("at") + k)
    if about["seeds"] * (16 * window + 80) <= max_broadcast:
        hits = doc_seeds.join(F.broadcast(item_seeds), "seed")
    elif about["seeds"] * 24 <= max_broadcast:  # of the documents' seeds, only those that some item has are shuffled
        met = doc_seeds.join(F.broadcast(item_seeds.select("seed").distinct()), "seed", "left_semi")
        hits = met.select("seed", "doc_id", "doc_hash", _around(window).alias("near")).join(item_seeds, "seed")
        word = lambda k: F.get("near", F.lit(window - 1 + k))
    else:  # the words follow the hits, not every seed
        found = doc_seeds.select("seed", "doc_id", "doc_hash", "at").join(item_seeds, "seed")
        hits = found.join(doc_rows.select("doc_hash", "words").dropDuplicates(["doc_hash"]), "doc_hash")
    # all in generated code up to the aggregation: a row of a hit, with its document's words, is never made
    # filtered after the aggregation: before it, the test would move into the join
    most = hits.select("doc_id", "doc_hash", "item_id", "window", _most_equal(window, word).alias("matched")).groupBy("doc_id", "doc_hash", "item_id", "window").agg(F.max("matched").alias("matched"))
    need = F.when(F.col("window") < SHORT_WORDS, F.col("window")).otherwise(F.lit(similarity) * F.col("window"))
    return most.filter(F.col("matched") >= need).select("doc_id", "doc_hash", "item_id", "matched", "window")


def doc_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; the columns stay. See ``leaks``."""
    key = fresh_name(docs, "__row")
    found = leaks(docs, items, id_col, text_col, item_col, item_text_col).select(F.col("doc_hash").alias(key)).distinct()
    return docs.withColumn(key, doc_hash(id_col, text_col)).join(found, key, "left_anti").select(*docs.columns)

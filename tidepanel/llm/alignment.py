"""Alignment of two tokenizers' tokens by the bytes they cover, and corpus-wide counts of the ids that meet."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import bpe_codec, sentencepiece_codec
from tidepanel.llm.common import materialise, slices, texts

#: An id pair is one integer: the first id times this, plus the second; the first model has under 2^16 ids and the second at most 2^15.
SHIFT = 15
#: Larger groups are counted by distinct ids; each of their pairs is still counted.
GROUP_PAIRS = 1 << 16
#: So many of the commonest id pairs are broadcast with their counts at most; the others are joined by a shuffle.
COMMON_PAIRS = 1 << 19
#: A space that starts a word under both models, whatever is around it: no piece of the second has a space after
#: another character, and the first's splitting rule starts a word at a space before a character that is none.
WORD_START = re.compile(r"(?<=[^ ]) (?=\S)")
#: Texts without this, and without a space before them, are cut at every space.
OTHER_SPACE = re.compile(r" (?:\s|\Z)")
#: Units (from one such space to the next) and their characters that a Python worker remembers.
KNOWN_UNITS, KNOWN_CHARS = 400_000, 8_000_000
#: Characters whose units are listed at once; bounds the memory of long texts.
PART_CHARS = 1 << 20
DOC_SCHEMA = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"


def irregular_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(a, a_end, b, b_end)``: the tokens between two byte offsets at which both have an end, where they are not one of each; all others are, in order.

    At the present shift between both index positions the end arrays are compared in slices of doubling length, then
    of halved length, up to the first difference, so a stretch of one-to-one groups is jumped over. The group
    there is resolved by stepping on whichever side is behind, and the shift follows from where it ends. Both arrays
    must rise to the same last end; a token without bytes belongs to the group that is open where it stands.
    """
    raw_a, raw_b = ends_a.astype("<i4").tobytes(), ends_b.astype("<i4").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(raw_a), len(raw_b)
    out = []
    i = j = 0  # byte positions in the raw arrays
    while True:
        width = 4
        while i + width <= n_a and raw_a[i : i + width] == raw_b[j : j + width]:
            i, j, width = i + width, j + width, 2 * width
        while width > 4:
            width >>= 1
            if i + width <= n_a and raw_a[i : i + width] == raw_b[j : j + width]:
                i, j = i + width, j + width
        if i >= n_a and j >= n_b:
            return out
        a, b = p, q = i >> 2, j >> 2
        end_a, end_b = list_a[p], list_b[q]
        while end_a != end_b:
            if end_a < end_b:
                p += 1
                end_a = list_a[p]
            else:
                q += 1
                end_b = list_b[q]
        out.append((a, p + 1, b, q + 1))
        i, j = (p + 1) << 2, (q + 1) << 2


@dataclass
class Models:
    """What a task needs of both models: the first one's tables, the second one's file and every id's bytes."""

    a: bpe_codec.Vocabulary
    b_model: bytes
    b_surface: list[bytes]


def load(a_path: str = bpe_codec.MODEL_PATH, b_path: str = sentencepiece_codec.MODEL_PATH) -> Models:
    """Read both model files on the driver; tasks get them by broadcast."""
    with open(b_path, "rb") as f:
        model = f.read()
    return Models(bpe_codec.load(a_path), model, sentencepiece_codec.load(b_path).surface)


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def word_parts(text: str) -> Iterator[str]:
    """A text in parts, cut at a space that starts a word and goes; nothing of the empty text."""
    at = 0
    while len(text) - at > PART_CHARS and (m := WORD_START.search(text, at + PART_CHARS)):
        yield text[at : m.start()]
        at = m.end()
    if text:
        yield text[at:]


def units(text: str) -> list[str]:
    """What lies between the spaces that start words; a text is its units with a space between each two."""
    return WORD_START.split(text) if text.startswith(" ") or OTHER_SPACE.search(text) else text.split(" ")


class Lists:
    """Lists of integers, numbered as they are added."""

    def __init__(self):
        self.flat, self.ends, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = int(self.ends[self.n]), self.n + len(sizes)
        if at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.empty(at + len(flat), np.int32)])
        if n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n + 1], np.zeros(n + 1, np.int64)])
        self.flat[at : at + len(flat)] = flat
        self.ends[self.n + 1 : n + 1] = at + np.cumsum(sizes)
        self.n = n

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after the other, and their sizes."""
        begin = self.ends[numbers]
        sizes = self.ends[numbers + 1] - begin
        return self.flat[np.repeat(begin, sizes) + _spread(sizes)], sizes


class Aligner:
    """Encodes texts by both models and aligns them.

    Both models encode what lies between two spaces that start words the same wherever it stands, so such a unit is
    encoded once and remembered by a number, to which its ids under either model belong.
    """

    def __init__(self, models: Models):
        import sentencepiece

        if len(models.a.surface) > 1 << 31 - SHIFT or len(models.b_surface) > 1 << SHIFT:
            raise ValueError("an id pair of these models doesn't fit into 31 bits")
        self.a, self.b = bpe_codec.held(models.a), sentencepiece.SentencePieceProcessor(model_proto=models.b_model)
        self.bytes_a, self.bytes_b = self.a.surface, models.b_surface
        self.forget()
        self.size_a, self.size_b = (np.array([len(s) for s in x], np.int32) for x in (self.bytes_a, self.bytes_b))
        # the number of each id with what follows it: inside a group's first ids, at their end, inside the second, at the group's end
        self.names = [f"{k}{after}" for size, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for k in range(size) for after in ends]

    def forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids_a, self.ids_b, self.chars = Lists(), Lists(), 0

    def _encode(self, words: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a space and each of these lists of units under both models; units not seen before are encoded together."""
        if len(self.numbers) > KNOWN_UNITS or self.chars > KNOWN_CHARS:
            self.forget()
        n, sizes = self.ids_a.n, list(map(len, words))
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        if len(self.numbers) > n:
            new = list(islice(reversed(self.numbers), len(self.numbers) - n))[::-1]
            self.ids_a.add(*bpe_codec.encode_listed(new, self.a))
            lists = self.b.encode(new, num_threads=1)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self.ids_b.add(np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths)
            self.chars += sum(map(len, new))
        last = np.cumsum(sizes)
        cut = []
        for table in (self.ids_a, self.ids_b):
            flat, per = table.of(numbers)
            cut.append(np.split(flat, np.concatenate([[0], np.cumsum(per)])[last[:-1]]))
        return list(zip(*cut, strict=True))

    def encode(self, all_texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a space and each text under both models; none of empty texts."""
        made: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in all_texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for k, part in chain(((k, part) for k, text in enumerate(all_texts) for part in word_parts(text)), [(-1, "")]):
            if waiting and (k < 0 or size + len(part) > PART_CHARS):
                for (at, _), ids in zip(waiting, self._encode([words for _, words in waiting]), strict=True):
                    made[at].append(ids)
                waiting, size = [], 0
            waiting.append((k, units(part)))
            size += len(part)
        none = np.zeros(0, np.int32)
        return [tuple(map(np.concatenate, zip(*ids, strict=True))) if len(ids) > 1 else ids[0] if ids else (none, none) for ids in made]

    def tokens(self, all_texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a space and each text under both models; none if either does not give these bytes back."""
        out = []
        none = np.zeros(0, np.int32)
        for text, (ids_a, ids_b) in zip(all_texts, self.encode(all_texts), strict=True):
            body = (" " + text).encode()
            # byte-level ids are made of the text's own bytes, so their number tells
            same = len(text) > 0 and int(self.size_a[ids_a].sum()) == len(body) and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == body
            out.append((ids_a, ids_b) if same else (none, none))
        return out

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[int, int, str, np.ndarray, np.ndarray]:
        """Number of groups and of links, the groups as text, distinct id pairs and how often each is linked."""
        if not len(ids_a):
            return 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        odd = np.array(irregular_groups(np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])), np.int64).reshape(-1, 4)
        n_a, n_b = odd[:, 1] - odd[:, 0], odd[:, 3] - odd[:, 2]
        at_a, at_b = np.repeat(odd[:, 0], n_a) + _spread(n_a), np.repeat(odd[:, 2], n_b) + _spread(n_b)
        alone_a, alone_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        alone_a[at_a], alone_b[at_b] = False, False
        # the last token of each group, and with it every token's group
        last_a, last_b = alone_a.copy(), alone_b.copy()
        last_a[odd[:, 1] - 1], last_b[odd[:, 3] - 1] = True, True
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        names = np.empty(len(ids_a) + len(ids_b), np.int64)
        names[np.arange(len(ids_a)) + np.concatenate([[0], ends_b])[group_a]] = 2 * ids_a.astype(np.int64) + last_a
        names[np.arange(len(ids_b)) + ends_a[group_b]] = 2 * (len(self.bytes_a) + ids_b.astype(np.int64)) + last_b
        text = "".join(map(self.names.__getitem__, names.tolist()))[:-1]

        wide_a, wide_b = ids_a.astype(np.int64) << SHIFT, ids_b.astype(np.int64)
        small = n_a * n_b <= GROUP_PAIRS
        m_a, m_b = n_a[small], n_b[small]
        per_a = np.repeat(m_b, m_a)  # links of each first token of a small group
        first = np.repeat(np.repeat(odd[small, 0], m_a) + _spread(m_a), per_a)
        second = np.repeat(np.repeat(odd[small, 2], m_a), per_a) + _spread(per_a)
        pairs, times = np.unique(np.concatenate([wide_a[alone_a] | wide_b[alone_b], wide_a[first] | wide_b[second]]), return_counts=True)
        for a, p, b, q in odd[~small].tolist():  # distinct ids of either side, every pair of them
            x, m = np.unique(wide_a[a:p], return_counts=True)
            y, n = np.unique(wide_b[b:q], return_counts=True)
            pairs, times = np.concatenate([pairs, (x[:, None] | y[None, :]).ravel()]), np.concatenate([times, (m[:, None] * n[None, :]).ravel()])
        if not small.all():
            pairs, inverse = np.unique(pairs, return_inverse=True)
            times = np.bincount(inverse, times, len(pairs)).astype(np.int64)
        return len(ends_a), int(times.sum()), text, pairs, times


#: One aligner per two models in each Python worker, so that what is remembered outlives a task.
_HELD: dict[bytes, Aligner] = {}


def held(models: Models) -> Aligner:
    key = models.a.digest + hashlib.sha1(models.b_model).digest()
    if key not in _HELD:
        _HELD[key] = Aligner(models)
    return _HELD[key]


def aligned(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` of every row.

    ``groups`` lists the ids between common ends, ``a1,a2|b1;a3|b2``. ``pairs`` holds each id pair that a group of the
    text links, as one integer, and ``times`` how many links it has.

    Texts that are null or empty, or that one of the models does not give back byte for byte, have no tokens. Null ids
    and repeated rows give a row each; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # the model files' size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = held(shared.value)
        for batch in slices(batches, 64):
            counts, named, pairs, times = [], [], [], []
            for ids_a, ids_b in both.tokens(texts(batch.column(1))):
                n_groups, n_links, text_groups, keys, n = both.align(ids_a, ids_b)
                counts.append((len(ids_a), len(ids_b), n_groups, n_links))
                named.append(text_groups)
                pairs.append(keys)
                times.append(n)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int32))) for x in (pairs, times)]
            longs = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(named, pa.string()), *lists], [f.split()[0] for f in DOC_SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, DOC_SCHEMA)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many rows of ``links(pairs)`` have an id pair, and whether no other pair of its first id has more."""
    n = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", SHIFT)))  # at most as many rows as the second model has ids
    return n.withColumn("best", F.col("n") == most)


def common(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs are counted that often or more."""
    levels = dict(counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("level")).count().collect())  # 63 rows at most
    held, level = 0, max(levels, default=0) + 1
    while level > 0 and held + levels.get(level - 1, 0) <= most:
        level -= 1
        held += levels.get(level, 0)
    return 1 << level


def link_counts(links: DataFrame, counts: DataFrame, most: int = COMMON_PAIRS) -> DataFrame:
    """``(row, n_best, count_sum)`` of ``links(row, pairs, times)``: links that are their first id's commonest, and the sum of all links' counts.

    A pair that very many rows have would gather all of them in one task of a shuffled join. So the commonest pairs,
    ``most`` of them at most, are broadcast, and only the others, each of few rows, are joined by a shuffle. Sums are
    taken by row in the task that has the row before they are shuffled.
    """
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").cast("long").alias("times"))
    least = common(counts, most)
    often = F.broadcast(counts.filter(F.col("n") >= least))
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    parts = each.join(often, "pair").groupBy("row").agg(*sums)
    if least > 1:  # with 1, every pair is among the broadcast ones
        rare = each.join(often.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < least).hint("merge"), "pair")
        parts = parts.unionByName(rare.groupBy("row").agg(*sums))
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def linked(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text", most: int = COMMON_PAIRS) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row, as ``aligned`` and ``link_counts`` say.

    A row counts as a document of its own, with or without an id. Rows without tokens have zeros and no digest. Each
    row's id pairs are written once, and the counts of all pairs once; both are read from there.
    """
    rows = aligned(docs, models, id_col, text_col)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    links = materialise(rows.select("id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times").withColumn("row", F.monotonically_increasing_id()), "links")
    counts = materialise(pair_counts(links), "pair_counts")
    sums = link_counts(links, counts, most)
    out = links.drop("pairs", "times").join(sums, "row", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return out.select("id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

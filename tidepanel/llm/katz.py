"""Katz backoff language model: counts, discounts and backoff weights over a whole corpus, and scores of documents.

The corpus is cut into blocks of tokens. A block counts its own n-grams first, so a shuffled row
is a block's list of distinct n-gram keys for one bucket of the key space, never a token. Buckets are ranges of a
64-bit hash, as many as the corpus needs for each to hold about a million keys, so a frequent word weighs no more
than a rare one. Each bucket sums the counts, keeps them as its part of the model's count table, and answers every
block in the order that it was asked.

From order three on, a block asks only for what the answers of one order less leave open: an n-gram of training text
that holds a shorter one met once is met once itself, and text to be scored needs no n-gram whose parts were never
met. Context sums are made of the n-grams whose context text to be scored has (of all in a full model).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import is_held_out, materialise, slices, utf8

ORDER = 3
FOLDS, HELD_FOLD = 10, 0
#: Counts up to this are discounted by Good and Turing.
CUTOFF = 5
#: What a larger count gives up, so that every context leaves some mass to words it was not seen with.
FLOOR = 0.01
#: The additive constant of the base score.
BASE_ADD = 0.1
BLOCK_TOKENS = 1 << 21
BUCKET_KEYS = 1 << 20
#: The block number of rows of the count table, and the bucket of what blocks know without asking.
TABLE, KNOWN = -1, -1

BLOCKS = "block long, row array<long>, id array<long>, held array<boolean>, size array<int>, lead array<int>, hashes array<long>, tokens array<int>"
ASKED = "bucket int, block long, order int, keys binary, counts binary"
ANSWERS = "block long, order int, bucket int, counts binary, histogram array<long>, keys binary"
PARTS = "kind int, row long, id long, held boolean, order int, key long, n long, known long, x double, y double"
DOCUMENT, CONTEXT, UNSEEN = 0, 1, 2


def _mix(a: np.ndarray | np.uint64, b: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of two 64-bit values, in that order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xA24BAED4963EE407)
    return x ^ x >> np.uint64(32)


START, END = (np.uint64(xxhash.xxh64_intdigest(b"", seed)) for seed in (1, 2))
_START_KEY = _mix(np.uint64(1), START)


def _start_keys(order: int) -> list[np.uint64]:
    """Keys of the n-grams of start marks alone, from one mark up; they are contexts but no n-grams of the model."""
    out = [_START_KEY]
    while len(out) < order:
        out.append(_mix(out[-1], _START_KEY))
    return out


def token_blocks(docs: DataFrame, order: int, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Blocks of documents as word numbers into the block's own hash list; long texts go on in the next block."""
    part_rows = 1 << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen, numbers, pieces, filled, rows, blocks = {}, [], [], 0, 0, 0
        marks = 2

        def flush() -> pa.RecordBatch:
            nonlocal seen, numbers, pieces, filled, blocks
            hashes = np.array([int(START), int(END), *(xxhash.xxh64_intdigest(w) for w in seen)], np.uint64).view(np.int64)
            cols = [[p[k] for p in pieces] for k in range(5)]
            one = [
                pa.array([part * part_rows + blocks], pa.int64()),
                *(pa.array([c], pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()), strict=True)),
                pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes)),
                pa.ListArray.from_arrays(pa.array([0, filled], pa.int32()), pa.array(np.concatenate(numbers))),
            ]
            seen, numbers, pieces, filled, blocks = {}, [], [], 0, blocks + 1
            return pa.RecordBatch.from_arrays(one, ["block", "row", "id", "held", "size", "lead", "hashes", "tokens"])

        for b in slices(batches):
            for doc, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                words = text.lower().split()
                for at in range(0, len(words) + 1, BLOCK_TOKENS):
                    here = words[at : at + BLOCK_TOKENS]
                    before = words[max(0, at - order + 1) : at]
                    ids = [0] * (order - 1 - len(before)) + [seen.setdefault(w, len(seen) + marks) for w in before + here]
                    if at + BLOCK_TOKENS > len(words):
                        ids.append(1)
                    numbers.append(np.array(ids, np.int32))
                    pieces.append((part * part_rows + rows, doc, out, len(ids), order - 1))
                    filled += len(ids)
                    if filled >= BLOCK_TOKENS:
                        yield flush()
                rows += 1
        if pieces:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


@dataclass
class Grams:
    """The n-grams of one order in a block: their positions, distinct keys in order, and each position's place among them."""

    at: np.ndarray
    keys: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    wanted: np.ndarray


class Block:
    """A block's arrays: words by position, and what document each belongs to."""

    def __init__(self, row: dict, order: int) -> None:
        self.order = order
        hashes = row["hashes"].values.to_numpy().view(np.uint64)
        self.tokens = row["tokens"].values.to_numpy()
        size, self.lead = (row[k].values.to_numpy() for k in ("size", "lead"))
        self.held = row["held"].values.to_numpy(zero_copy_only=False)
        self.of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.offset = np.arange(len(self.tokens)) - np.repeat(np.cumsum(size) - size, size)
        self.scored = self.offset >= self.lead[self.of]
        self.train = ~self.held[self.of]
        self.word_keys = _mix(np.uint64(1), hashes)
        # the last position before a piece is a context only; of a document's first piece it is a start mark, met once
        self.context = self.offset == self.lead[self.of] - 1
        self.met = self.train & (self.scored | self.context & (self.tokens == 0))

    def keys(self) -> Iterator[np.ndarray]:
        """The key that ends at each position, order by order; a key's context is the key of one order less at the position before."""
        now = first = self.word_keys[self.tokens]
        for _ in range(self.order):
            yield now
            before = np.empty_like(now)
            before[0], before[1:] = 0, now[:-1]
            now = _mix(before, first)

    def grams(self, order: int, keys: np.ndarray, at: np.ndarray) -> Grams:
        distinct, place = grouped(keys[at])
        counts = np.bincount(place, self.met[at], len(distinct)).astype(np.int64)
        return Grams(at, distinct, place, counts, np.bincount(place, self.held[self.of[at]], len(distinct)) > 0)

    def places(self, order: int) -> np.ndarray:
        """Positions whose n-gram of that order is a token's, a context's, or a part of a context."""
        return np.flatnonzero(self.offset >= self.lead[self.of] - (self.order - order))


@dataclass
class Met:
    """By position: how often training text has the n-gram that ends there, and whether text to be scored has it."""

    counts: np.ndarray
    wanted: np.ndarray

    def open(self, b: Block, at: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of positions, those whose n-gram of one order more must be asked for, and those that training text is sure to have once."""
        context, rest = self.counts[at - 1], self.counts[at]
        train = b.train[at]
        needed = np.where(b.held[b.of[at]], (context > 0) & (rest > 0), (context > 1) & (rest > 1) | self.wanted[at - 1])
        if full:
            needed[:] = True
        return at[needed], at[~needed & train]


def _block_of(batch: pa.RecordBatch | pa.Table, k: int, order: int) -> Block:
    return Block({name: batch.column(name)[k] for name in ("held", "size", "lead", "hashes", "tokens")}, order)


def _ask_rows(block: int, order: int, g: Grams, bits: int, full: bool) -> Iterator[pa.RecordBatch]:
    """A row per bucket: the distinct keys in order, and twice their counts in training text, plus one if text to be scored has them."""
    bounds = np.searchsorted(g.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    told = 2 * g.counts + (g.wanted | full)
    for bucket, (s, e) in enumerate(zip(bounds, [*bounds[1:], len(g.keys)], strict=True)):
        if e > s:
            yield _ask(bucket, block, order, _packed_keys(g.keys[s:e]), told[s:e])


def _ask(bucket: int, block: int, order: int, keys: bytes, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([order], pa.int32()), pa.array([keys], pa.binary()), pa.array([_packed(counts)], pa.binary())], ["bucket", "block", "order", "keys", "counts"])


def _asked(blocks: DataFrame, order: int, bits: int, full: bool) -> DataFrame:
    """What blocks ask for of words and pairs: all that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = _block_of(batch, k, order)
                for n, keys in zip((1, 2), b.keys(), strict=False):
                    yield from _ask_rows(batch.column("block")[k].as_py(), n, b.grams(n, keys, b.places(n)), bits, full)

    return blocks.mapInArrow(run, ASKED)


def _asked_more(n: int, order: int, bits: int, full: bool):
    """What a block asks for of order ``n``, given the answers of lower orders; n-grams that it knows to be met once go as a number."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        b = _block_of(blocks, 0, order)
        known = None
        for k, keys, at, sure, _, met in _resolved(b, answers, n - 1, full):
            known = met
        keys = next(keys for k, keys in enumerate(b.keys(), 1) if k == n)
        at, sure = known.open(b, b.places(n), full)
        block = blocks.column("block")[0].as_py()
        return pa.Table.from_batches([*_ask_rows(block, n, b.grams(n, keys, at), bits, full), _ask(KNOWN, block, n, b"", np.array([b.scored[sure].sum()]))])

    return run


def _resolved(b: Block, answers: pa.Table, last: int, full: bool) -> Iterator[tuple]:
    """Order by order: number, keys, positions asked for, positions sure to be met once, (grams, replies), and counts by position."""
    answers = answers.combine_chunks().sort_by([("order", "ascending"), ("bucket", "ascending")])
    orders = answers.column("order").to_numpy()
    met = None
    for n, keys in enumerate(b.keys(), 1):
        if n > last:
            return
        at, sure = (b.places(n), np.zeros(0, np.int64)) if n < 3 else met.open(b, b.places(n), full)
        g = b.grams(n, keys, at)
        got = np.concatenate([np.zeros(0, np.int64), *(_unpacked(answers.column("counts")[int(k)].as_py()) for k in np.flatnonzero(orders == n))])
        met = Met(np.zeros(len(b.tokens), np.int64), np.zeros(len(b.tokens), bool))
        met.counts[sure] = 1
        met.counts[at] = (np.abs(got) >> 1)[g.place]
        met.wanted[at] = (np.abs(got) & 1)[g.place] > 0
        yield n, keys, at, sure, (g, got), met


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers at the least width that holds them, which goes first."""
    most = int(np.abs(numbers).max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order: the first one, and the steps from each to the next in as many bytes as the largest step takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return keys[:1].tobytes() + bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8)
    steps[1:, : raw[8]] = np.frombuffer(raw, np.uint8, offset=9).reshape(n - 1, raw[8])
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them; as ``np.unique`` gives them, but by one sort of values.

    The place of a key is kept in the low bits of what is sorted. Keys that differ only in the bits it takes are put in order after.
    """
    n = len(keys)
    if n < 2:
        return keys.copy(), np.zeros(n, np.int64)
    least = keys.min()
    bits, spare = np.uint64(n.bit_length()), np.uint64(64 - int(keys.max() - least).bit_length())
    head = (keys - least) << spare >> bits
    order = (np.sort(head << bits | np.arange(n, dtype=np.uint64)) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    inner = keys[order]
    for k in np.flatnonzero(inner[1:] < inner[:-1]):
        a, b = int(k), int(k) + 2
        while a > 0 and head[order[a - 1]] == head[order[k]]:
            a -= 1
        while b < n and head[order[b]] == head[order[k]]:
            b += 1
        order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
        inner[a:b] = keys[order[a:b]]
    new = np.append(True, inner[1:] != inner[:-1])
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    return inner[new], place


def _answer(order_max: int, full: bool):
    """Per bucket: total counts (twice, plus one for what text to be scored has) for each block that asked, negative for the first block that has the n-gram in training text; and the bucket's part of the count table.

    Rows of a stored count table are asked beside those of blocks, and count as training text that no block has.
    """
    starts = _start_keys(order_max)

    def run(asked: pa.Table) -> pa.Table:
        asked = asked.combine_chunks().sort_by([("order", "ascending"), ("block", "ascending")])
        orders, blocks = asked.column("order").to_numpy(), asked.column("block").to_numpy()
        bucket = asked.column("bucket")[0].as_py()
        out: dict[str, list] = {k: [] for k in ("block", "order", "bucket", "counts", "histogram", "keys")}

        def emit(block: int, order: int, counts: bytes | None, histogram: list[int] | None, keys: bytes | None) -> None:
            for name, x in zip(out, (block, order, bucket, counts, histogram, keys), strict=True):
                out[name].append(x)

        for order in np.unique(orders).tolist():
            rows = np.flatnonzero(orders == order)
            # a stored table has plain counts, and nothing to be scored
            each = [_unpacked(asked.column("counts")[int(k)].as_py()) * (2 if blocks[k] == TABLE else 1) for k in rows]
            told, sizes = np.concatenate(each), [len(x) for x in each]
            if bucket == KNOWN:
                n = int(told.sum())
                emit(TABLE, order, None, [n, *[0] * (CUTOFF + 1), n], None)
                continue
            keys = [_unpacked_keys(asked.column("keys")[int(k)].as_py(), n) for k, n in zip(rows, sizes, strict=True)]
            ends = np.cumsum([len(k) for k in keys])
            distinct, place = grouped(np.concatenate(keys))
            counts = told >> 1
            total = np.bincount(place, counts, len(distinct)).astype(np.int64)
            wanted = np.bincount(place, told & 1, len(distinct)) > 0
            reply = (2 * total + wanted)[place]
            held = np.flatnonzero((counts > 0) & (np.repeat(blocks[rows], [len(k) for k in keys]) != TABLE))
            first = np.full(len(distinct), -1)
            first[place[held][::-1]] = held[::-1]
            reply[first[first >= 0]] *= -1
            real = total[(total > 0) & (distinct != starts[order - 1])]
            histogram = [*(int((real == r).sum()) for r in range(1, CUTOFF + 2)), int((real > CUTOFF + 1).sum()), int(real.sum())]
            for j, k in enumerate(rows):
                if blocks[k] != TABLE:
                    emit(int(blocks[k]), order, _packed(reply[ends[j] - len(keys[j]) : ends[j]]), None, None)
            stored = (total > 0) & (wanted | full)
            emit(TABLE, order, _packed(total[stored]), histogram, _packed_keys(distinct[stored]))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array(out[k], t) for k, t in zip(out, types, strict=True)], list(out))

    return run


@dataclass(frozen=True)
class Discounts:
    """Of one order: what a count keeps (by count up to the cutoff), the sum of all counts, of what they give up, and the number of types."""

    keeps: np.ndarray
    total: int
    lost: float
    types: int

    def kept(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= CUTOFF, self.keeps[np.minimum(counts, CUTOFF)], counts - FLOOR)


def discounts(histogram: list[int]) -> Discounts:
    """Katz's form of the Good-Turing discounts from the number of types seen once, twice and so on.

    The cutoff is lowered until all discounts lie between 0 and 1; where none does (small or odd corpora), each
    count gives up half an occurrence, as in absolute discounting.
    """
    n = np.array(histogram[: CUTOFF + 1], float)
    r = np.arange(1, CUTOFF + 1)
    keeps = r - 0.5
    for k in range(CUTOFF, 0, -1):
        if n[0] > 0 and (n[: k + 1] > 0).all():
            tail = (k + 1) * n[k] / n[0]
            ratio = ((r[:k] + 1) * n[1 : k + 1] / n[:k] / r[:k] - tail) / (1 - tail) if tail != 1 else np.zeros(k)
            if ((ratio > 0) & (ratio < 1)).all():
                keeps = np.where(r <= k, r * np.append(ratio, np.zeros(CUTOFF - k)), r - FLOOR)
                break
    larger = histogram[CUTOFF] + histogram[CUTOFF + 1]
    return Discounts(np.append(0.0, keeps), histogram[-1], float((n[:CUTOFF] * (r - keeps)).sum() + FLOOR * larger), int(sum(histogram[:-1])))


def _score(order_max: int, by_order: dict[int, Discounts], full: bool):
    """Per block: what each document's score has so far, the parts of context sums, and the backoffs still to be added."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        b = _block_of(blocks, 0, order_max)
        n_docs = len(b.lead)
        rows, ids = (blocks.column(c)[0].values for c in ("row", "id"))
        out: list[pa.Table] = []

        def emit(kind: int, order: int, **cols) -> None:
            n = len(next(iter(cols.values())))
            types = {"row": pa.int64(), "id": pa.int64(), "held": pa.bool_(), "order": pa.int32(), "key": pa.int64(), "n": pa.int64(), "known": pa.int64(), "x": pa.float64(), "y": pa.float64()}
            cols["order"] = np.full(n, order, np.int32)
            arrays = [pa.nulls(n, t) if c not in cols else cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], t) for c, t in types.items()]
            out.append(pa.table([pa.array(np.full(n, kind, np.int32)), *arrays], ["kind", *types]))

        total, scored = by_order[1].total, np.flatnonzero(b.scored)
        log_p, p_here = np.zeros(len(b.tokens)), np.zeros(len(b.tokens))
        before_keys = before = known = bases = None
        for order, keys, _, _, (g, got), met in _resolved(b, answers, order_max, full):
            d, count = by_order[order], np.abs(got) >> 1
            c = met.counts[scored]
            if order == 1:
                p = np.where(c > 0, d.kept(c), d.lost) / total if total else np.ones(len(c))
                p_here[scored], log_p[scored] = p, np.log10(p)
                known = np.bincount(b.of[scored], c > 0, n_docs).astype(np.int64)
                bases = np.bincount(b.of[scored], np.log10((c + BASE_ADD) / (total + BASE_ADD * (d.types + 1))), n_docs)
            else:
                context = before.counts[scored - 1]
                # the first block with an n-gram adds it to its context's sums, with its probability one order lower
                inside = b.scored[g.at] & (before.wanted[g.at - 1] | full)
                where = np.full(len(got), -1)
                where[g.place[inside][::-1]] = g.at[inside][::-1]
                owner = np.flatnonzero((got < 0) & (where >= 0))
                ctx, at = grouped(before_keys[where[owner] - 1])
                first = np.zeros(len(ctx), np.int64)
                first[at] = np.arange(len(at))
                lost = np.bincount(at, count[owner] - d.kept(count[owner]), len(ctx))
                emit(CONTEXT, order, key=ctx.view(np.int64), n=before.counts[where[owner[first]] - 1], x=lost, y=np.bincount(at, p_here[where[owner]], len(ctx)))
                seen = c > 0
                p_here = np.zeros(len(b.tokens))
                p_here[scored[seen]] = d.kept(c[seen]) / context[seen]
                log_p[scored[seen]] = np.log10(p_here[scored[seen]])
                # an n-gram that was not seen, in a context that was, needs that context's backoff weight
                at = scored[~seen & (context > 0)]
                at = at[np.lexsort((before_keys[at - 1], b.of[at]))]
                doc, key = b.of[at], before_keys[at - 1]
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))[: len(at)])
                emit(UNSEEN, order, row=rows.take(pa.array(doc[first])), key=key[first].view(np.int64), n=np.diff(np.append(first, len(at))))
            before_keys, before = keys, met
        sums = np.bincount(b.of, np.where(b.scored, log_p, 0), n_docs)
        tokens = np.bincount(b.of, b.scored, n_docs).astype(np.int64)
        emit(DOCUMENT, 0, row=rows, id=ids, held=b.held, n=tokens, known=known, x=bases, y=sums)
        return pa.concat_tables(out)

    return run


@dataclass(frozen=True)
class Model:
    """A stored model: the count table by order and bucket, the weight table by order and context, and each order's discounts.

    ``counts`` is ``(bucket, order, keys, counts)`` with a bucket's n-gram keys in order, ``weights`` is
    ``(order, key, weight)`` with the log10 of the backoff weight of a context of n-grams of that order.
    """

    order: int
    bits: int
    by_order: dict[int, Discounts]
    counts: DataFrame
    weights: DataFrame


def _run(docs: DataFrame, order: int, id_col: str, text_col: str, held: Column, full: bool, model: Model | None = None) -> tuple[Model, DataFrame]:
    """The model of the documents outside ``held`` (or the one given, with all documents held), and the scores of all documents."""
    spark = docs.sparkSession
    parts_n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"katz_blocks_{uuid.uuid4().hex}"
    # bucketed, so that the answers come to the blocks and the blocks are not shuffled
    token_blocks(docs, order, id_col, text_col, held).write.bucketBy(parts_n, "block").option("compression", "zstd").format("parquet").saveAsTable(table)
    blocks = spark.table(table)
    if model is None:
        tokens = blocks.agg(F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("n")).first()["n"]
        bits = max(3, int(np.ceil(np.log2(max(1, tokens * 2 / BUCKET_KEYS)))))
    else:
        bits = model.bits
    answers = None
    for n in range(2, order + 1):  # words and pairs first, then each order by what the ones below left open
        asked = _asked(blocks, order, bits, full) if n == 2 else blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_asked_more(n, order, bits, full), ASKED)
        if model is not None:
            asked = asked.union(model.counts.filter(F.col("order") == n if n > 2 else F.col("order") <= 2).filter("length(keys) > 0").select("bucket", F.lit(TABLE).cast("long").alias("block"), "order", "keys", "counts"))
        found = materialise(asked.groupBy("bucket").applyInArrow(_answer(order, full), ANSWERS), f"ngram-counts-{n}")
        stored = found.filter(F.col("block") == TABLE)
        told = found.filter(F.col("block") != TABLE).select("block", "order", "bucket", "counts")
        answers, tables = (told, stored) if answers is None else (answers.union(told), tables.union(stored))
    if model is None:
        counted = tables.select("order", F.posexplode("histogram")).groupBy("order", "pos").agg(F.sum("col").alias("n")).collect()
        sums = {(r["order"], r["pos"]): r["n"] for r in counted}
        by_order = {k: discounts([sums.get((k, p), 0) for p in range(CUTOFF + 3)]) for k in range(1, order + 1)}
    else:
        by_order = model.by_order
    parts = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, by_order, full), PARTS)
    parts = materialise(parts, "katz-parts")
    if model is None:
        contexts = parts.filter(F.col("kind") == CONTEXT).groupBy("order", "key").agg(F.sum("x").alias("lost"), F.sum("y").alias("mass"), F.max("n").alias("count"))
        weights = materialise(contexts.select("order", "key", F.log10(F.col("lost") / F.col("count") / (1 - F.col("mass"))).alias("weight")), "katz-weights")
        stored = tables.filter("bucket <> -1").select("bucket", "order", "keys", "counts")
        model = Model(order, bits, by_order, stored, weights)
    backoffs = parts.filter(F.col("kind") == UNSEEN).select("row", "order", "key", "n").join(model.weights, ["order", "key"])
    added = backoffs.groupBy("row").agg(F.sum(F.col("n") * F.col("weight")).alias("added"))
    documents = parts.filter(F.col("kind") == DOCUMENT).groupBy("row").agg(
        F.max("id").alias("id"), F.max("held").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("x").alias("base_score"), F.sum("y").alias("part")
    )
    spark.sql(f"DROP TABLE {table}")  # its files go with it; what follows reads the parts only
    both = documents.join(added, "row", "left")
    scores = both.select("id", "held_out", "n_tokens", "n_known", F.lit(by_order[1].total).cast("long").alias("train_tokens"), "base_score", (F.col("part") + F.coalesce("added", F.lit(0.0))).alias("score"))
    return model, scores


def fit(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The full model of all documents, as tables in the shared folder, for texts that are not known yet; see ``score``."""
    return _run(docs, order, id_col, text_col, F.lit(False), True)[0]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``katz_scores`` of other documents from a stored model; ``held_out`` is true."""
    return _run(docs, model.order, id_col, text_col, F.lit(True), False, model)[1]


def katz_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_FOLD) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the documents outside the held-out fold and scores all. A word is a run of characters
    other than ASCII white space, A-Z in lower case, and each text ends with an end mark, which counts as a
    token. ``score`` is the log10 probability of the text under the Katz model: an n-gram that was seen has its
    discounted share of its context, any other the context's backoff weight times its probability one order
    lower, down to single words, of which one stands for all unknown. The weights make each context's
    probabilities, over the known words and that one, sum to one exactly.

    Null texts are empty and still have their end mark. A null id counts as the empty text for the fold.
    Repeated rows are learnt from and scored each. Other columns are not read. Without training documents all
    probabilities are one. An empty table gives an empty result.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    return _run(docs, order, id_col, text_col, is_held_out(id_col, folds, fold), False)[1]

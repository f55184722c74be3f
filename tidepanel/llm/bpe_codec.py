"""Byte-level BPE: content-defined chunks that documents share are encoded once, and the joins between chunks are repaired."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain
from re import Pattern

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, texts

MODEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: A chunk has at least and at most so many bytes (its end moves on to the next character); one place in ``DIVISOR`` ends it.
MIN_BYTES, MAX_BYTES, DIVISOR = 64, 4096, 192
#: A number for each byte, from which the rolling hash is made.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([k])) for k in range(256)], np.uint32)
#: Characters of chunks, and words, whose ids a Python worker remembers, twice.
KNOWN_CHARS, KNOWN_WORDS = 8_000_000, 250_000
#: Longer words are not remembered.
WORD_CHARS = 48
#: The end of a word is sure if so many characters follow it: the splitting rule looks no further ahead.
AHEAD = 3
#: Words up to so many bytes are merged side by side, longer ones alone.
SHORT_BYTES = 48
#: Words of new chunks that are held before they are encoded.
WORDS_AT_ONCE = 200_000
#: The words of byte-level models: contractions, letters, numbers, other characters, each with a space before, and white space. Fixed, as the model's ids follow from it.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
ASCII_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters of a text that are cut into chunks at once; bounds the memory of long texts.
PART_CHARS = 1 << 20


@dataclass
class Vocabulary:
    """A byte-level BPE model: ids of single bytes, merges (the rank of a pair of ids, and each rank's new id), special tokens, every id's bytes, the splitting rule and the characters that only it knows."""

    byte_ids: list[int]
    merges: dict[int, int]
    made: list[int]
    special: dict[str, int]
    surface: list[bytes]
    rule: str
    later: str
    digest: bytes
    chunks: dict[str, tuple[int, bytes]] = field(default_factory=dict)
    older_chunks: dict[str, tuple[int, bytes]] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)
    older_words: dict[str, bytes] = field(default_factory=dict)
    held: int = 0
    encoded: int = 0
    words_of: Callable[[str], Pattern] | None = None
    stop: regex.Pattern | None = None
    arrays: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"chunks": {}, "older_chunks": {}, "words": {}, "older_words": {}, "held": 0, "encoded": 0, "words_of": None, "stop": None, "arrays": None}

    def ready(self) -> Vocabulary:
        if self.words_of is None:
            plain, usual, full = re.compile(ASCII_RULE), regex.compile(RULE.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")), regex.compile(self.rule, regex.V1)
            least = min(map(ord, self.later)) if self.later else 0x110000  # below it, both Unicode versions agree
            newer = {chr(c) for a, b in zip(self.later[::3], self.later[2::3], strict=True) for c in range(ord(a), ord(b) + 1)}

            def words_of(text: str) -> Pattern:
                if text.isascii():
                    return plain
                return full if ord(max(has := set(text))) >= least and not newer.isdisjoint(has) else usual

            self.words_of = words_of
            pairs = np.fromiter(self.merges, np.int64, len(self.merges))
            order = np.argsort(pairs)
            self.arrays = pairs[order], np.fromiter(self.merges.values(), np.int64, len(self.merges))[order], np.array(self.made, np.int64), np.array(self.byte_ids, np.int64), len(self.made)
            self.stop = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        return self


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a model file: itself if it is printable, else the next free code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def splitting_rule() -> tuple[str, str]:
    """The rule with the letters and numbers of the tokenizers library's Unicode version, and as ranges the characters that are neither there, but are here."""
    from tokenizers import Regex, normalizers

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    classes, ranges = [], []
    for p in (r"\p{L}", r"\p{N}"):
        mine = "".join(regex.findall(p, every))
        runs: list[list[int]] = []
        for c in sorted(map(ord, normalizers.Replace(Regex(p), "").normalize_str(mine))):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        ranges.append("".join(f"{chr(a)}-{chr(b)}" for a, b in runs))
        classes.append(f"[{p}--[{ranges[-1]}]]" if runs else p)
    letter, number = classes
    return RULE.format(letter=letter, number=number, other=rf"(?:(?!{letter}|{number})\S)"), "".join(ranges)


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file on the driver; tasks get its tables, whose size the model fixes."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    model = json.loads(raw)
    letters, ids = byte_letters(), model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    surface = [b""] * (max(chain(ids.values(), special.values())) + 1)
    for piece, k in ids.items():
        surface[k] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
    for piece, k in special.items():
        surface[k] = piece.encode()
    merges, made = {}, []
    for rank, pair in enumerate(model["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[a] << 32 | ids[b]] = rank
        made.append(ids[a + b])
    byte_ids = [0] * 256
    for c, b in letters.items():
        byte_ids[b] = ids[c]
    return Vocabulary(byte_ids, merges, made, special, surface, *splitting_rule(), hashlib.sha1(raw.encode()).digest())


def merged(words: list[str], v: Vocabulary) -> list[bytes]:
    """Ids (32-bit integers) of words: in each, the pair of the lowest rank is joined first, the leftmost of equals, until none is left.

    All words take one step at a time together; those without a pair to join leave.
    """
    bodies = [w.encode() for w in words]
    out: list[bytes] = [b""] * len(words)
    short = [k for k, b in enumerate(bodies) if len(b) <= SHORT_BYTES]
    for k, b in enumerate(bodies):
        if len(b) > SHORT_BYTES:
            out[k] = _merged_alone(words[k], v)
    if not short:
        return out
    keys, ranks_of, made, single, none = v.arrays
    ids = single[np.frombuffer(b"".join([bodies[k] for k in short]), np.uint8)]
    word = np.repeat(np.array(short), [len(bodies[k]) for k in short])

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, ranks_of[at], none)

    ranks = np.full(len(ids), none)
    same = np.flatnonzero(word[:-1] == word[1:])
    ranks[same] = rank(ids[same], ids[same + 1])
    done_ids, done_word = [], []
    while len(ids):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        sizes = np.diff(starts, append=len(ids))
        least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        done = least == none
        if done.any():
            done_ids.append(ids[done])
            done_word.append(word[done])
            ids, word, ranks, least = ids[~done], word[~done], ranks[~done], least[~done]
            if not len(ids):
                break
        hits = np.flatnonzero(ranks == least)
        hits = hits[np.diff(word[hits], prepend=-1) != 0]  # the leftmost of each word; every word has one
        ids[hits] = made[ranks[hits]]
        keep = np.ones(len(ids), bool)
        keep[hits + 1] = False
        ranks[hits] = none
        hits = hits - np.arange(len(hits))  # places after the right halves have gone
        ids, word, ranks = ids[keep], word[keep], ranks[keep]
        after = hits[(hits + 1 < len(ids))]
        after = after[word[after] == word[after + 1]]
        ranks[after] = rank(ids[after], ids[after + 1])
        before = hits[hits > 0] - 1
        before = before[word[before] == word[before + 1]]
        ranks[before] = rank(ids[before], ids[before + 1])
    if done_ids:
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids, word = ids[order].astype(np.int32), word[order]
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        flat, ends = ids.tobytes(), np.append(starts[1:], len(ids))
        for k, a, b in zip(word[starts].tolist(), (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            out[k] = flat[a:b]
    return out


def _merged_alone(word: str, v: Vocabulary) -> bytes:
    """The same for one word, in time that grows little faster than it: pairs wait in a heap, those that have changed since are skipped."""
    parts = list(map(v.byte_ids.__getitem__, word.encode()))
    n, rank, made = len(parts), v.merges.get, v.made
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(a << 32 | b)) is not None]
    heapify(heap)
    while heap:
        least, k = heappop(heap)
        right = after[k]
        if right >= n or parts[k] < 0 or rank(parts[k] << 32 | parts[right]) != least:
            continue
        new = parts[k] = made[least]
        parts[right] = -1
        after[k] = right = after[right]
        if right < n:
            before[right] = k
            if (r := rank(new << 32 | parts[right])) is not None:
                heappush(heap, (r, k))
        left = before[k]
        if left >= 0 and (r := rank(parts[left] << 32 | new)) is not None:
            heappush(heap, (r, left))
    return array("i", [k for k in parts if k >= 0]).tobytes()


def _word(word: str, v: Vocabulary) -> bytes:
    ids = v.words.get(word)
    if ids is None:
        ids = v.older_words.get(word)
        if ids is None:
            ids = _merged_alone(word, v)
        if len(word) <= WORD_CHARS:
            if len(v.words) >= KNOWN_WORDS:  # what was used since the last change stays
                v.older_words, v.words = v.words, {}
            v.words[word] = ids
    return ids


def _word_ids(words: set[str], v: Vocabulary) -> dict[str, bytes]:
    """The ids of each of these words; those not seen before are merged side by side."""
    known = v.words
    ids = {w: known.get(w) for w in words}
    again = {w: v.older_words.get(w) for w, i in ids.items() if i is None}
    need = [w for w, i in again.items() if i is None]
    again.update(zip(need, merged(need, v), strict=True))
    ids.update(again)
    for w, i in again.items():
        if len(w) <= WORD_CHARS:
            if len(v.words) >= KNOWN_WORDS:  # what was used since the last change stays
                v.older_words, v.words = v.words, {}
            v.words[w] = i
    return ids


def encode_listed(units: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a space and each unit, one after the other, and how many each has; special tokens are plain text.

    A unit without a space that starts with a character which is no white space has its words for itself wherever a
    space is before it, so all such units are split as one text; a word with a space before it starts the next unit.
    """
    joint: tuple[list[int], list[int]] = [], []  # ASCII, others
    words: list[list[str]] = [[] for _ in units]
    for k, unit in enumerate(units):
        if not unit or " " in unit or unit[0].isspace():
            words[k] = v.words_of(" " + unit).findall(" " + unit)
        else:
            joint[not unit.isascii()].append(k)
    for group in filter(None, joint):
        text = "".join([" " + units[k] for k in group])
        found = v.words_of(text).findall(text)
        starts = [k for k, w in enumerate(found) if w[0] == " "]
        for k, at, end in zip(group, starts, [*starts[1:], len(found)], strict=True):
            words[k] = found[at:end]
    ids = _word_ids(set(chain.from_iterable(words)), v)
    flat = [b"".join(map(ids.__getitem__, x)) for x in words]
    return np.frombuffer(b"".join(flat), np.int32), np.array([len(x) // 4 for x in flat], np.int64)


def bounds(text: str) -> list[int]:
    """Where the chunks of a text end, in characters; none for the empty text.

    A bound is where the hash of the last 32 bytes says so, at the next character, so equal passages have equal bounds
    from their first one on, whatever stands around them. Least and largest size go before.
    """
    b = np.frombuffer(text.encode(), np.uint8)
    rolled, width = GEAR[b], 1
    while width < 32:  # the hash of 2k bytes from two of k bytes; each byte back shifts by one bit more
        wider = rolled.copy()
        wider[width:] += rolled[:-width] << np.uint32(width)
        rolled, width = wider, 2 * width
    begin, ends = 0, []
    for m in chain((np.flatnonzero(rolled < (1 << 32) // DIVISOR) + 1).tolist(), (len(b),)):
        while m - begin > MAX_BYTES:
            begin += MAX_BYTES
            ends.append(begin)
        if m - begin >= MIN_BYTES:
            begin = m
            ends.append(m)
    if len(b) and (not ends or ends[-1] < len(b)):
        ends.append(len(b))
    if len(b) == len(text):
        return ends
    return np.unique(np.searchsorted(np.flatnonzero((b & 0xC0) != 0x80), ends)).tolist()


def _known(chunk: str, v: Vocabulary) -> tuple[int, bytes] | None:
    return v.chunks.get(chunk) or v.older_chunks.get(chunk)


def _keep(chunk: str, entry: tuple[int, bytes], v: Vocabulary) -> None:
    if v.held >= KNOWN_CHARS:
        v.older_chunks, v.chunks, v.held = v.chunks, {}, 0
    if chunk not in v.chunks:
        v.chunks[chunk] = entry
        v.held += len(chunk)


def _learn(texts_and_ends: Iterable[tuple[str, list[int]]], v: Vocabulary) -> dict[str, tuple[int, bytes]]:
    """Every chunk of these texts, encoded alone: where its first word starts whose end is not sure, and the ids of the words before.

    Those not seen before are encoded together: their words are listed once, and the new words merged side by side.
    """
    out: dict[str, tuple[int, bytes]] = {}
    fresh: dict[str, tuple[int, list[str]]] = {}
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        ids = _word_ids(set(chain.from_iterable(words for _, words in fresh.values())), v)
        for chunk, (at, words) in fresh.items():
            out[chunk] = at, b"".join(map(ids.__getitem__, words))
            _keep(chunk, out[chunk], v)
        v.encoded += len(fresh)
        fresh.clear()
        waiting = 0

    for text, ends in texts_and_ends:
        begin = 0
        for end in ends:
            chunk, begin = text[begin:end], end
            if chunk in out or chunk in fresh:
                continue
            if entry := _known(chunk, v):
                out[chunk] = entry
                _keep(chunk, entry, v)
                continue
            words = v.words_of(chunk).findall(chunk)
            k, at = len(words), len(chunk)
            while k and at > len(chunk) - AHEAD:
                k -= 1
                at -= len(words[k])
            fresh[chunk] = at, words[:k]
            waiting += k
            if waiting > WORDS_AT_ONCE:
                flush()
    flush()
    return out


def _segment(text: str, ends: list[int], chunks: dict[str, tuple[int, bytes]], v: Vocabulary) -> Iterator[bytes]:
    """Ids of a text without special tokens, chunk by chunk.

    ``at`` is always a bound between words of the whole text. At a join the words of the text are encoded anew from
    there, and the chunk's own words are passed over, until both have a bound at one place. From there on both are
    the same, as a word depends on nothing before it, up to the words at the chunk's end that the next join repairs.
    """
    match, at, start = v.words_of(text).match, 0, 0
    for end in ends:
        begin, start = start, end
        if at >= end:
            continue
        chunk = text[begin:end]
        size, ids = chunks[chunk]
        sure, own, dropped = begin + size, begin, 0
        while at != own:
            if at < own:
                m = match(text, at)
                yield _word(m[0], v)
                at = m.end()
            elif own < sure:
                m = match(chunk, own - begin)
                dropped += len(_word(m[0], v))
                own = begin + m.end()
            else:
                break
        if at == own and at <= sure:
            yield ids[dropped:]
            at = sure
    while at < len(text):
        m = match(text, at)
        yield _word(m[0], v)
        at = m.end()


def encode_all(all_texts: list[str], v: Vocabulary, special: bool = True) -> list[bytes]:
    """Ids (32-bit integers) of texts. Special tokens in them have their own ids, or are plain text if not ``special``. Empty texts have none."""
    split = v.stop.split if special and v.stop else lambda text: [text]
    parts = [[(part, None if k % 2 else all_bounds(part)) for k, part in enumerate(split(text))] for text in all_texts]
    chunks = _learn(((part, ends) for text in parts for part, ends in text if ends is not None), v)
    one = {name: array("i", [k]).tobytes() for name, k in v.special.items()}
    return [b"".join(chain.from_iterable([one[part]] if ends is None else _segment(part, ends, chunks, v) for part, ends in text)) for text in parts]


def encode(text: str, v: Vocabulary, special: bool = True) -> bytes:
    return encode_all([text], v, special)[0]


def decode(ids: list[int | None] | np.ndarray, v: Vocabulary) -> str:
    """The text of ids, special tokens too. Nulls and ids that the model lacks have no text; bytes that are no UTF-8 are replaced."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    try:
        if ids and min(ids) < 0:  # would count from the end
            raise IndexError
        out = b"".join(map(v.surface.__getitem__, ids))
    except (TypeError, IndexError):
        out = b"".join(v.surface[k] for k in ids if k is not None and 0 <= k < len(v.surface))
    return out.decode("utf-8", "replace")


#: One vocabulary per model in each Python worker, so that what is remembered outlives a task.
_HELD: dict[bytes, Vocabulary] = {}


def held(v: Vocabulary) -> Vocabulary:
    return _HELD.setdefault(v.digest, v).ready()


def all_bounds(text: str) -> list[int]:
    """``bounds`` of a text in parts, so that a long one is never hashed at once."""
    if len(text) <= PART_CHARS:
        return bounds(text)
    return [at + end for at in range(0, len(text), PART_CHARS) for end in bounds(text[at : at + PART_CHARS])]


def sketch(text: str) -> int:
    """The least hash of a text's chunks, signed; texts that have most chunks in common mostly have the same. The empty text has the largest."""
    least, at = (1 << 64) - 1, 0
    for end in all_bounds(text):
        least = min(least, xxhash.xxh3_64_intdigest(text[at:end]))
        at = end
    return least - (1 << 63)


def beside_alike(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with texts that share chunks next to each other, so that the task that has one has the others.

    Rows are dealt by range of sketch and, within one sketch, of a running number: a sketch that a third of all rows
    have is spread over tasks as it needs, each of which encodes its chunks once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in slices(batches, 64):
            keys = pa.array([sketch(t) for t in texts(b.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), keys, pa.array(np.arange(turn, turn + b.num_rows))], ["id", "text", "sketch", "turn"])
            turn += b.num_rows

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(run, "id long, text string, sketch long, turn long").repartitionByRange("sketch", "turn")
    return dealt.sortWithinPartitions("sketch", "turn").select("id", "text")


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """``(id, n_tokens, ids)`` of every row: the ids of the whole text.

    Texts are cut into chunks where their content says so; a task encodes each chunk once, however many of its
    documents have it, and repairs the joins. Chunks are compared by their characters, not by a hash.

    Null and empty texts have no ids. Null ids and repeated rows give a row each; other columns are not read; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model file's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held(shared.value)
        for b in slices(batches, 64):
            lists = [np.frombuffer(ids, np.int32) for ids in encode_all(texts(b.column(1)), v, special)]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), ids], ["id", "n_tokens", "ids"])

    return beside_alike(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids array<int>")


def id_lists(column: pa.ListArray) -> Iterator[list[int | None] | np.ndarray]:
    """The lists of a column; null lists are empty. If no list has nulls they are arrays, which is much faster."""
    flat, ends = column.values, column.offsets.to_pylist()
    whole = None if flat.null_count else flat.to_numpy()
    for k, ok in enumerate(column.is_valid().to_pylist()):
        a, b = ends[k], ends[k + 1]
        yield [] if not ok else flat[a:b].to_pylist() if whole is None else whole[a:b]


def decoded(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, text)`` of rows of ids; null lists are empty texts, and a null or an id that the model lacks has no text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in slices(batches, 64):
            back = [decode(ids, v) for ids in id_lists(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(back, pa.string())], ["id", "ids", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, ids array<int>, text string")


def digests(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of rows of ids: hashes of the ids as little-endian 32-bit integers, nulls left out, and of the text they decode to."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in slices(batches, 64):
            sizes, of_ids, of_text = [], [], []
            for ids in id_lists(b.column(1)):
                known = ids if isinstance(ids, np.ndarray) else np.array([k for k in ids if k is not None], np.int32)
                sizes.append(len(known))
                of_ids.append(hashlib.sha256(known.astype("<i4", copy=False).tobytes()).hexdigest())
                of_text.append(hashlib.sha256(decode(ids, v).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

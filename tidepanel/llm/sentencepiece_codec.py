"""SentencePiece BPE encoding by a streaming trellis over piece boundaries, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units (words with the spaces before them) whose ids a Python worker remembers, twice, and preceding pieces that it remembers of a piece.
KNOWN_UNITS, KNOWN_PAIRS = 350_000, 4_096
#: Longer units are not remembered.
UNIT_CHARS = 48
#: Characters of a text whose units are listed at once; bounds the memory of long texts.
PART_CHARS = 1 << 18
#: Last pieces of a boundary that are none of the model's: the start of a stretch, and a character that is no piece.
START, UNKNOWN = -1, -2
PART_END = re.compile(rf"[^ {SPACE}] ")


@dataclass
class Vocabulary:
    """The pieces of a BPE model with byte fallback: ids, texts and scores of text pieces, the 256 byte ids, and every id's bytes."""

    ids: dict[str, int]
    pieces: list[str]
    scores: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes]
    longest: int
    alone: str
    digest: bytes
    known: dict[str, bytes] = field(default_factory=dict)
    older: dict[str, bytes] = field(default_factory=dict)
    root: Prefix | None = None
    pattern: re.Pattern[str] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "older": {}, "root": None, "pattern": None}

    def ready(self) -> Vocabulary:
        """With the tree of piece prefixes that the stream walks."""
        if self.root is None:
            self.root, self.pattern = prefixes(self.ids), unit_pattern(self)
        return self


@dataclass(slots=True, eq=False)
class Prefix:
    """A prefix of pieces: what may follow it, its longest shorter suffix that is a prefix too, and the pieces that end with it.

    Of each such piece, the longest first, ``ends`` has length, id, and which pieces may stand before it, as far as known.
    """

    size: int
    next: dict[str, Prefix] = field(default_factory=dict)
    shorter: Prefix | None = None
    ends: tuple[tuple[int, int, dict[int, bool]], ...] = ()


def prefixes(ids: dict[str, int]) -> Prefix:
    root = Prefix(0)
    level = []
    for piece, k in ids.items():
        at = root
        for c in piece:
            at = at.next.setdefault(c, Prefix(at.size + 1))
        at.ends = ((len(piece), k, {}),)
    for at in root.next.values():
        at.shorter = root
        level.append(at)
    while level:  # shorter prefixes first, for longer ones build on them
        below = []
        for at in level:
            for c, child in at.next.items():
                up = at.shorter
                while c not in up.next and up is not root:
                    up = up.shorter
                child.shorter = up.next.get(c, root)
                child.ends += child.shorter.ends
                below.append(child)
        level = below
    return root


def load(path: str = MODEL_PATH) -> Vocabulary:
    """Read a model file on the driver; tasks get the piece table, whose size the model fixes."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, pieces, byte_ids, surface = {}, {}, [], [0] * 256, []
    for k in range(p.get_piece_size()):
        piece = p.id_to_piece(k)
        pieces.append(piece)
        if p.is_byte(k):
            value = int(piece[3:5], 16)
            byte_ids[value] = k
            surface.append(bytes([value]))
        elif p.is_control(k) or p.is_unknown(k) or p.is_unused(k):
            surface.append(b"")
        else:
            ids[piece], scores[piece] = k, p.get_score(k)
            surface.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in x.lstrip(SPACE) for x in ids):
        raise ValueError("a piece has a space after another character; units would not be independent")
    merged = set(chain.from_iterable(x for x in ids if len(x) > 1))
    if merged - ids.keys():
        raise ValueError("a character of a piece is no piece; boundaries after it would have no path")
    digest = hashlib.sha1(repr(sorted(scores.items())).encode() + repr(ids).encode()).digest()
    return Vocabulary(ids, pieces, scores, byte_ids, surface, max(map(len, ids)), "".join(c for c in "\n\t\r" if c not in merged), digest)


def merges(text: str, v: Vocabulary) -> list[str]:
    """BPE by its definition, for short strings: join the best-scored neighbours, the leftmost of equals, until none is a piece."""
    parts = list(text)
    while len(parts) > 1:
        best = max(((v.scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in v.scores), default=None)
        if best is None:
            break
        k = -best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def _follows(left: int, right: int, known: dict[int, bool], v: Vocabulary) -> bool:
    """Whether BPE leaves these two pieces apart when they stand alone; then it does so in any text."""
    if len(known) >= KNOWN_PAIRS:
        known.clear()
    before, piece = ([v.pieces[left]] if left >= 0 else []), v.pieces[right]
    out = known[left] = merges("".join(before) + piece, v) == [*before, piece]
    return out


def stream(text: str, v: Vocabulary) -> Iterator[list[int]]:
    """Pieces (``UNKNOWN`` for a character that is none) of a text without runs of spaces, in runs, each yielded as soon as it is certain.

    The trellis has a state for each boundary: the last piece of the best path that ends there, which is the one
    that BPE leaves apart from the last piece of the boundary where it starts. A later piece can start only where
    the text up to now ends with a prefix of a piece, so only the paths of the last few boundaries survive,
    ``longest`` at most. Whenever two such windows are held, the back-pointers of the survivors are followed until
    they meet at one boundary; all before it is yielded and forgotten, and the piece that ends there still decides
    what may follow.
    """
    last, most, root = [START], 2 * v.longest, v.root
    at = root
    for c in text:
        found = at.next.get(c)
        while found is None and at is not root:
            at = at.shorter
            found = at.next.get(c)
        if found is None:
            last.append(UNKNOWN)
        else:
            at = found
            for size, piece, known in at.ends:
                left = last[-size]
                ok = known.get(left)
                if _follows(left, piece, known, v) if ok is None else ok:
                    last.append(piece)
                    break
            else:
                raise ValueError("no piece fits here: the scores are not those of BPE")
        if len(last) > most and (meet := _meet(last, at.size, v)):
            yield _path(last, meet, v)
            last = last[meet:]
    yield _path(last, len(last) - 1, v)


def _back(last: list[int], at: int, v: Vocabulary) -> int:
    return at - (len(v.pieces[last[at]]) if last[at] >= 0 else 1)


def _meet(last: list[int], depth: int, v: Vocabulary) -> int:
    """The boundary at which the paths of all survivors, the last ``depth`` boundaries and this one, meet; 0 if only what was yielded before is sure."""
    alive = set(range(len(last) - 1 - depth, len(last)))
    while len(alive) > 1:
        top = max(alive)
        alive.remove(top)
        alive.add(max(0, _back(last, top, v)))
    return alive.pop()


def _path(last: list[int], at: int, v: Vocabulary) -> list[int]:
    out = []
    while at > 0:
        out.append(at)
        at = _back(last, at, v)
    return [last[k] for k in reversed(out)]


def _run(n: int, v: Vocabulary) -> list[str]:
    """Pieces of n spaces. Their merges have one score, so the leftmost possible one comes first."""
    parts: list[str] = []
    for _ in range(n):
        parts.append(SPACE)
        while len(parts) > 1 and parts[-2] + parts[-1] in v.scores:
            parts[-2:] = [parts[-2] + parts[-1]]
    return parts


def _unit(unit: str, v: Vocabulary) -> bytes:
    """Ids of spaces followed by other characters. Those take the last space into their pieces before spaces merge, as the scores of these are lowest."""
    word = unit.lstrip(SPACE)
    spaces = len(unit) - len(word)
    text = SPACE * min(1, spaces) + word if word else ""
    ids = [k for run in stream(text, v) for k in run] if text else []
    if UNKNOWN in ids:
        ids = with_bytes(ids, text, v)
    if spaces > 1 or not word:
        own = word and ids[0] == v.ids.get(SPACE)  # the last space joins the run
        ids = [v.ids[p] for p in _run(spaces - (bool(word) and not own), v)] + (ids[1:] if own else ids)
    return array("i", ids).tobytes()


def with_bytes(pieces: list[int], text: str, v: Vocabulary) -> list[int]:
    """The pieces of a text, with the bytes of its characters that are no piece in their place."""
    out, at = [], 0
    for k in pieces:
        if k >= 0:
            out.append(k)
            at += len(v.pieces[k])
        else:
            out += [v.byte_ids[b] for b in text[at].encode("utf-8", "surrogatepass")]
            at += 1
    return out


def unit_pattern(v: Vocabulary) -> re.Pattern[str]:
    """Units at whose bounds all paths meet, as no piece crosses them: spaces with the word after them, or a character that only stands alone.

    Where no piece holds a letter beside another character, words end with their letters.
    """
    alone = re.escape(v.alone)
    numerals = "".join(sorted({c for x in v.ids for c in x if c.isalnum() and not c.isalpha()}))
    letter = re.compile(rf"[^\W\d_{re.escape(numerals)}]")
    pairs = {x[k : k + 2] for x in v.ids for k in range(len(x) - 1)}
    apart = all(bool(letter.match(a)) == bool(letter.match(b)) for a, b in pairs if a != SPACE)
    words = rf"{SPACE}*{letter.pattern}+|{SPACE}*(?:(?!{letter.pattern})[^{SPACE}{alone}])+" if apart else f"{SPACE}*[^{SPACE}{alone}]+"
    return re.compile(f"{words}|{SPACE}+" + (f"|[{alone}]" if alone else ""))


def encode(text: str, v: Vocabulary) -> bytes:
    """Ids (32-bit integers) of a text: a space is put before it, spaces become ``▁``, nothing else is changed. An empty text has none.

    What the stream commits between two bounds is remembered by its characters, so repeated words are looked up.
    """
    out: list[bytes] = []
    at, lead = 0, SPACE
    while at < len(text):
        end = PART_END.search(text, at + PART_CHARS)
        stop = end.end() - 1 if end else len(text)
        units = v.pattern.findall(lead + text[at:stop].replace(" ", SPACE))
        at, lead = stop, ""
        got = list(map(v.known.get, units))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    got[k] = _learn(units[k], v)
        out += got
    return b"".join(out)


def _learn(unit: str, v: Vocabulary) -> bytes:
    ids = v.known.get(unit) or v.older.get(unit) or _unit(unit, v)
    if len(unit) <= UNIT_CHARS:
        if len(v.known) >= KNOWN_UNITS:  # what was used since the last change stays
            v.older, v.known = v.known, {}
        v.known[unit] = ids
    return ids


def decode(ids: list[int | None], v: Vocabulary) -> str:
    """The text of ids, without the space that encoding put before it. Control ids, nulls and ids that the model lacks have no text; bytes that are no UTF-8 are replaced."""
    try:
        text = b"".join(map(v.surface.__getitem__, ids))
    except (TypeError, IndexError):
        text = b"".join(v.surface[k] for k in ids if k is not None and 0 <= k < len(v.surface))
    text = text.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


#: One vocabulary per model in each Python worker, so that remembered units outlive a task.
_HELD: dict[bytes, Vocabulary] = {}


def _held(v: Vocabulary) -> Vocabulary:
    return _HELD.setdefault(v.digest, v).ready()


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_ids, ids, exact)`` of every row: the ids of the whole text, and whether decoding them gives it back.

    ``▁`` in a text comes back as a space; ``exact`` allows for that. Null and empty texts have no ids. Null
    ids and repeated rows give a row each; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model file's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _held(shared.value)
        for b in slices(batches, 64):
            all_texts = texts(b.column(1))
            lists = [np.frombuffer(encode(t, v), np.int32) for t in all_texts]
            exact = [decode(i.tolist(), v) == t.replace(SPACE, " ") for i, t in zip(lists, all_texts, strict=True)]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), ids, pa.array(exact, pa.bool_())], ["id", "n_ids", "ids", "exact"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_ids long, ids array<int>, exact boolean")


def decoded(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of rows of ids; null lists are empty texts, and a null or an id that the model lacks has no text."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(i or [], v) for i in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")

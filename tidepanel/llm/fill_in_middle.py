"""Fill-in-middle texts by rotating blocks in place, and the way back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, utf8

#: Sentinels before the prefix, the suffix and the middle. Each starts and ends with a character that it has nowhere else, so none arises across a bound.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many stay plain; of 100 others, so many give the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20
OUT_SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(body: bytes) -> np.ndarray:
    """Byte offsets at which units start: a run of ASCII letters, or any other code point."""
    b = np.frombuffer(body, np.uint8)
    lower = b | 0x20
    letter = (lower >= 97) & (lower <= 122) & (b < 128)
    inside = (b & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four numbers that the id alone decides; a null id counts as the empty text."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in range(0, 32, 8))


def rotate(block: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange ``block[start:middle]`` and ``block[middle:end]`` in place: reverse both, then the whole."""
    for i, j in ((start, middle), (middle, end), (start, end)):
        part = np.frombuffer(block, np.uint8)[i:j]
        half = (j - i) // 2
        head = part[:half].copy()
        part[:half] = part[::-1][:half]
        part[len(part) - half :] = head[::-1]


def transformed(body: bytes, doc_id: int | None) -> tuple[int, str, int, int, bytes]:
    """Number of units, form, byte length of prefix and middle (0 if plain), and the text in that form."""
    starts = unit_starts(body)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not body or h3 % 100 >= 100 - PLAIN_PERCENT or any(s in body for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", 0, 0, body
    cuts = [*sorted((h1 % (n + 1), h2 % (n + 1)))]
    a, b = (int(starts[c]) if c < n else len(body) for c in cuts)
    block = bytearray(body)
    block[b:b] = SUFFIX
    block[a:a] = MIDDLE
    block[0:0] = PREFIX
    at, last = len(PREFIX) + a, len(PREFIX) + b + len(MIDDLE)
    spm = h4 % 100 < SUFFIX_FIRST_PERCENT
    rotate(block, 0 if spm else at, last, len(block))
    return n, "spm" if spm else "psm", a, b - a, bytes(block)


def restored(output: bytes, form: str) -> bytes:
    """The text that was put into this form: the rotation the other way round, then the sentinels go."""
    if form == "plain":
        return output
    block = bytearray(output)
    if form == "psm":  # prefix, suffix, middle
        start, cut = block.index(SUFFIX), block.index(MIDDLE)
    else:  # suffix, prefix, middle
        start, cut = 0, block.index(PREFIX)
    rotate(block, start, cut, len(block))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = block.index(mark)
        del block[at : at + len(mark)]
    return bytes(block)


def _chars(body: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row: its text in plain, psm or spm form.

    The text is cut between units (runs of ASCII letters, other code points) at two places, and the form is chosen,
    by a hash of the id alone, so copies of a row are cut alike and a repeated run gives the same. A text that has a
    sentinel in it stays plain, for it could not be taken apart. Null and empty texts are plain and empty. A null id
    hashes as the empty text; repeated rows give a row each. Other columns are not read; an empty table gives an
    empty result. A task holds some rows' texts at once, never more than 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for doc_id, body in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                n, form, prefix, middle, output = transformed(body, doc_id)
                plain = form == "plain"
                rows.append((n, form, None if plain else _chars(body[:prefix]), None if plain else _chars(body[prefix : prefix + middle]), output))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays[:4], arrays[4].cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, OUT_SCHEMA)


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output", text_col: str = "restored") -> DataFrame:
    """``rows`` with the text rebuilt from its form and output alone, in a column ``text_col`` that takes the place of one of that name.

    A null output is the empty text; a null form, or one that is none of the three, is plain.
    """
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    source = rows.select(*kept, F.col(form_col).alias(text_col + "_form"), F.col(output_col).alias(text_col + "_output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            forms, outputs = b.column(len(kept)).to_pylist(), utf8(b.column(len(kept) + 1))
            back = [restored(o, f if f in ("psm", "spm") else "plain") for f, o in zip(forms, outputs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(back, pa.binary()).cast(pa.string())], [*kept, text_col])

    return source.mapInArrow(run, rows.select(*kept).withColumn(text_col, F.lit("").cast("string")).schema)

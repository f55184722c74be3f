"""Removal of repeated passages by hashing of normalised units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, slices, texts
from tidepanel.llm.spans import cut, keyed_texts, rank

#: A removed passage has at least so many words in consecutive repeated units.
MIN_WORDS = 12
UNIT_END = re.compile(r"\n+|[.!?]+[\"')\]]*\s+")
WORD = re.compile(r"\w+")
UNIT_SCHEMA = "id long, row long, at int, start int, end int, words int, d1 long, d2 long, again boolean"


def units(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and normalised words of each line or, in lines of several sentences, of each sentence."""
    start = 0
    for end in [*(m.end() for m in UNIT_END.finditer(text)), len(text)]:
        if words := WORD.findall(text[start:end].lower()):
            yield start, end, words
            start = end


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per unit with words: its place, a 128-bit digest, and whether its own document had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of, at, start, end, words, digests, again = [], [], [], [], [], [], []
            for i, text in enumerate(texts(b.column(2))):
                seen: set[bytes] = set()
                for k, (s, e, w) in enumerate(units(text)):
                    digest = xxhash.xxh128_digest(" ".join(w))
                    of.append(i)
                    at.append(k)
                    start.append(s)
                    end.append(e)
                    words.append(len(w))
                    digests.append(digest)
                    again.append(digest in seen)
                    seen.add(digest)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(of, pa.int32())
            ints = [pa.array(x, pa.int32()) for x in (at, start, end, words)]
            longs = [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *ints, *longs, pa.array(again, pa.bool_())], ["id", "row", "at", "start", "end", "words", "d1", "d2", "again"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, UNIT_SCHEMA)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, start, end, words, kept_id)``: passages that an earlier document, or the same one before, has.

    Units are lines, or the sentences of a line, in lower case and without punctuation. Of equal units the one
    with the smallest document id stays (null last), within a document the first. Consecutive units that do
    not stay make up a passage if they have ``min_words`` words together; ``start`` and ``end`` are its
    character offsets in the original text and ``kept_id`` is where its first unit stays.

    Texts that are null, empty or without words have no units. Rows equal in id and text are one document.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = materialise(unit_rows(docs, id_col, text_col), "units")
    once = rows.filter("not again")
    # written, so that the join deals both sides anew and can split what one common unit gathers
    first = materialise(once.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(rank()).alias("first")).filter("n > 1").drop("n"), "first")
    other = once.join(first, ["d1", "d2"]).filter(rank() != F.col("first"))
    spans = other.select("id", "row", "at", "start", "end", "words", F.col("first.id").alias("kept_id"))
    own = rows.filter("again").select("id", "row", "at", "start", "end", "words", F.col("id").alias("kept_id"))
    dropped = spans.unionByName(own).distinct()
    # units that follow each other have the same difference of position and row number
    by_row = Window.partitionBy("row").orderBy("at")
    runs = dropped.withColumn("run", F.col("at") - F.row_number().over(by_row))
    passages = runs.groupBy("id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("kept_id", "at").alias("kept_id"))
    return passages.filter(F.col("words") >= min_words).drop("run")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_spans") -> DataFrame:
    """``docs`` without their repeated passages, and the removed spans as offsets in the original text."""
    return cut(docs, repeated_spans(docs, min_words, id_col, text_col), id_col, text_col, removed_col)

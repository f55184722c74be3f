"""Removal of lines that repeat across a corpus: whole runs of lines, or chunks whose bounds follow from the lines' content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise, slices, texts
from tidepanel.llm.spans import cut, keyed_texts, rank

#: A chunk has at least so many lines, unless the text ends before.
MIN_LINES = 2
#: One line in so many ends a chunk.
DIVISOR = 2
#: Lines under the rolling hash: a bound depends on these alone, so texts fall in step again after an edit.
ROLL_LINES = 2
MASK = (1 << 64) - 1
CHUNK_SCHEMA = "id long, row long, at int, start int, end int, lines int, d1 long, d2 long"
PAIR_SCHEMA = "id long, row long, at int, start int, middle int, end int, d1 long, d2 long"


def chunks(text: str, min_lines: int = MIN_LINES, divisor: int = DIVISOR, roll: int = ROLL_LINES) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of lines of a text's chunks; lines keep their line feed, so chunks cover the text."""
    start = at = count = rolled = 0
    recent: list[int] = []
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        line = xxhash.xxh64_intdigest(text[at:end].rstrip("\n"))
        recent.append(line)
        old = recent.pop(0) if len(recent) > roll else 0
        # rotate by one, take out the line that leaves the window, take in the new one
        rolled = ((rolled << 1 | rolled >> 63) & MASK) ^ ((old << roll | old >> (64 - roll)) & MASK) ^ line
        count, at = count + 1, end
        if count >= min_lines and (rolled * 0x9E3779B97F4A7C15 & MASK) >> 32 & 0xFFFF < 0x10000 // divisor:
            yield start, at, count
            start, count = at, 0
    if count:
        yield start, at, count


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per chunk of several lines: its place and a 128-bit digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of, places, digests = [], [], []
            for i, text in enumerate(texts(b.column(2))):
                for k, (s, e, n) in enumerate(chunks(text)):
                    if n > 1 and (body := text[s:e].rstrip("\n")):
                        of.append(i)
                        places.append((k, s, e, n))
                        digests.append(xxhash.xxh128_digest(body))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take, ints = pa.array(of, pa.int32()), np.array(places, np.int32).reshape(-1, 4)
            longs = [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.ascontiguousarray(ints[:, k])) for k in range(4)), *longs], ["id", "row", "at", "start", "end", "lines", "d1", "d2"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, CHUNK_SCHEMA)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, at, start, end, lines, kept_id)``: chunks of several lines whose bytes an earlier chunk has.

    The chunk of the smallest document id stays (null last), within a document the first. Digests only find
    the candidates: chunks count as equal if their bytes, the line feed after the last line aside, are.

    Null and empty texts have no chunks, nor have chunks of line feeds alone. Rows equal in id and text are
    one document. Other columns are not read. An empty table gives an empty result.
    """
    rows = materialise(chunk_rows(docs, id_col, text_col), "chunks")
    often = rows.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    places = rows.join(often, ["d1", "d2"]).groupBy("row").agg(F.collect_set(F.struct("at", "start", "end", "lines", "d1", "d2")).alias("places"))
    held = keyed_texts(docs, id_col, text_col).join(places, "row").select("id", "row", "text", F.explode("places").alias("p"))
    body = F.rtrim(F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), F.lit("\n"))
    found = materialise(held.select("id", "row", "p.*", body.alias("body")).distinct(), "candidates")
    first = found.groupBy("d1", "d2", "body").agg(F.count("*").alias("n"), F.min(rank()).alias("first")).filter("n > 1").drop("n")
    other = found.join(first, ["d1", "d2", "body"]).filter(rank() != F.col("first"))
    return other.select("id", "row", "at", "start", "end", "lines", F.col("first.id").alias("kept_id"))


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` without their repeated chunks; with ``removed_col``, also the removed spans of the original text."""
    return cut(docs, repeated_chunks(docs, id_col, text_col), id_col, text_col, removed_col)


def line_pairs(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Number of the first line, start, middle and end of every two lines that follow each other, unless both are empty."""
    at, start, middle = 0, 0, text.find("\n") + 1
    while 0 < middle < len(text):
        end = text.find("\n", middle) + 1 or len(text)
        if text[start:end].strip("\n"):
            yield at, start, middle, end
        at, start, middle = at + 1, middle, end


def pair_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per pair of lines: the number and place of its first line, and a 128-bit digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            of, places, digests = [], [], []
            for i, text in enumerate(texts(b.column(2))):
                for k, s, m, e in line_pairs(text):
                    of.append(i)
                    places.append((k, s, m, e))
                    digests.append(xxhash.xxh128_digest(text[s:e].rstrip("\n")))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take, ints = pa.array(of, pa.int32()), np.array(places, np.int32).reshape(-1, 4)
            longs = [pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(np.ascontiguousarray(ints[:, k])) for k in range(4)), *longs], ["id", "row", "at", "start", "middle", "end", "d1", "d2"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, PAIR_SCHEMA)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, at, start, end, lines, kept_id)``: all runs of two or more lines that an earlier place has.

    A line goes if it and a neighbour are two lines, equal in bytes, that follow each other at an earlier place:
    in a document with a smaller id (null last), or before in the same one. So a run is found wherever it
    starts and ends and whatever stands around it. ``at`` is the number of its first line and ``kept_id`` the
    document where its first two lines come first. Two equal lines that overlap their own first place lose the second
    one only. The line feed after a pair's last line does not count. Digests only find the candidates.

    Null and empty texts have no pairs, nor have empty lines alone. Single repeated lines stay. Rows equal in id
    and text are one document. Other columns are not read. An empty table gives an empty result.
    """
    rows = materialise(pair_rows(docs, id_col, text_col), "pairs")
    # written, as is ``first``, so that the joins deal both sides anew and can split what one common pair gathers
    often = materialise(rows.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "often")
    places = rows.join(often, ["d1", "d2"]).groupBy("row").agg(F.collect_set(F.struct("at", "start", "middle", "end", "d1", "d2")).alias("places"))
    held = keyed_texts(docs, id_col, text_col).join(places, "row").dropDuplicates(["row"]).select("id", "row", "text", F.explode("places").alias("p"))
    body = F.rtrim(F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), F.lit("\n"))
    found = materialise(held.select("id", "row", "p.*", body.alias("body")), "candidates")
    first = materialise(found.groupBy("d1", "d2", "body").agg(F.count("*").alias("n"), F.min(rank()).alias("first")).filter("n > 1").drop("n"), "first")
    other = found.join(first, ["d1", "d2", "body"]).filter(rank() != F.col("first"))
    overlaps = (F.col("first.row") == F.col("row")) & (F.col("first.at") + 1 == F.col("at"))
    head = F.struct("at", "start", F.col("middle").alias("end"))
    tail = F.struct((F.col("at") + 1).alias("at"), F.col("middle").alias("start"), "end")
    each = other.select("id", "row", F.explode(F.when(overlaps, F.array(tail)).otherwise(F.array(head, tail))).alias("l"), F.col("first.id").alias("kept_id"), F.col("at").alias("pair"))
    lines = each.groupBy("id", "row", "l").agg(F.max_by("kept_id", "pair").alias("kept_id")).select("id", "row", "l.*", "kept_id")
    # lines that follow each other have the same difference of number and row number
    runs = lines.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at")))
    spans = runs.groupBy("id", "row", "run").agg(F.min("at").alias("at"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").cast("int").alias("lines"), F.min_by("kept_id", "at").alias("kept_id"))
    return spans.drop("run")


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` without their repeated runs of lines; with ``removed_col``, also the removed spans of the original text."""
    return cut(docs, repeated_runs(docs, id_col, text_col), id_col, text_col, removed_col)

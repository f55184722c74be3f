"""SimHash near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh_name, materialise, slices, utf8
from tidepanel.llm.components import connected_components

SEED = 42
#: Fingerprints within ``RADIUS`` bits are linked: in one of ``SEGMENTS`` segments they are then within one bit.
RADIUS = 2
SEGMENT_BITS = 32
SEGMENTS = 2
SEGMENT_MASK = (1 << SEGMENT_BITS) - 1
#: Fingerprints that one value of a segment table is looked up with pair by pair; more are linked through entries.
BUCKET = 64
#: Fingerprints whose balls one task enumerates.
SPREAD_ROWS = 16_000


def fingerprint(text: bytes, width: int) -> int:
    """The 64-bit SimHash of a text's word shingles as a signed integer; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, fingerprint)`` of every row, over the whole text; ``row`` is a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            prints = pa.array([fingerprint(t, width) for t in utf8(b.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), prints], ["id", "row", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, row long, fingerprint long")


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def segment(column: str | Column, k: int) -> Column:
    """The value of a fingerprint's ``k``-th segment, with the segment's number above it: a key of the segment tables."""
    bits = F.shiftrightunsigned(column, k * SEGMENT_BITS).bitwiseAND(F.lit(SEGMENT_MASK))
    return bits.bitwiseOR(F.lit(k << SEGMENT_BITS))


def segment_tables(prints: DataFrame) -> DataFrame:
    """``(key, fingerprint)``: every fingerprint under the value of each of its segments."""
    keys = F.array(*[segment("fingerprint", k) for k in range(SEGMENTS)])
    return prints.select(F.explode(keys).alias("key"), "fingerprint")


def probes(prints: DataFrame) -> DataFrame:
    """``(key, fingerprint, off)``: the keys of each segment's Hamming ball of radius one; ``off`` is the key's distance, 0 or 1."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])

    def ball(k: int) -> Column:
        return F.transform(flips, lambda f: F.struct(segment("fingerprint", k).bitwiseXOR(f).alias("key"), (f != 0).cast("int").alias("off")))

    return prints.select("fingerprint", F.explode(F.concat(*map(ball, range(SEGMENTS)))).alias("p")).select("p.key", "fingerprint", "p.off")


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(u, v)`` that join all distinct fingerprints at two or fewer differing bits into the right components.

    Two fingerprints within two bits are within one bit in one of their two segments. So each looks up, for every
    segment, all values of the Hamming ball of radius one in the table of that segment, and the whole distance of
    what it finds is verified. A table's value that over ``bucket`` fingerprints have isn't looked up in this way, as
    that would yield all their pairs: see ``_crowded``.
    """
    spark = prints.sparkSession
    n = prints.count()
    # the table is small in bytes, but each row looks up 66 values: it is dealt by number
    prints = prints.repartition(max(spark.sparkContext.defaultParallelism, n // SPREAD_ROWS + 1), "fingerprint")
    table, asked = segment_tables(prints), probes(prints)
    crowded = materialise(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket).select("key"), "crowded")
    some = not crowded.isEmpty()
    if some:
        table = table.join(crowded, "key", "left_anti")
    met = asked.select("key", F.col("fingerprint").alias("u")).join(table.withColumnRenamed("fingerprint", "v"), "key").filter("u < v")
    links = met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v")
    return links.union(_crowded(asked.join(crowded, "key"))) if some else links


def _crowded(asked: DataFrame) -> DataFrame:
    """Links among the fingerprints that look up a value which many have, without their pairs.

    Those that have the value itself differ in up to two bits of the rest: each is entered under every value of the
    rest's ball of radius one, where two such fingerprints meet. One that is a bit off has one bit left: it is entered
    under its own rest. An entry holds 65 distinct fingerprints at most, all within two bits of each other, and each is
    linked to the least of them.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    upper = F.shiftrightunsigned("key", SEGMENT_BITS) == 1
    rest = F.when(upper, F.col("fingerprint").bitwiseAND(F.lit(SEGMENT_MASK))).otherwise(F.shiftrightunsigned("fingerprint", SEGMENT_BITS))
    own = F.when(F.col("off") == 0, F.transform(flips, lambda f: F.col("rest").bitwiseXOR(f))).otherwise(F.array("rest"))
    entries = asked.withColumn("rest", rest).select("key", "fingerprint", F.explode(own).alias("entry"))
    heads = entries.groupBy("key", "entry").agg(F.min("fingerprint").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = entries.join(heads, ["key", "entry"]).filter("fingerprint <> v").select(F.col("fingerprint").alias("u"), "v")
    return met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def fingerprint_roots(rows: DataFrame) -> DataFrame:
    """``(fingerprint, root)``: of every distinct fingerprint, the one that stands for its component."""
    prints = materialise(rows.select("fingerprint").distinct(), "prints")
    roots = connected_components(near_links(prints))
    return prints.join(roots, prints["fingerprint"] == roots["u"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def simhash_classes(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of two or fewer differing bits, itself included.
    Null and empty texts have fingerprint zero and link like any other. A repeated id gives a row each time.
    A null id is kept and never is a component's id, unless no other is reachable: then that is null. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = materialise(with_fingerprints(docs, width, id_col, text_col), "fingerprints")
    rooted = materialise(fingerprint_roots(rows), "roots")
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("id"))
    ids = least.join(rooted, "fingerprint").groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fingerprint", "component_id"), "fingerprint").select("id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each near-duplicate class; the columns stay.

    The row with the smallest id stays, a null id being the largest; rows that share it are told apart by a
    hash of their text, and of rows with equal id and text any one stays.
    """
    rows = materialise(with_fingerprints(docs, width, id_col, text_col), "fingerprints")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    least = rows.groupBy("fingerprint").agg(F.min(rank).alias("rank"))
    key = fresh_name(docs, "__row")
    keep = least.join(fingerprint_roots(rows), "fingerprint").groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(key))
    return docs.withColumn(key, _row_key(id_col, text_col)).join(keep, key, "left_semi").dropDuplicates([key]).select(*docs.columns)

"""Character spans of documents: keys for rows, and cutting spans out of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh_name


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text; rows that are equal in both are one document."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, text)``, the id as a long."""
    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))


def rank() -> Column:
    """The order in which documents keep what others repeat: by id, null last, then by row hash, then by position."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "at")


def cut(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with ``spans(row, start, end)`` taken out of their texts; spans of a row must not overlap.

    The columns stay. With ``removed_col``, the removed spans are added in a column of that name (with ``_`` added to
    it as long as ``docs`` has one), as offsets in the original text.
    """
    key, held = fresh_name(docs, "__row"), fresh_name(docs, "__spans")
    per_row = spans.groupBy(F.col("row").alias(key)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(held))
    both = docs.withColumn(key, row_key(id_col, text_col)).join(per_row, key, "left")
    size = F.size(held)

    def piece(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get(held, k - 1)["end"])
        stop = F.when(k == size, F.length(text_col)).otherwise(F.get(held, k)["start"])
        return F.substring(F.col(text_col), begin + 1, stop - begin)

    kept = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(0), size), piece)))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return both.select(*columns, *([F.coalesce(held, F.array().cast("array<struct<start:int,end:int>>")).alias(fresh_name(docs, removed_col))] if removed_col else []))

"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task handles at once; bounds the lists it builds beside the Arrow data.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a single machine) is a
    temporary folder made and registered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidepanel-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts its lineage.

    Its shuffle files go when it is written, for nothing reads them again; the session's setting stays as it was.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column; nulls are empty."""
    return [x or "" for x in column.to_pylist()]


def is_held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name

"""Corpus cleaning in stages: each reads the documents that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, line_dedup, near_copies, sentencepiece_codec, toxicity
from tidepanel.llm.common import fresh_name, materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out of the texts and n_chars follows; a document of which nothing is left goes."""
    length, was = fresh_name(docs, "__length"), fresh_name(docs, "__was")
    cut = line_dedup.drop_repeated_runs(docs.withColumn(was, F.length("text"))).withColumn(length, F.length("text"))
    left = cut.filter(F.col(length).isNull() | (F.col(length) > 0) | (F.col(was) == 0))
    changed = F.when(F.col(length) < F.col(was), F.col(length).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns) if "n_chars" in docs.columns else left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: SimHash fingerprints within two bits, or five-word shingles of a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left; exact tells that decoding gives its text back."""
    return sentencepiece_codec.encoded(docs, sentencepiece_codec.load()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", line_chunks),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("sentencepiece", tokens),
]

#: No SQL expresses the learned and hashed stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

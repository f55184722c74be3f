"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import alignment, bpe_codec, decontaminate, fill_in_middle, html_text, katz, line_dedup, quality, sentencepiece_codec, simhash, substring_dedup, toxicity, warc
from tidepanel.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("window").cast("long").alias("window_words"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written as WARC records and read back; size and digest are taken from the payload that was read."""
    path = new_path(spark, "warc")
    warc.write_warc(warc.page_records(_table(spark, sf_dir, "pages")), path)
    back = warc.read_warc(spark, path)
    return back.select(
        warc.page_of("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        warc.page_of("refers_to").alias("refers_to"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives the text back."""
    out = sentencepiece_codec.encoded(_table(spark, sf_dir, "documents"), sentencepiece_codec.load())
    return out.withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed passage, with its offsets in the original text."""
    out = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("words").alias("n_words"), F.col("kept_id").alias("kept_doc_id"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "probability")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed run of lines, with its offsets in the original text; chunk is the number of its first line."""
    out = line_dedup.repeated_runs(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("at").alias("chunk"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("lines").alias("n_lines"), F.col("kept_id").alias("kept_doc_id"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(_table(spark, sf_dir, "documents"), alignment.load()).withColumnRenamed("id", "doc_id")


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe_codec.load()
    out = bpe_codec.encoded(_table(spark, sf_dir, "documents"), model)
    return bpe_codec.digests(out, model).withColumnRenamed("id", "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


#: Word-by-word alignment on each offset, without seeds; the masks find every window that this accepts.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS at FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS at FROM i),
m AS (SELECT doc_id, item_id, n, iw.at AS ip, dw.at - iw.at AS diagonal FROM dw JOIN iw USING (word)),
c AS (SELECT doc_id, item_id, least(13, n) AS size, count(*) OVER (PARTITION BY doc_id, item_id, n, diagonal ORDER BY ip RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM m WHERE n >= 3)
SELECT doc_id, item_id, CAST(max(k) AS BIGINT) AS matched, CAST(max(size) AS BIGINT) AS window_words FROM c WHERE k >= CASE WHEN size < 6 THEN size ELSE 0.8 * size END GROUP BY doc_id, item_id
"""

OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes >= 1000
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
c AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": OP2_SQL, "op4_warc": OP4_SQL, "op13_fill_in_middle": OP13_SQL}

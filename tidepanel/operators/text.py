"""Filing text: cleaning, tokens, similarity to the prior filing, tone by word lists."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.functions.columns import col, div


def html_to_text(x: Column | str) -> Column:
    """Markup, scripts and styles out, references of spaces and ampersands decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(col(x), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    decoded = F.regexp_replace(F.regexp_replace(bare, "&nbsp;", " "), "&amp;", "&")
    return F.trim(F.regexp_replace(decoded, r"\s+", " "))


def words(x: Column | str) -> Column:
    """Lower-case runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(r"([a-z']+)"), 1)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared over all distinct elements of two arrays; null if both are empty."""
    return div(F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b))))


def char_grams(x: Column | str, n: int = 4) -> Column:
    """Distinct character n-grams of a text."""
    t = col(x)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda k: F.substring(t, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def similarity_to_prior(filings: DataFrame, least_chars: int = 100) -> DataFrame:
    """Word Jaccard of each usable filing against the ticker's filing before it; ``filings(ticker, seq, text)``."""
    usable = filings.filter(F.length("text") >= least_chars).withColumn("_w", F.array_distinct(words("text")))
    prior = F.lag("_w").over(Window.partitionBy("ticker").orderBy("seq"))
    return usable.withColumn("_p", prior).withColumn("value", F.when(F.col("_p").isNotNull(), jaccard("_w", "_p"))).drop("_w", "_p")


#: Parts of a ticker's filings in the order of their numbers, each a group of its own.
PARTS = 64
WORD = re.compile(rb"[a-z']+")


def with_prior(filings: DataFrame, parts: int = PARTS) -> DataFrame:
    """``filings(ticker, seq, text)`` with ``prior``, the text of the ticker's filing before it.

    A ticker's filings are cut into parts by sampled quantiles of ``seq``, which only set the parts' sizes: the last
    filing of each part goes to the next one too, so no group holds all of a ticker. What is broadcast is one row a
    ticker, and one a part.
    """
    cuts = filings.groupBy(F.col("ticker").alias("_t")).agg(F.percentile_approx("seq", [k / parts for k in range(1, parts)], 1000).alias("_cuts"))
    b = filings.join(F.broadcast(cuts), F.col("ticker").eqNullSafe(F.col("_t")))
    b = b.select("ticker", "seq", "text", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col("seq"))).alias("_part"))
    ends = b.groupBy(F.col("ticker").alias("_t"), F.col("_part").alias("_p")).agg(F.max("seq").alias("_end"))
    ends = ends.withColumn("_next", F.lead("_p").over(Window.partitionBy("_t").orderBy("_p"))).filter("_next is not null")
    last = F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")) & F.col("seq").eqNullSafe(F.col("_end"))
    carried = b.join(F.broadcast(ends), last).select("ticker", "seq", "text", F.col("_next").alias("_part"), F.lit(False).alias("_own"))
    line = b.withColumn("_own", F.lit(True)).unionByName(carried)
    prior = F.lag("text").over(Window.partitionBy("ticker", "_part").orderBy("seq"))
    return line.withColumn("prior", prior).filter("_own").select("ticker", "seq", "text", "prior")


def cosine(a: Counter, b: Counter) -> float | None:
    """Cosine of two texts' word counts, weighted by a smoothed document frequency over the two; None if one has no words."""
    alone = math.log(1.5) + 1  # a word of both weighs one
    norm = [math.sqrt(sum((n if w in other else n * alone) ** 2 for w, n in c.items())) for c, other in ((a, b), (b, a))]
    return sum(n * b[w] for w, n in a.items() if w in b) / (norm[0] * norm[1]) if a and b else None


def tfidf_cosine(filings: DataFrame, least_chars: int = 100) -> DataFrame:
    """Cosine of each filing and the one before it under word weights with a smoothed document frequency over the pair.

    Two texts without words give no row. Words are counted beside their text: none is shuffled.
    """
    both = with_prior(filings.filter(F.length("text") >= least_chars).select("ticker", "seq", "text")).filter("prior is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, found = [], []
            for k in range(batch.num_rows):
                a, b = (Counter(WORD.findall(batch.column(c)[k].as_py().encode())) for c in (2, 3))
                if a or b:
                    kept.append(k)
                    found.append(cosine(a, b))
            rows = batch.select([0, 1]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], ["ticker", "seq", "value"])

    schema = StructType([filings.schema["ticker"], filings.schema["seq"]]).add("value", "double")
    return both.select("ticker", "seq", F.lower("text"), F.lower("prior")).mapInArrow(run, schema)


def tone(filings: DataFrame, dictionary: DataFrame, least_words: int = 100) -> DataFrame:
    """Share of each dictionary category among a filing's words, and positive less negative; null for short texts.

    ``dictionary(word, category)`` is a fixed word list and goes to every executor.
    """
    counted = filings.select("ticker", "seq", F.explode(words("text")).alias("word")).groupBy("ticker", "seq", "word").agg(F.count("*").alias("n"))
    hit = counted.join(F.broadcast(dictionary), "word", "left")
    total = counted.groupBy("ticker", "seq").agg(F.sum("n").alias("n_words"))
    names = ("positive", "negative", "uncertainty")
    per = hit.groupBy("ticker", "seq").agg(*[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(f"_{c}") for c in names])
    out = per.join(total, ["ticker", "seq"])
    out = out.select("ticker", "seq", "n_words", *[F.when(F.col("n_words") >= least_words, F.col(f"_{c}") / F.col("n_words")).alias(c) for c in names])
    return out.withColumn("net", F.col("positive") - F.col("negative"))


#: A header of a section, its number and letter in the first group.
ITEM_HEADER = r"(?i)\bitem\s+(\d+[a-z]?)\b[.:\s]"


def item_order(item: Column) -> Column:
    """Number and letter of an item, in their order; 999 if it is none."""
    return F.struct(F.coalesce(F.regexp_extract(item, r"^(\d+)", 1).try_cast("int"), F.lit(999)).alias("number"), F.regexp_extract(item, r"^\d+([A-Z]?)", 1).alias("letter"))


def extract_items(filings: DataFrame, wanted: list[str], text: str = "text", header: str = ITEM_HEADER) -> DataFrame:
    """``filings`` with a column ``item_x`` per wanted item: its section of a plain text, from its last header up to the next header of a higher item.

    Contents lists come before the sections they name, so the last header counts. A header of a lower item in between
    is part of the section. Sections are trimmed at both ends and never cut; an item without a header, and a null or
    empty text, gives the empty text. The header's own letters may be in either case. The text is cut at its headers
    once, and sections are put together again from the pieces.
    """
    mark = "\u0001"
    pieces = F.split(F.regexp_replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(mark), F.lit(" ")), header, mark + "$0"), mark)
    b = filings.withColumn("_pieces", pieces)
    b = b.withColumn("_items", F.transform("_pieces", lambda p, k: F.when(k > 0, F.upper(F.regexp_extract(p, header, 1))).otherwise("")))
    for x in wanted:
        here = F.lit(x.upper())
        at = F.array_max(F.transform("_items", lambda i, k: F.when(i == here, k)))  # noqa: B023
        b = b.withColumn("_at", at)
        stop = F.array_min(F.transform("_items", lambda i, k: F.when((k > F.col("_at")) & (item_order(i) > item_order(here)), k)))  # noqa: B023
        b = b.withColumn("_stop", F.coalesce(stop, F.size("_pieces")))
        section = F.trim(F.array_join(F.slice("_pieces", F.col("_at") + 1, F.col("_stop") - F.col("_at")), ""))
        b = b.withColumn(f"item_{x.lower()}", F.when(F.col("_at").isNull(), "").otherwise(section))
    return b.drop("_pieces", "_items", "_at", "_stop")

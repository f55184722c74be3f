"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import materialise


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of that node's neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(u, v)``, of any order and with repeats, to ``(u, root)``: every node but the roots, with its component's least node.

    Each round is two joins on node ids and is written to the shared folder, so that a lost executor costs a
    round at most and the plan stays short. Rounds grow with the logarithm of the longest chain. No node's
    neighbours are ever gathered in one row.
    """
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = materialise(now, "links")
    before = _state(now)
    while before[0]:
        now = materialise(_small_star(_large_star(now)), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))

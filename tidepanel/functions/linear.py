"""Least squares by group: moments by aggregation, and an exact small solver in the plan."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A factor whose variance, less what the factors before it explain, is under this share of it counts as collinear.
COLLINEAR = 1e-10


def moments(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Number, means ``_m_c`` and population covariances ``_v_a_b`` (a before b in ``columns``) of each group, in one aggregation.

    Rows with a null or NaN in any of the columns are left out. Covariances are merged from partial means and
    products, so large levels cost no digits.
    """
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    pairs = combinations_with_replacement(columns, 2)
    return rows.filter(ok).groupBy(*by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"_v_{a}_{b}") for a, b in pairs])


def with_slopes(groups: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """``moments`` of ``[*xs, y]`` with ``_b_x``, the slope of y on each x beside the others, and ``_b_`` for the level.

    The covariances are decomposed into a unit triangle and pivots, a step per factor, so the plan grows with the square
    of their number and no group leaves its row. A factor that those before it explain has slope 0, and the fit is the
    same as that of any least-squares solution. A group without rows has none.
    """
    k = len(xs)
    g = groups
    a = lambda i, j: F.col(f"_v_{xs[min(i, j)]}_{xs[max(i, j)]}")
    l = lambda i, j: F.col(f"_l_{i}_{j}")  # noqa: E731,E741
    d = lambda i: F.col(f"_d_{i}")
    for j in range(k):
        pivot = a(j, j)
        for m in range(j):
            pivot = pivot - l(j, m) * l(j, m) * d(m)
        g = g.select("*", F.when(pivot > COLLINEAR * a(j, j), pivot).alias(f"_d_{j}"))
        below = []
        for i in range(j + 1, k):
            x = a(i, j)
            for m in range(j):
                x = x - l(i, m) * l(j, m) * F.coalesce(d(m), F.lit(0.0))
            below.append(F.coalesce(x / d(j), F.lit(0.0)).alias(f"_l_{i}_{j}"))
        z = F.col(f"_v_{xs[j]}_{y}")
        for m in range(j):
            z = z - l(j, m) * F.col(f"_z_{m}")
        g = g.select("*", *below, F.when(d(j).isNotNull(), z).otherwise(0.0).alias(f"_z_{j}"), F.coalesce(d(j), F.lit(0.0)).alias(f"_e_{j}")).drop(f"_d_{j}").withColumnRenamed(f"_e_{j}", f"_d_{j}")
    for i in reversed(range(k)):
        b = F.when(d(i) > 0, F.col(f"_z_{i}") / d(i)).otherwise(0.0)
        for m in range(i + 1, k):
            b = b - F.when(d(i) > 0, l(m, i) * F.col(f"_b_{xs[m]}")).otherwise(0.0)
        g = g.select("*", b.alias(f"_b_{xs[i]}"))
    level = F.col(f"_m_{y}")
    for x in xs:
        level = level - F.col(f"_b_{x}") * F.col(f"_m_{x}")
    spare = [c for c in g.columns if c[:3] in ("_l_", "_z_", "_d_")]
    return g.select("*", level.alias("_b_")).drop(*spare)


def fitted(xs: list[str]):
    """The fit of a row joined to its group's slopes."""
    out = F.col("_b_")
    for x in xs:
        out = out + F.col(f"_b_{x}") * F.col(x)
    return out

"""Rolling sums, exponential means and rolling quantiles whose work per row does not grow with the window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidepanel.functions.columns import by_ticker


def running_total(x: np.ndarray, window: int) -> np.ndarray:
    """Sums of the last ``window`` rows of a table of values, by column.

    Rows are cut into blocks of ``window``. A frame that ends inside a block is the end of the block before and the
    start of this one, and both are running sums. Nothing is subtracted, so no digits are lost.
    """
    n, k = x.shape
    if not n:
        return x
    blocks = np.zeros((-(-n // window), window, k))
    blocks.reshape(-1, k)[:n] = x
    out = np.cumsum(blocks, axis=1).reshape(-1, k)[:n]
    ends = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1, k)
    inside = np.flatnonzero(np.arange(n) % window != window - 1)
    inside = inside[inside >= window]
    out[inside] += ends[inside - window + 1]
    return out


def with_rolling_sums(panel: DataFrame, sums: dict[str, Column], window: int) -> DataFrame:
    """``panel`` with the sum of each expression over the ticker's last ``window`` rows, nulls as zero.

    A row costs the same whatever the window (``running_total``). The panel is shuffled and sorted by ticker once, and
    a task holds one ticker's rows at a time; of repeated dates the order is any one.
    """
    held = {n: f"_x_{n}" for n in sums}
    b = panel.select("*", *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(held[n]) for n, x in sums.items()])

    def work(t: pa.Table) -> list[np.ndarray]:
        return list(running_total(np.column_stack([t.column(c).to_numpy() for c in held.values()]), window).T)

    kept = [c for c in panel.columns if c not in sums]
    return per_ticker(b, list(sums), work, list(held.values()), kept, missing=False).select(*kept, *sums)


def per_ticker(panel: DataFrame, names: list[str], work: Callable[[pa.Table], list[np.ndarray]], needs: list[str], kept: list[str] | None = None, missing: bool = True) -> DataFrame:
    """``panel`` with new double columns that ``work`` computes from a ticker's rows in date order; of the others those in ``kept``.

    A task holds one ticker's rows, one a date; with ``missing``, NaN in a result becomes null. A panel that is dealt
    by ticker already is not shuffled again.
    """
    return _per_group(panel, "ticker", "date", names, work, needs, kept, missing)


def _per_group(panel: DataFrame, key: str, order: str | None, names: list[str], work: Callable[[pa.Table], list[np.ndarray]], needs: list[str], kept: list[str] | None = None, missing: bool = True) -> DataFrame:
    kept = [c for c in panel.columns if c not in names] if kept is None else kept
    schema = StructType([panel.schema[c] for c in kept])
    for n in names:
        schema = schema.add(n, DoubleType())

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(order) if order else t
        found = work(t.select(needs))
        t = t.select(kept)
        for n, x in zip(names, found, strict=True):
            t = t.append_column(n, pa.array(x, pa.float64(), from_pandas=missing))
        return t

    return panel.select(*dict.fromkeys([key, *([order] if order else []), *kept, *needs])).groupBy(key).applyInArrow(run, schema)


def ranks(x: pa.ChunkedArray) -> np.ndarray:
    """Ranks of the non-null values over their number, ties averaged; null as NaN, and NaN ranks as the largest value."""
    known = x.is_valid().to_numpy()
    out = np.full(len(known), np.nan)
    _, place, counts = np.unique(x.drop_null().cast(pa.float64()).to_numpy(), return_inverse=True, return_counts=True, equal_nan=True)
    last = np.cumsum(counts)
    out[known] = ((last - counts + 1 + last) / 2 / known.sum())[place] if known.any() else 0.0
    return out


def with_ranks(panel: DataFrame, columns: dict[str, str], by: str = "date", kept: list[str] | None = None) -> DataFrame:
    """``panel`` with the rank on its date of each column, as ``columns.rank_pct`` gives it: new name to column.

    Any number of ranks takes one shuffle and one sort by date, and a task holds one date's rows at a time. Windows
    would sort the rows twice for each rank, and a task would hold all those copies.
    """
    names = list(columns)
    return _per_group(panel, by, None, names, lambda t: [ranks(t.column(c)) for c in columns.values()], sorted(set(columns.values())), kept)


def values(t: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return t.column(name).cast(pa.float64()).to_numpy()


def rolling(x: np.ndarray, window: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance of the values in the last ``window`` rows, NaN with fewer than ``least`` (default window // 2) of them.

    Squares are of the distances from the mean of all values, and a frame of equal values has a variance of zero.
    """
    known = ~np.isnan(x)
    centre = x[known].mean() if known.any() else 0.0
    d = np.where(known, x - centre, 0.0)
    at = np.flatnonzero(known)
    moved = np.zeros(len(x))
    moved[at[1:]] = x[at[1:]] != x[at[:-1]]
    sums = running_total(np.column_stack([known, np.where(known, x, 0.0), d, d * d]), window)
    n = sums[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = sums[:, 1] / n
        var = np.maximum(sums[:, 3] - sums[:, 2] ** 2 / n, 0.0) / (n - 1)
    # the last change lies before the frame's first value: all its values are equal
    change = np.maximum.accumulate(np.where(moved > 0, np.arange(len(x)), -1)) if len(x) else at
    first = np.searchsorted(at, np.arange(len(x)) - window + 1)
    start = at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else np.zeros(len(x), int)
    var[(change <= start) & (n > 1)] = 0.0
    few = n < (window // 2 if least is None else least)
    mean[few | (n == 0)] = np.nan
    var[few | (n < 2)] = np.nan
    return mean, var


def rolling_slope(y: np.ndarray, x: np.ndarray, window: int, least: int = 2) -> np.ndarray:
    """Slope of y on x over the last ``window`` rows, those with both values; NaN with fewer than ``least`` of them or where x is constant."""
    both = ~np.isnan(x) & ~np.isnan(y)
    if not both.any():
        return np.full(len(x), np.nan)
    dx, dy = (np.where(both, v - v[both].mean(), 0.0) for v in (x, y))
    n, sx, sy, sxy = running_total(np.column_stack([both, dx, dy, dx * dy]), window).T
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = (sxy - sx * sy / n) / (n - 1)
    return np.where(n >= least, ratio(cov, rolling(np.where(both, x, np.nan), window, 2)[1]), np.nan)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def running_mean(x: np.ndarray, alpha: float, adjust: bool) -> np.ndarray:
    """Exponential mean of the values up to each row; missing ones have none and don't age the others.

    Unadjusted, it starts at the first value; adjusted, the weights of all values so far sum to one.
    """
    out, keep = np.full(len(x), np.nan), 1 - alpha
    total = weight = 0.0
    begun = False
    for k, v in enumerate(x.tolist()):
        if v != v:
            continue
        if adjust:
            total, weight = total * keep + v, weight * keep + 1
            out[k] = total / weight
        else:
            total = total * keep + v * alpha if begun else v
            begun = True
            out[k] = total
    return out


def with_ewm(panel: DataFrame, specs: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """``panel`` with exponential means: new name to column, alpha and whether weights are adjusted. One value is carried from row to row."""
    names = list(specs)
    return per_ticker(panel, names, lambda t: [running_mean(values(t, c), a, adj) for c, a, adj in specs.values()], sorted({c for c, _, _ in specs.values()}))


def sliding_quantile(x: np.ndarray, window: int, q: float, least: int) -> np.ndarray:
    """Interpolated quantile of the values in the last ``window`` rows, from ``least`` values on; a sorted buffer takes one in and lets one out per row."""
    out = np.full(len(x), np.nan)
    buffer: list[float] = []
    recent: deque[float] = deque()
    for k, v in enumerate(x.tolist()):
        recent.append(v)
        if v == v:
            insort(buffer, v)
        if len(recent) > window and (old := recent.popleft()) == old:
            del buffer[bisect_left(buffer, old)]
        n = len(buffer)
        if n >= least and n:
            at = q * (n - 1)
            low = int(at)
            high = min(low + 1, n - 1)
            out[k] = buffer[low] + (at - low) * (buffer[high] - buffer[low])
    return out


def with_quantiles(panel: DataFrame, specs: dict[str, tuple[str, int, float, int]]) -> DataFrame:
    """``panel`` with sliding quantiles: new name to column, window, quantile and least number of values."""
    names = list(specs)
    return per_ticker(panel, names, lambda t: [sliding_quantile(values(t, c), w, q, least) for c, w, q, least in specs.values()], sorted({c for c, _, _, _ in specs.values()}))


def sliding_rank(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """Rank of each value among those in the last ``window`` rows, ties averaged, over their number, from ``least`` values on; a missing value has none."""
    out = np.full(len(x), np.nan)
    buffer: list[float] = []
    recent: deque[float] = deque()
    for k, v in enumerate(x.tolist()):
        recent.append(v)
        if v == v:
            insort(buffer, v)
        if len(recent) > window and (old := recent.popleft()) == old:
            del buffer[bisect_left(buffer, old)]
        if v == v and len(buffer) >= least:
            out[k] = (bisect_left(buffer, v) + bisect_right(buffer, v) + 1) / 2 / len(buffer)
    return out


def with_sliding_ranks(panel: DataFrame, specs: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``panel`` with sliding ranks: new name to column, window and least number of values."""
    return per_ticker(panel, list(specs), lambda t: [sliding_rank(values(t, c), w, least) for c, w, least in specs.values()], sorted({c for c, _, _ in specs.values()}))

"""DuckDB SQL fragments for the checks of panel queries."""

from __future__ import annotations

ORDER = "PARTITION BY ticker ORDER BY date"
BARS = """items AS (SELECT l_suppkey AS ticker, CAST({date} AS DATE) AS date, l_quantity AS q, l_extendedprice AS p, l_extendedprice / nullif(l_quantity, 0) AS u FROM lineitem),
bars0 AS (SELECT ticker, date, max(u) AS high, min(u) AS low, sum(p) / nullif(sum(q), 0) AS close, sum(q) AS volume FROM items GROUP BY ticker, date),
bars AS (SELECT *, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(-1, least(1, close / lag(close) OVER w - 1)) END AS ret FROM bars0 WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
DAILY, MONTHLY = BARS.format(date="l_shipdate"), BARS.format(date="date_trunc('month', l_shipdate)")
SECTORS = "sectors AS (SELECT s_suppkey AS ticker, r_name AS sector, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({ORDER})" if n >= 0 else f"lead({x}, {-n}) OVER ({ORDER})"


def roll(call: str, x: str, n: int, least: int | None = None) -> str:
    """``call`` with ``{}`` for x over the last n rows, null with fewer than least (n // 2) values."""
    frame = f"OVER ({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} >= {n // 2 if least is None else least} THEN {call.format(x)} {frame} END)"


def avg(x: str, n: int, least: int | None = None) -> str:
    return roll("avg({})", x, n, least)


def std(x: str, n: int, least: int | None = None) -> str:
    return roll("stddev_samp({})", x, n, least)


def total(x: str, n: int, least: int | None = None) -> str:
    return roll("sum({})", x, n, least)


def var(x: str, n: int, least: int | None = None) -> str:
    return roll("var_samp({})", x, n, least)


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def momentum(x: str, n: int, skip: int = 1) -> str:
    return f"({div(lag(x, skip), lag(x, skip + n))} - 1)"


def rank_pct(x: str, by: str = "date") -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)"


def zscore(x: str, bound: float | None = 4.0, by: str = "date") -> str:
    z = div(f"{x} - avg({x}) OVER (PARTITION BY {by})", f"stddev_samp({x}) OVER (PARTITION BY {by})")
    return z if bound is None else f"(CASE WHEN {z} IS NOT NULL THEN greatest({-bound}, least({bound}, {z})) END)"


def clip(x: str, low: float, high: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({low}, least({high}, {x})) END)"


def ewm(x: str, alpha: float, adjust: bool) -> str:
    """Closed form over the history; needs the row number rn and rn0, that of the first value."""
    keep, hist = 1 - alpha, f"OVER ({ORDER} ROWS UNBOUNDED PRECEDING)"
    if adjust:
        return f"(CASE WHEN {x} IS NOT NULL THEN sum({x} * pow({keep!r}, -rn)) {hist} / sum(CASE WHEN {x} IS NOT NULL THEN pow({keep!r}, -rn) END) {hist} END)"
    return f"(CASE WHEN {x} IS NOT NULL THEN pow({keep!r}, rn) * sum({x} * CASE WHEN rn = rn0 THEN 1 ELSE {alpha!r} END * pow({keep!r}, -rn)) {hist} END)"


def query(*steps: dict[str, str] | str, value: str | None = "value", base: str = DAILY, keys: str = "ticker, date", final: str = "", extra: str = "", source: str = "bars") -> str:
    """Columns added step by step to the bars, then the keys and the rounded value."""
    ctes, at = [base, *([extra] if extra else [])], source
    for k, step in enumerate(steps):
        if isinstance(step, str):
            ctes.append(f"s{k} AS ({step.format(at=at)})")
        else:
            ctes.append(f"s{k} AS (SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in step.items()) + f" FROM {at})")
        at = f"s{k}"
    return f"WITH {', '.join(ctes)} " + (final.format(at=at) if final else f"SELECT {keys}, {rounded(value)} FROM {at}")


def rounded(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names)

"""Queries over tax lots, and SQL that walks each account's fills one by one for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import lots as L
from tidepanel.plans.cross import FILLS, rounded
from tidepanel.sources import tables

KEYS = ["account", "ticker"]


def trades(s: SparkSession, d: str) -> DataFrame:
    """Fills in five tickers; an hour of the event table stands for a day, so that lots grow older than a year."""
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1_704_067_200) / 3600).cast("int")
    return tables.fills(s, d).select("account", (F.col("order_id") % 5).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), day).alias("date"), "fill_id", "side", "qty", "price")


def last_prices(t: DataFrame) -> DataFrame:
    return t.filter("price > 0").groupBy("ticker").agg(F.max_by("price", "fill_id").alias("price"))


def as_of():
    return F.lit("2021-12-31").cast("date")


STATE = f"""WITH RECURSIVE {FILLS},
t AS (SELECT account, order_id % 5 AS ticker, DATE '2020-01-01' + CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS INT) AS date, fill_id, side, qty, price FROM fills WHERE qty > 0 AND price > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY account, ticker ORDER BY date, fill_id) AS rn FROM t),
walk AS (
    SELECT DISTINCT account, ticker, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(i BIGINT, d DATE, c DOUBLE, s DOUBLE)[]) AS open, CAST([] AS STRUCT(k BIGINT, i BIGINT, d DATE, c DOUBLE, s DOUBLE, take DOUBLE)[]) AS took FROM o
    UNION ALL
    SELECT account, ticker, rn, CASE side WHEN 'BUY' THEN list_append(open, {{'i': fill_id, 'd': date, 'c': price, 's': qty}})
        ELSE list_transform(list_filter(list_sort(took), lambda x: x.s - x.take >= 1e-8), lambda x: {{'i': x.i, 'd': x.d, 'c': x.c, 's': x.s - x.take}}) END AS open, took
    FROM (SELECT account, ticker, rn, side, fill_id, date, price, qty, open, CASE side WHEN 'SELL' THEN list_transform(ranked, lambda x, j: {{'k': x.k, 'i': x.i, 'd': x.d, 'c': x.c, 's': x.s,
            'take': CASE WHEN qty - coalesce(list_sum(list_transform(ranked[1:j - 1], lambda y: y.s)), 0) > 1e-8 THEN least(x.s, qty - coalesce(list_sum(list_transform(ranked[1:j - 1], lambda y: y.s)), 0)) ELSE 0 END}}) ELSE [] END AS took
        FROM (SELECT o.*, w.open, list_sort(list_transform(w.open, lambda x, k: {{'tax': (o.price - x.c) * x.s * CASE WHEN o.date - x.d > 365 THEN 0.188 ELSE 0.328 END, 'k': k, 'i': x.i, 'd': x.d, 'c': x.c, 's': x.s}})) AS ranked
            FROM walk w JOIN o ON o.account = w.account AND o.ticker = w.ticker AND o.rn = w.rn + 1))
),
hits AS (SELECT w.account, w.ticker, o.fill_id AS sale_id, o.date AS sold, o.price, unnest(w.took) AS l FROM walk w JOIN o USING (account, ticker, rn) WHERE o.side = 'SELL'),
sold AS (SELECT account, ticker, sale_id, sold, sum(l.take) AS qty, count(*) AS lots, coalesce(sum(CASE WHEN sold - l.d <= 365 THEN (price - l.c) * l.take END), 0) AS short_gain, coalesce(sum(CASE WHEN sold - l.d > 365 THEN (price - l.c) * l.take END), 0) AS long_gain
    FROM hits WHERE l.take > 0 GROUP BY ALL),
sales AS (SELECT *, short_gain + long_gain AS gain, CASE WHEN short_gain + long_gain < 0 THEN sold + 31 END AS barred_until FROM sold),
now AS (SELECT ticker, max_by(price, fill_id) AS price FROM t GROUP BY 1),
left_open AS (SELECT account, ticker, l.i AS lot_id, l.d AS bought, l.c AS cost, l.s AS qty FROM (SELECT account, ticker, unnest(max_by(open, rn)) AS l FROM walk GROUP BY 1, 2)),
priced AS (SELECT *, DATE '2021-12-31' - bought AS held, (price - cost) * qty AS gain FROM left_open JOIN now USING (ticker)),
barred AS (SELECT account, ticker, max_by(barred_until, (sold, sale_id)) > DATE '2021-12-31' AS barred FROM sales WHERE gain < 0 GROUP BY 1, 2),
positions AS (SELECT account, ticker, sum(qty) AS shares, sum(qty * p.cost) AS cost, sum(qty * price) AS value, sum(gain) AS gain, bool_or(held <= 365 AND gain < 0) AS has_short_loss, least(999, min(365 - held)) AS days_to_long,
    count(*) FILTER (held <= 365) AS short_lots, count(*) FILTER (held > 365) AS long_lots, coalesce(any_value(barred), false) AS barred FROM priced p LEFT JOIN barred USING (account, ticker) GROUP BY 1, 2),
harvest AS (SELECT account, ticker, gain, -gain * 0.328 AS benefit, row_number() OVER (PARTITION BY account ORDER BY -gain * 0.328 DESC, ticker) AS place FROM positions WHERE NOT barred AND gain < 0 AND -gain >= 50 AND -gain / cost >= 0.02)"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in names)


def _matches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = trades(s, d)
    return L.match_lots(t), last_prices(t)


def g8(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.realised_by_day(_matches(s, d)[0]), ["account", "date"], ["pnl", "total"], 4)


def g10(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.sales(_matches(s, d)[0]), [*KEYS, "sale_id", "sold", "lots", "barred_until"], ["qty", "short_gain", "long_gain"], 4)


def g11(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.positions(*_matches(s, d), as_of()), [*KEYS, "has_short_loss", "days_to_long", "short_lots", "long_lots", "barred"], ["shares", "cost", "value", "gain"], 4)


def g13(s: SparkSession, d: str) -> DataFrame:
    return rounded(L.harvest(L.positions(*_matches(s, d), as_of()), 50.0), [*KEYS, "place"], ["gain", "benefit"], 4)


def g15(s: SparkSession, d: str) -> DataFrame:
    t = trades(s, d)
    money = F.col("qty") * F.col("price")
    capital = t.groupBy("account").agg((F.sum(money) * 2).alias("start"), (F.sum(money) * 2 + F.sum(F.when(F.col("side") == "SELL", money).otherwise(0.0))).alias("final"), F.lit(2.0).alias("years"))
    return rounded(L.after_tax(L.match_lots(t), capital), ["account", "n_sales"], ["short_gain", "long_gain", "tax", "growth", "growth_after", "tax_rate", "short_share", "long_share"], 4)


def g16(s: SparkSession, d: str) -> DataFrame:
    out = L.tax_position(*_matches(s, d), as_of(), least=50.0)
    return rounded(out, ["account", "positions", "lots", "long_lots", "to_harvest", "barred_held"], ["value", "cost", "gain", "gain_share", "long_share", "year_short_gain", "year_long_gain", "benefit"], 4)


def g20(s: SparkSession, d: str) -> DataFrame:
    m, now = _matches(s, d)
    held = L.positions(m, now, as_of())
    whole = held.groupBy("account").agg(F.sum("value").alias("v"), F.sum(F.col("ticker") + 1).alias("k"))
    book = held.join(whole, "account").select(*KEYS, (F.col("value") / F.col("v")).alias("current"), ((F.col("ticker") + 1) / F.col("k")).alias("target"))
    return rounded(L.tax_aware_weights(book, m, now, as_of()), KEYS, ["current", "target", "weight"])


TABLE = {
    "G8_realized_pnl": (g8, f"{STATE}, g AS (SELECT account, sold AS date, sum(gain) AS pnl FROM sales GROUP BY 1, 2) SELECT account, date, round(pnl, 4) + 0.0 AS pnl, round(sum(pnl) OVER (PARTITION BY account ORDER BY date), 4) + 0.0 AS total FROM g"),
    "G10_lot_sales": (g10, f"{STATE} SELECT account, ticker, sale_id, sold, lots, barred_until, {_r('qty', 'short_gain', 'long_gain')} FROM sales"),
    "G11_open_positions": (g11, f"{STATE} SELECT account, ticker, has_short_loss, days_to_long, short_lots, long_lots, barred, {_r('shares', 'cost', 'value', 'gain')} FROM positions"),
    "G13_harvest": (g13, f"{STATE} SELECT account, ticker, place, {_r('gain', 'benefit')} FROM harvest"),
    "G15_after_tax": (
        g15,
        f"""{STATE}, c AS (SELECT account, 2 * sum(qty * price) AS a, 2 * sum(qty * price) + coalesce(sum(qty * price) FILTER (side = 'SELL'), 0) AS z FROM t GROUP BY 1),
g AS (SELECT account, a, z, coalesce(sum(short_gain), 0) AS short_gain, coalesce(sum(long_gain), 0) AS long_gain, count(sale_id) AS n_sales FROM c LEFT JOIN sales USING (account) GROUP BY ALL),
x AS (SELECT *, short_gain + long_gain AS realised, 0.328 * greatest(0, short_gain + CASE WHEN long_gain < 0 AND short_gain > 0 THEN long_gain ELSE 0 END) + 0.188 * greatest(0, long_gain + CASE WHEN short_gain < 0 AND long_gain > 0 THEN short_gain ELSE 0 END) AS tax FROM g),
y AS (SELECT *, CASE WHEN z - tax > 0 THEN sqrt(z / a) - 1 ELSE 0 END AS growth, CASE WHEN z - tax > 0 THEN sqrt((z - tax) / a) - 1 ELSE 0 END AS growth_after FROM x),
w AS (SELECT *, CASE WHEN growth > 0 THEN 1 - growth_after / growth ELSE 0 END AS tax_rate, CASE WHEN realised > 0 THEN short_gain / realised ELSE 0 END AS short_share, CASE WHEN realised > 0 THEN long_gain / realised ELSE 0 END AS long_share FROM y)
SELECT account, n_sales, {_r('short_gain', 'long_gain', 'tax', 'growth', 'growth_after', 'tax_rate', 'short_share', 'long_share')} FROM w""",
    ),
    "G16_tax_position": (
        g16,
        f"""{STATE}, who AS (SELECT account FROM left_open UNION SELECT account FROM sales),
p AS (SELECT account, count(*) AS positions, sum(value) AS value, sum(cost) AS cost, sum(gain) AS gain, count(*) FILTER (barred) AS barred_held FROM positions GROUP BY 1),
n AS (SELECT account, count(*) AS lots, count(*) FILTER (DATE '2021-12-31' - bought > 365) AS long_lots FROM left_open GROUP BY 1),
y AS (SELECT account, sum(short_gain) FILTER (year(sold) = 2021) AS year_short_gain, sum(long_gain) FILTER (year(sold) = 2021) AS year_long_gain FROM sales GROUP BY 1),
h AS (SELECT account, count(*) AS to_harvest, sum(benefit) AS benefit FROM harvest GROUP BY 1),
z AS (SELECT account, coalesce(positions, 0) AS positions, coalesce(lots, 0) AS lots, coalesce(long_lots, 0) AS long_lots, coalesce(to_harvest, 0) AS to_harvest, coalesce(barred_held, 0) AS barred_held, coalesce(value, 0) AS value, coalesce(cost, 0) AS cost, coalesce(gain, 0) AS gain,
    coalesce(year_short_gain, 0) AS year_short_gain, coalesce(year_long_gain, 0) AS year_long_gain, coalesce(benefit, 0) AS benefit FROM who LEFT JOIN p USING (account) LEFT JOIN n USING (account) LEFT JOIN y USING (account) LEFT JOIN h USING (account)),
q AS (SELECT *, CASE WHEN cost > 0 THEN gain / cost ELSE 0 END AS gain_share, long_lots / greatest(1, lots) AS long_share FROM z)
SELECT account, positions, lots, long_lots, to_harvest, barred_held, {_r('value', 'cost', 'gain', 'gain_share', 'long_share', 'year_short_gain', 'year_long_gain', 'benefit')} FROM q""",
    ),
    "G20_tax_aware_weights": (
        g20,
        f"""{STATE}, w AS (SELECT account, ticker, bool_or(held <= 365 AND held >= 305 AND held < 365 AND gain > 0 AND gain * (0.328 - 0.188) > qty * price * 0.0002 * (365 - held)) AS wait FROM priced GROUP BY 1, 2),
b AS (SELECT account, ticker, value / sum(value) OVER (PARTITION BY account) AS current, (ticker + 1) / sum(ticker + 1) OVER (PARTITION BY account) AS target, barred, wait FROM positions JOIN w USING (account, ticker)),
k AS (SELECT *, CASE WHEN wait AND current > 0 AND (CASE WHEN barred THEN 0 ELSE target END) < current THEN current WHEN barred THEN 0 ELSE target END AS v FROM b),
z AS (SELECT *, coalesce(v / nullif(sum(v) OVER (PARTITION BY account), 0), v) AS weight FROM k)
SELECT account, ticker, round(current, 6) + 0.0 AS current, round(target, 6) + 0.0 AS target, round(weight, 6) + 0.0 AS weight FROM z""",
    ),
}

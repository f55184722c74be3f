"""Readers of landed files on small files."""

from __future__ import annotations

import datetime as dt
import json

from tidepanel.sources import landed

D = dt.date


def test_macro_series_is_carried_and_shown_a_day_later(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,VALUE\n2024-01-01,1.5\n2024-01-02,.\n2024-01-03,2.5\n")
    calendar = spark.createDataFrame([(D(2024, 1, k),) for k in range(1, 6)], "date date")
    got = landed.macro_series(spark, str(tmp_path / "s.csv"), calendar).orderBy("date").collect()
    assert [r["value"] for r in got] == [None, 1.5, 1.5, 2.5, 2.5]


def test_short_interest_publication(spark, tmp_path):
    (tmp_path / "f.txt").write_text("settlement_date|symbol|shares_short|days_to_cover|avg_daily_vol|exchange\n20240115| abc |10|1|10|N\n20240115|X||1|1|N\n")
    (row,) = landed.short_interest(spark, str(tmp_path / "f.txt")).collect()
    assert (row["symbol"], row["settlement_date"], row["publication_date"]) == ("ABC", D(2024, 1, 15), D(2024, 1, 25))


def test_factor_returns_skip_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Some text\n,Mkt,SMB\n20240102,  1.00, -0.50\nCopyright\n")
    (row,) = landed.factor_returns(spark, str(tmp_path / "f.csv"), ["mkt", "smb"]).collect()
    assert (row["date"], row["mkt"], row["smb"]) == (D(2024, 1, 2), 0.01, -0.005)


def test_snapshots_by_name(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        spark.createDataFrame([(day,)], "x string").toPandas().to_parquet(tmp_path / f"{day}.parquet")
    got = landed.snapshots(spark, str(tmp_path), "2024-01-02", "2024-01-03").collect()
    assert sorted(r["x"] for r in got) == ["2024-01-02", "2024-01-03"]


def test_company_facts_take_the_first_reported_alias(spark, tmp_path):
    e = lambda filed, val, form="10-K": {"form": form, "filed": filed, "val": val}
    facts = {"us-gaap": {"New": {"units": {"EUR": [e("2020-02-01", 9.0)], "USD": [e("2021-02-01", 1.0), e("2021-02-01", 2.0), e("2021-05-01", 3.0, "10-Q")]}}, "Old": {"units": {"USD": [e("2019-02-01", 7.0)]}}}}
    (tmp_path / "c.json").write_text(json.dumps({"cik": "1", "facts": facts}) + "\n")
    got = landed.company_facts(spark, str(tmp_path / "c.json"), ["New", "Old"]).collect()
    assert [(r["filed"], r["value"]) for r in got] == [(D(2021, 2, 1), 2.0)]

"""Folders of wide price files."""

import logging

import pandas as pd
import pytest
from helpers import date
from pyspark.sql import functions as F

from quantloom.sources import wide
from quantloom.sources.prices import CachedSource, PriceSource, long_prices, select_source
from quantloom.sources.wide import FolderSource, WidePricesReader, inspect, price_columns, two_levels

DAYS = pd.bdate_range("2024-01-01", periods=6)


def flat(path, **columns):
    df = pd.DataFrame({"Date": DAYS, **columns})
    df.to_parquet(path) if str(path).endswith("parquet") else df.to_csv(path, index=False)


@pytest.fixture
def folder(tmp_path):
    flat(tmp_path / "a.parquet", AAA=[1.0, 2, None, 4, 5, 6], BBB=[10.0] * 6)
    flat(tmp_path / "b.csv", CCC=[7.0, float("inf"), 7, 7, 7, 7])
    two = pd.DataFrame([[1.5, 2.5, 100.0, 200.0]] * 6, index=pd.Index(DAYS, name="Date"), columns=pd.MultiIndex.from_tuples([("Close", "DDD"), ("Close", "EEE"), ("Volume", "DDD"), ("Volume", "EEE")]))
    two.to_csv(tmp_path / "c.csv")
    swapped = two.swaplevel(axis=1).rename(columns={"DDD": "FFF", "EEE": "GGG"})
    swapped.columns = [str(c) for c in swapped.columns]
    swapped.reset_index().to_parquet(tmp_path / "d.parquet")
    (tmp_path / "_hidden.csv").write_text("x")
    return tmp_path


def rows(df):
    return sorted(((str(r["dt"]), r["asset"], r["px"]) for r in df.collect()), key=str)


def test_flat_and_two_level_files(spark, folder):
    src = FolderSource(spark, str(folder), block=2)
    assert isinstance(src, PriceSource)
    got = rows(src.prices(["AAA", "CCC", "DDD", "GGG", "ZZZ"], "2024-01-02", "2024-01-04"))
    day = ["2024-01-02", "2024-01-03", "2024-01-04"]
    want = [(day[0], "AAA", 2.0), (day[1], "AAA", None), (day[2], "AAA", 4.0), (day[0], "CCC", None), (day[1], "CCC", 7.0), (day[2], "CCC", 7.0)]
    want += [(d, t, 1.5 if t == "DDD" else 2.5) for d in day for t in ("DDD", "GGG")]
    assert got == sorted(want, key=str)
    everything = spark.read.format("wide_prices").load(str(folder))
    assert everything.select("asset").distinct().count() == 7 and everything.count() == 7 * 6
    assert spark.read.format("wide_prices").option("field", "Volume").option("tickers", "DDD,FFF").load(str(folder)).agg(F.sum("px")).first()[0] == 1200.0


def test_filters_reach_the_reader(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    r = WidePricesReader({"path": str(folder), "block": "1"})
    left = list(r.pushFilters([In(("asset",), ("AAA", "CCC", "QQQ")), GreaterThan(("dt",), date("2024-01-02")), LessThanOrEqual(("dt",), date("2024-01-04")), IsNotNull(("dt",)), EqualTo(("px",), 1.0)]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    assert (r.tickers, r.low, r.high) == ({"AAA", "CCC", "QQQ"}, date("2024-01-03"), date("2024-01-04"))
    parts = r.partitions()
    assert [p.tickers for p in parts] == [("AAA",), ("CCC",)] and [len(p.files) for p in parts] == [1, 1]
    # each partition reads its own columns only
    assert wide.read_file(parts[0].files[0], parts[0].tickers).column_names == ["dt", "AAA"]
    # what the reader answers for is no filter of Spark's plan any more
    plan = FolderSource(spark, str(folder)).prices(["AAA", "BBB"], "2024-01-02", "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan wide_prices" in plan and "isnotnull(dt" in plan and "AAA" not in plan and "<=" not in plan


def test_a_failing_partition_is_empty_with_a_warning(spark, folder, caplog):
    r = WidePricesReader({"path": str(folder), "block": "1"})
    parts = r.partitions()
    (folder / "a.parquet").write_bytes(b"PAR1 broken")
    with caplog.at_level(logging.WARNING):
        assert list(r.read(parts[0])) == []
    assert "no prices of AAA" in caplog.text
    assert sum(b.num_rows for b in r.read(parts[2])) == 6
    # a file that was broken from the start is left out
    assert {x["asset"] for x in FolderSource(spark, str(folder)).prices(["AAA", "DDD"], "2024-01-01", "2024-12-31").collect()} == {"DDD"}


def test_levels_and_dates(tmp_path):
    assert two_levels("('Close', 'A')") == ("Close", "A") and two_levels("A") is None and two_levels("(broken") is None
    assert price_columns(["Date", "A", "B"], "Close") == {"Date": 0, "A": 1, "B": 2}
    assert price_columns([("A", "Close"), ("A", "Open")], "Close") == {"A": 0}
    (tmp_path / "x.csv").write_text("Date,A\n2024-01-02 00:00:00-05:00,1\nnot a date,2\n2024-01-03,3\n")
    got = wide.read_file(inspect(str(tmp_path / "x.csv"), "Close"), ["A"]).to_pydict()
    assert got == {"dt": [date("2024-01-02"), None, date("2024-01-03")], "A": [1.0, 2.0, 3.0]}
    pd.DataFrame({"Date": DAYS.tz_localize("America/New_York"), "A": 1.0}).to_parquet(tmp_path / "z.parquet")
    assert wide.read_file(inspect(str(tmp_path / "z.parquet"), "Close"), ["A"]).to_pydict()["dt"][0] == date("2024-01-01")


def test_two_level_payload_as_a_table(spark):
    pdf = pd.DataFrame({"dt": ["2024-01-02", "2024-01-03"], "('Close', 'A')": [1.0, float("nan")], "('Open', 'A')": [9.0, 9.0], "('Close', 'B')": [3.0, 4.0]})
    got = rows(long_prices(spark.createDataFrame(pdf), ["A", "B", "C"], "2024-01-03"))
    assert got == [("2024-01-02", "A", 1.0), ("2024-01-02", "B", 3.0), ("2024-01-03", "A", None), ("2024-01-03", "B", 4.0)]

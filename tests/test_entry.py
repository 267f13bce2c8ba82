from pathlib import Path

import pytest
from helpers import TESTDATA, cells, oracle

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not Path(TESTDATA).exists(), reason="no test data here")
PANEL = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["bar", "dt", "rebalance", "turnover", "equity"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PANEL)
def test_query_equals_its_oracle(spark, name):
    tables = {p.stem: str(p) if p.is_file() else f"{p}/*.parquet" for p in Path(TESTDATA).glob("*.parquet")}
    got, want = entry.queries()[name](spark, TESTDATA).toPandas(), oracle(entry.oracle_sql()[name], **tables)
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)

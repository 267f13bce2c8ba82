"""As-of joins against brute force and the oracle."""

import datetime as dt
import random
import re

import pytest
from helpers import TESTDATA, cells, date, oracle
from pyspark.sql import functions as F

from quantloom.operators.asof import asof_join, every_days
from quantloom.plans import registry

LEFT, RIGHT = "k string, at date, n int", "k string, dt date, x double, note string"


def day(i):
    return date("2020-01-01") + dt.timedelta(days=i)


def tables(spark, seed=4):
    rng = random.Random(seed)
    left = [(rng.choice(["a", "b", "c", None]), day(rng.randint(0, 900)) if rng.random() < 0.95 else None, i) for i in range(300)]
    left += [left[0], left[0], ("a", day(-50), 1000), ("only left", day(3), 1001)]
    right = [(rng.choice(["a", "b", "c", "d", None]), day(rng.randint(0, 900)) if rng.random() < 0.95 else None, rng.random() if rng.random() < 0.9 else None, rng.choice(["p", "q", None])) for _ in range(120)]
    right += [("a", day(100), 0.5, "z"), ("a", day(100), 0.5, "y"), ("a", day(100), None, "zz")]
    return left, right


def brute(left, right, exact=True, within=None, how="left"):
    out = []
    low = lambda v: (v is not None, v)  # noqa: E731  nulls first
    for k, at, n in left:
        fits = [r for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and (r[1] <= at if exact else r[1] < at)]
        best = max(fits, key=lambda r: (r[1], low(r[2]), (r[3] is not None, r[3] or "")), default=None)
        if best and within is not None and (at - best[1]).days > within:
            best = None
        if best or how == "left":
            out.append((k, at, n, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("within", [None, 5])
def test_equals_brute_force(spark, how, exact, within):
    left, right = tables(spark)
    l, r = spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(3)
    want = brute(left, right, exact, within, how)
    for bucket in (None, every_days(7), every_days(100_000)):
        got = asof_join(l, r, "at", "dt", ["k"], how, exact, within, bucket)
        assert got.columns == ["k", "at", "n", "dt", "x", "note"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_without_keys_and_over_timestamps(spark):
    left = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS at, 1 AS i UNION ALL SELECT timestamp'2024-03-01 00:00:00', 2 UNION ALL SELECT timestamp'2023-01-01 00:00:00', 3")
    right = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'now' AS v UNION ALL SELECT timestamp'2024-01-01 09:59:59', 'before'")
    got = {r["i"]: r["v"] for r in asof_join(left, right, "at", "ts", bucket=every_days(1)).collect()}
    assert got == {1: "now", 2: "now", 3: None}
    got = {r["i"]: r["v"] for r in asof_join(left, right, "at", "ts", exact=False).collect()}
    assert got == {1: "before", 2: "now", 3: None}


def test_empty_sides_and_clashing_names(spark):
    left, right = tables(spark)
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert asof_join(l.limit(0), r, "at", "dt", ["k"]).count() == 0
    assert asof_join(l, r.limit(0), "at", "dt", ["k"]).where("dt IS NULL AND x IS NULL").count() == len(left)
    with pytest.raises(ValueError, match="'n'"):
        asof_join(l, r.withColumn("n", F.lit(1)), "at", "dt", ["k"])
    with pytest.raises(ValueError, match="how"):
        asof_join(l, r, "at", "dt", ["k"], "outer")


def test_a_long_key_is_cut_and_never_compared_row_by_row(spark):
    ticks = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("v"))
    asks = spark.range(4_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 18_000 + 1800).alias("at"), F.col("id").alias("i"))
    got = asof_join(asks, ticks, "at", "ts", ["k"], bucket=every_days(30))
    assert got.where("v <> i * 5").count() == 0 and got.count() == 4_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\bJoin\b", plan)


def test_order_dates_equal_the_oracle(spark):
    got = registry.QUERIES["asof_join_orders"](spark, TESTDATA).toPandas()
    names = ("lineitem", "orders")
    want = oracle(registry.ORACLE_SQL["asof_join_orders"], **{n: f"{TESTDATA}/{n}.parquet" for n in names})
    assert len(got) > 1000 and cells(got) == cells(want)

"""Carried submissions, growing panels and hold-outs that accrue."""

import datetime as dt
import random

import pytest
from helpers import business_days, date, frame, walk
from pyspark.sql import functions as F

from quantloom.operators.panel import complete_grid, trim_trailing_gaps
from quantloom.plans import live
from quantloom.plans.validate import Holdout, holdout_verdict, strategy_weights
from quantloom.sources.config import Strategy
from quantloom.sources.records import plain as plain_values
from quantloom.streaming.incremental import append_table, event_stream, run_available
from quantloom.streaming.panels import GrowingPanel, HoldoutAccrual
from quantloom.streaming.submissions import decide, in_force, submissions

REQUEST = "book string, ts timestamp, asof date, force boolean, targets map<string,double>"


def requests(n=40, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = date("2024-01-01") + dt.timedelta(days=rng.randint(0, 150))
        out.append((rng.choice("xyz"), dt.datetime(day.year, day.month, day.day, rng.randint(0, 23), i % 60, i % 60), day, rng.choice([False, False, False, True, None]), {"A": i / 100, "B": 0.5}))
    return out


def plain(rows):
    """By a loop over each book's requests in order of time: at most one submission a month, unless forced."""
    out, last = [], {}
    for book, ts, asof, force, targets in sorted(rows, key=lambda r: (r[1], r[0])):
        key = f"{asof:%Y-%m}"
        known = last.get(book)
        submit = force or known is None or key > known[0]
        action = "submit" if submit else "skip" if key == known[0] else "late"
        if submit:
            last[book] = (key, str(asof), targets)
        out.append((book, ts, key, action, *last[book]))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["book"], r["ts"], r["period_key"], r["action"], r["submitted_period"], r["submitted_asof"], r["submitted"]) for r in df.collect()), key=str)


END = [("end", dt.datetime(2030, 1, 1), date("2030-01-01"), False, {})]


def test_submissions_equal_a_loop_whatever_order_they_come_in(spark, tmp_path):
    rows = requests()
    files = [rows[i::4] for i in range(4)]
    for f in files:
        spark.createDataFrame(f, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], REQUEST).schema, max_files=1)
    # requests come up to half a year after others
    run_available(submissions(stream, "monthly", "200 days"), f"{tmp_path}/c", append_table(f"{tmp_path}/out"))
    spark.createDataFrame(END, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_available(submissions(stream, "monthly", "200 days"), f"{tmp_path}/c", append_table(f"{tmp_path}/out"))
    assert found(spark.read.parquet(f"{tmp_path}/out").where("book <> 'end'")) == plain(rows)


def test_a_restart_within_a_period_submits_no_second_time(spark, tmp_path):
    day = lambda d, h=9: dt.datetime(2024, 1, d, h)
    first = [("x", day(3), date("2024-01-03"), False, {"A": 0.5})]
    later = [("x", day(15), date("2024-01-15"), False, {"A": 0.9}), ("x", day(16), date("2024-01-16"), True, {"A": 0.7}), ("x", day(17), date("2024-01-17"), False, {"A": 0.1})]
    schema = spark.createDataFrame([], REQUEST).schema

    def run(rows):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = submissions(event_stream(spark, f"{tmp_path}/in", schema), "monthly")
        run_available(q, f"{tmp_path}/c", append_table(f"{tmp_path}/out"))

    run([*first, ("y", day(4), date("2024-01-04"), False, {"B": 1.0})])
    run(later)
    run([("y", day(30), date("2024-01-30"), False, {"B": 0.2})])
    out = spark.read.parquet(f"{tmp_path}/out")
    assert [r["action"] for r in out.where("book = 'x'").orderBy("ts").collect()] == ["submit", "skip", "submit", "skip"]
    # the held book is compared with what was submitted, not with today's targets
    ref = in_force(out)
    assert sorted(map(tuple, ref.collect())) == [("x", "A", 0.7), ("y", "B", 1.0)]
    held = spark.createDataFrame([("A", 70.0, 700.0)], "symbol string, qty double, market_value double")
    px = spark.createDataFrame([("A", 10.0)], "symbol string, px double")
    s = live.reconcile_summary(live.reconcile(ref.where("book = 'x'"), held, px, 1000.0)).first()
    assert s["l1"] == pytest.approx(0.0) and not s["anomaly"]


def test_decisions_on_one_book():
    day = lambda d: dt.datetime.fromisoformat(f"2024-{d}")
    made, last = decide([(day("02-01"), "2024-02-01", False, "b"), (day("01-05"), "2024-01-05", False, "a"), (day("02-03"), "2024-01-09", False, "c")], None, "monthly")
    assert [m[4] for m in made] == ["submit", "submit", "late"] and last == ("2024-02", "2024-02-01", "b")
    assert decide([], None, "weekly") == ([], None)


def price_rows(seed=6):
    rng = random.Random(seed)
    days = business_days(30)
    rows = [(d, a, None if i > 26 or i in (7, 8) or rng.random() < 0.2 else rng.uniform(1, 9)) for i, d in enumerate(days) for a in "AB"]
    return days, rows


def panel_rows(df):
    return sorted(((r["dt"], r["asset"], r["px"]) for r in df.collect()), key=str)


def test_the_growing_panel_equals_the_trimmed_batch_panel(spark, tmp_path):
    days, rows = price_rows()
    growing = GrowingPanel(spark, f"file://{tmp_path}/panel", late_days=5)
    late = [(days[2], "A", 99.0), (days[0], "B", None), (None, "A", 1.0)]
    batches = [rows[i : i + 9] for i in range(0, len(rows), 9)]
    batches[4] = batches[4] + late
    # one row comes late, but in time
    moved = batches[1].pop()
    batches[2].append(moved)
    seen = []
    for number, b in enumerate(batches):
        df = spark.createDataFrame(b, "dt date, asset string, px double")
        growing(df, number)
        if number in (3, 4):
            growing(df, number)  # repeated after a failure
        seen.append(growing.panel().agg(F.max("dt")).first()[0])
    want = trim_trailing_gaps(complete_grid(spark.createDataFrame(rows, "dt date, asset string, px double"))).select("dt", "asset", "px")
    assert panel_rows(growing.panel()) == panel_rows(want)
    assert panel_rows(growing.late()) == sorted(late, key=str) and growing.n_late() == 3
    assert seen[-1] <= days[26] and seen == sorted(seen)
    # the withheld bars are given out as soon as a later one has a price
    growing(spark.createDataFrame([(days[29] + dt.timedelta(days=1), "A", 1.0)], "dt date, asset string, px double"), len(batches))
    assert {r["dt"] for r in growing.panel().collect()} >= set(days[27:])


def test_the_growing_panel_as_a_stream(spark, tmp_path):
    days, rows = price_rows(9)
    schema = spark.createDataFrame([], "dt date, asset string, px double").schema
    for i in range(0, len(rows), 15):
        spark.createDataFrame(rows[i : i + 15], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_available(event_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/c", GrowingPanel(spark, f"{tmp_path}/panel"))
    want = trim_trailing_gaps(complete_grid(spark.createDataFrame(rows, schema))).select("dt", "asset", "px")
    assert panel_rows(GrowingPanel(spark, f"{tmp_path}/panel").panel()) == panel_rows(want)


def test_a_holdout_is_judged_once(spark, tmp_path):
    cfg = Strategy(universe=("A", "B"), lookbacks=(3, 5), vol_window=5, rebalance="weekly", periods_per_year=252)
    px = walk(90, 2, gaps=0)
    prices = frame(spark, px)
    days = business_days(90)
    decision, how = str(days[49]), Holdout(min_bars=25, wf_bars=(10, 5, 5))
    history = prices.where(F.col("dt") <= F.lit(decision).cast("date"))
    sink = HoldoutAccrual(spark, f"file://{tmp_path}/h", cfg, decision, 3, how, history)
    judged_at = []
    for number in range(10):
        part = prices.where(F.col("dt").isin(days[50 + 3 * number : 53 + 3 * number]))
        sink(part, number)
        if number in (2, 8):
            sink(part, number)  # repeated after a failure
        if number == 5:
            sink_late = sink.versions.read("late", "dt date, asset string, px double")
            assert sink_late.count() == 0
        judged_at.append(sink.verdict() is not None)
    assert judged_at == [False] * 8 + [True] * 2
    until = prices.where(F.col("dt") <= F.lit(days[76]).cast("date"))
    want = holdout_verdict(strategy_weights(complete_grid(until), cfg), cfg, decision, 3, how).first().asDict()
    got = sink.verdict()
    assert got.pop("batch") == 8 and got["n_bars"] == 27 and got["sufficient"]
    for k, x in plain_values(want).items():
        assert got[k] == (pytest.approx(x) if isinstance(x, float) else x)
    # bars at or before the newest are kept aside
    sink(prices.where(F.col("dt") == F.lit(days[60]).cast("date")), 10)
    assert sink.versions.read("late", "dt date, asset string, px double").count() == 2 and sink.verdict()["batch"] == 8

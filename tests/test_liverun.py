"""Live runs as relations: gates, periods, references, alerts."""

import pytest
from helpers import TESTDATA, cells, date, oracle
from pyspark.sql import functions as F

from quantloom.plans import live, liverun, registry
from quantloom.sources.config import Strategy

CFG = Strategy(universe=("A", "B"), rebalance="monthly", max_gross_leverage=2.0)
DAYS = ["2024-01-02", "2024-01-15", "2024-02-01", "2024-02-05", "2024-02-20"]


def panel(spark, gap_from=None):
    rows = [(date(d), i, a, None if gap_from and d >= gap_from else 10.0 * (1 + i) * (1 + j), w) for i, d in enumerate(DAYS) for j, (a, w) in enumerate((("A", 0.5 - i / 20), ("B", 0.25)))]
    return spark.createDataFrame(rows, "dt date, bar int, asset string, px double, target_w double")


def runs(spark, *rows):
    """asof, then what differs from a live run on real data."""
    made = [(date(r[0]), *({"equity": 1000.0, "live": True, "force": False, "source": "real", "config_hash": "h"} | (r[1] if len(r) > 1 else {})).values()) for r in rows]
    return spark.createDataFrame(made, liverun.RUN)


def book(spark, held):
    return spark.createDataFrame([(date(d), s, float(q), float(q)) for d, s, q in held] or [(None, "", 0.0, 0.0)], "asof date, symbol string, qty double, market_value double").where("symbol <> ''")


def earlier(spark, *rows):
    return spark.createDataFrame([(date(d), s, w) for d, s, w in rows] or [(None, "", 0.0)], liverun.SUBMITTED).where("symbol <> ''")


def plan(spark, rows, held=(), before=(), recorded="h", limits=liverun.Limits(), gap_from=None):
    return liverun.live_runs(panel(spark, gap_from), runs(spark, *rows), book(spark, held), earlier(spark, *before), CFG, recorded, limits)


def by_day(df, *cols):
    return {str(r["asof"]): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def severity(found, gate):
    return by_day(found.gates.where(F.col("gate") == gate), "severity", "reason")


def test_prices_and_books_as_of(spark):
    asked = spark.createDataFrame([(date(d),) for d in ("2024-01-01", "2024-01-20", "2024-03-01")], "asof date")
    got = {(str(r["asof"]), r["asset"]): (r["px"], r["bar_dt"] and str(r["bar_dt"])) for r in live.prices_as_of(panel(spark, "2024-02-05"), asked).collect()}
    assert got == {("2024-01-01", a): (None, None) for a in "AB"} | {("2024-01-20", "A"): (20.0, "2024-01-15"), ("2024-01-20", "B"): (40.0, "2024-01-15")} | {("2024-03-01", "A"): (30.0, "2024-02-01"), ("2024-03-01", "B"): (60.0, "2024-02-01")}
    books = {(str(r["asof"]), r["symbol"]): r["target_w"] for r in live.books_as_of(panel(spark, "2024-02-05"), asked.where("asof > '2024-01-01'")).collect()}
    # bars without any price at the end are no bars: their weights are not taken
    assert books == {("2024-01-20", "A"): 0.45, ("2024-01-20", "B"): 0.25, ("2024-03-01", "A"): 0.4, ("2024-03-01", "B"): 0.25}
    with pytest.raises(Exception, match="no bar at or before 2024-01-01"):
        live.books_as_of(panel(spark), asked).collect()


def test_one_submission_a_period_unless_forced(spark):
    found = plan(spark, [["2024-01-02"], ["2024-01-15"], ["2024-02-01", {"live": False}], ["2024-02-05"], ["2024-02-20", {"force": True}]])
    assert by_day(found.runs, "action") == {"2024-01-02": "submit", "2024-01-15": "skip", "2024-02-01": "preview", "2024-02-05": "submit", "2024-02-20": "submit"}
    assert severity(found, "cadence")["2024-01-15"] == ("skip", "already submitted for 2024-01")
    # a period that was submitted before all runs
    found = plan(spark, [["2024-01-15"], ["2024-02-05"]], before=[("2024-01-03", "A", 0.5)])
    assert by_day(found.runs, "action") == {"2024-01-15": "skip", "2024-02-05": "submit"}
    assert {(str(r["asof"]), r["symbol"]) for r in liverun.submitted_by(found).collect()} == {("2024-02-05", "A"), ("2024-02-05", "B")}


def test_orders_of_all_runs_equal_those_of_each(spark):
    held = [("2024-01-02", "A", 3), ("2024-02-05", "C", 7), ("2024-02-05", "B", 1)]
    found = plan(spark, [["2024-01-02"], ["2024-02-05", {"equity": 5000.0}]], held)
    for day, equity in (("2024-01-02", 1000.0), ("2024-02-05", 5000.0)):
        one = lambda df: df.where(F.col("asof") == F.lit(day).cast("date")).drop("asof")
        px = live.prices_as_of(panel(spark), runs(spark, [day])).select(F.col("asset").alias("symbol"), "px")
        target = live.target_book(panel(spark), day)
        want = live.plan_orders(target, one(book(spark, held)), px, equity, max_gross=2.0).collect()
        assert sorted(one(found.orders).collect()) == sorted(want) and want


def test_data_gate(spark):
    rows = [["2024-02-01", {"source": "synthetic"}], ["2024-02-05"], ["2024-03-20"], ["2024-03-21", {"live": False, "source": "synthetic"}], ["2023-12-31"]]
    found = plan(spark, rows)
    got = severity(found, "data")
    assert got["2024-02-01"] == ("refuse", "the source is synthetic") and got["2024-02-05"] == ("ok", "")
    assert got["2024-03-20"] == ("refuse", "the last bar is 29 days old") and got["2024-03-21"] == ("warn", "the source is synthetic; the last bar is 30 days old")
    assert got["2023-12-31"] == ("refuse", "there is no bar")
    assert by_day(found.runs, "action", "exit_code") == {"2024-02-01": ("refuse", 1), "2024-02-05": ("submit", 0), "2024-03-20": ("refuse", 1), "2024-03-21": ("preview", 0), "2023-12-31": ("refuse", 1)}
    assert by_day(found.alerts, "text")["2024-02-01"] == "data: the source is synthetic"
    free = plan(spark, rows[:1], limits=liverun.Limits(allow_synthetic=True))
    assert by_day(free.runs, "action") == {"2024-02-01": "submit"}


def test_drift_gate(spark):
    rows = [["2024-02-01", {"config_hash": "x"}], ["2024-02-05", {"config_hash": "x", "live": False}], ["2024-02-20"]]
    got = severity(plan(spark, rows), "drift")
    assert [got[d][0] for d in ("2024-02-01", "2024-02-05", "2024-02-20")] == ["refuse", "warn", "ok"]
    assert {x[0] for x in severity(plan(spark, rows, recorded=None), "drift").values()} == {"ok"}


def test_a_refused_run_leaves_its_period_open(spark):
    found = plan(spark, [["2024-02-01", {"source": "synthetic"}], ["2024-02-05"], ["2024-02-20"]])
    assert by_day(found.runs, "action") == {"2024-02-01": "refuse", "2024-02-05": "submit", "2024-02-20": "skip"}


def test_a_skipped_run_is_compared_with_what_was_submitted(spark):
    # 2024-02-05: A 0.35, B 0.25 of 1000 at prices 40 and 80; two weeks later the signal wants less
    held = [("2024-02-20", "A", 7), ("2024-02-20", "B", 2.5)]
    found = plan(spark, [["2024-02-05"], ["2024-02-20"]], held)
    got = by_day(found.runs, "action", "reference", "exit_code")
    assert got["2024-02-05"] == ("submit", "today", 0) and got["2024-02-20"] == ("skip", "submitted", 0)
    weights = {r["symbol"]: r["target_weight"] for r in found.book.where("asof = '2024-02-20'").collect()}
    assert weights == {"A": 0.35, "B": 0.25}
    # the fills are gone
    gone = plan(spark, [["2024-02-05"], ["2024-02-20"]])
    assert by_day(gone.runs, "action", "anomaly", "exit_code")["2024-02-20"] == ("skip", True, 2)
    assert severity(gone, "reconcile")["2024-02-20"][0] == "escalate"
    alert = gone.alerts.collect()
    assert len(alert) == 1 and alert[0]["exit_code"] == 2 and alert[0]["text"] == "reconcile: the book is off by 0.600 (gross 0.000 against 0.600)"
    # before a submission the same gap is no alert
    assert severity(gone, "reconcile")["2024-02-05"][0] == "warn" and by_day(gone.runs, "exit_code")["2024-02-05"] == 0


def test_too_much_gross_exposure_fails(spark):
    tight = Strategy(universe=("A", "B"), max_gross_leverage=0.5)
    with pytest.raises(Exception, match="gross"):
        liverun.live_runs(panel(spark), runs(spark, ["2024-01-02"]), book(spark, []), earlier(spark), tight).orders.collect()


def test_no_runs(spark):
    found = plan(spark, [["2024-01-02"]])
    none = liverun.live_runs(panel(spark), runs(spark, ["2024-01-02"]).limit(0), book(spark, []), earlier(spark), CFG)
    assert found.runs.count() == 1 and none.runs.count() == none.orders.count() == none.gates.count() == none.alerts.count() == 0


@pytest.mark.parametrize("name", ["live_runs", "live_gates"])
def test_every_week_equals_the_oracle(spark, name):
    got = registry.QUERIES[name](spark, TESTDATA).toPandas()
    want = oracle(registry.ORACLE_SQL[name], lineitem=f"{TESTDATA}/lineitem.parquet")
    assert cells(got) == cells(want)
    if name == "live_runs":
        assert {*got["action"]} == {"submit", "skip", "refuse", "preview"} and {0, 1} <= {*got["exit_code"]}

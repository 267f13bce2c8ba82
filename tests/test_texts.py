"""Reports as text, against written-out pages."""

import math

from helpers import TESTDATA
from pyspark.sql import functions as F

from quantloom.plans import live, registry, texts, validate

STEADY = {"n_windows": 2, "mean_sharpe": 0.75, "std_sharpe": 0.25, "positive_fraction": 1.0, "dispersion": math.inf, "is_stable": True}
WINDOWS = [{"fold": 0, "sharpe": 1.0, "total_return": 0.1}, {"fold": 1, "sharpe": None, "total_return": -0.05}]
TEST = {"start": "2020-01-01", "end": "2021-01-01", "n_periods": 1260, "sharpe": 0.9, "cagr": 0.05, "max_drawdown": -0.1, "dsr": 0.63, "retain": True, **STEADY}

FINAL = """Locked test
================================================================
from    2020-01-01
to      2021-01-01
bars    1,260
trials  5
----------------------------------------------------------------
Sharpe            0.9000
CAGR              0.0500
maximum drawdown  -0.1000
deflated Sharpe   0.6300
needed            0.6000
----------------------------------------------------------------
window  Sharpe   return
     0  1.0000   0.1000
     1     n/a  -0.0500
windows        2
mean Sharpe    0.7500
std of Sharpe  0.2500
share above 0  1.0000
dispersion     inf
stable         yes
----------------------------------------------------------------
verdict: retain
A verdict is advice: people decide, and the locked test is read once.
"""
RECONCILE = """Reconciliation: anomaly
================================================================
distance      0.7000
tolerance     0.2500
largest       0.4000
gross held    0.0000
gross wanted  0.7000
the book is flat, though it should be invested
----------------------------------------------------------------
symbol  wanted    held  off by
A       0.4000  0.0000  0.4000
B       0.3000  0.0000  0.3000
"""
COSTS = """Costs
================================================================
bps a side    CAGR  volatility  Sharpe  drawdown    cost      equity
2*          0.0500      0.1000  0.5000   -0.2000  1.0000  2,000.0000
10          0.0400      0.1000  0.4000   -0.2100  5.0000  1,900.0000
----------------------------------------------------------------
* the base level
"""
RUN = """A run
================================================================
sharpe  0.5000
bars    3
----------------------------------------------------------------
asset  contribution
B            2.0000
A           -1.0000
"""
PREVIEW = """Orders as of 2024-01-02
================================================================
a dry run: nothing is sent
----------------------------------------------------------------
buy  A                10.0000 @        50.00 =         500.00  rebalance
----------------------------------------------------------------
orders        1
bought        500.0000
sold          0.0000
cost, about   0.1000
gross wanted  0.5000
"""
STATUS = """Account
================================================================
equity        1,000.0000
cash          500.0000
buying power  2,000.0000
----------------------------------------------------------------
no open position
"""


def test_pages():
    assert texts.final_text(TEST, WINDOWS, 5, 0.6) == FINAL
    assert "verdict: reject" in texts.final_text(TEST | {"retain": False}, WINDOWS, 5, 0.6)
    assert "stability is unknown" in texts.final_text(TEST | {"n_windows": 0}, [], 5, 0.6)
    book = [{"symbol": s, "target_weight": w, "current_weight": 0.0, "deviation": w} for s, w in (("B", 0.3), ("A", 0.4))]
    summary = {"l1": 0.7, "max_deviation": 0.4, "current_gross": 0.0, "target_gross": 0.7, "flat": True, "off_target": True, "anomaly": True}
    assert texts.reconcile_text(summary, book, 0.25) == RECONCILE
    assert "in order" in texts.reconcile_text(summary | {"flat": False, "off_target": False, "anomaly": False}, [], 0.25)
    level = {"cagr": 0.05, "annual_vol": 0.1, "sharpe": 0.5, "max_drawdown": -0.2, "total_cost": 1.0, "final_equity": 2000.0, "bps": 2.0, "is_base": True}
    worse = level | {"cagr": 0.04, "sharpe": 0.4, "max_drawdown": -0.21, "total_cost": 5.0, "final_equity": 1900.0, "bps": 10.0, "is_base": False}
    assert texts.cost_text([worse, level]) == COSTS
    assert texts.run_text({"sharpe": 0.5, "bars": 3, "per_asset": {}}, [{"asset": "A", "pnl": -1.0}, {"asset": "B", "pnl": 2.0}], "A run") == RUN
    order = {"symbol": "A", "side": "buy", "qty": 10.0, "est_price": 50.0, "notional": 500.0, "reason": "rebalance"}
    plan = {"n_orders": 1, "buy_notional": 500.0, "sell_notional": 0.0, "est_cost": 0.1, "target_gross": 0.5}
    assert texts.preview_text({"asof": "2024-01-02", "action": "preview"}, [order], plan) == PREVIEW
    assert "no orders" in texts.preview_text({"asof": "2024-01-02", "action": "skip"}, [], plan)
    account = {"equity": 1000.0, "cash": 500.0, "buying_power": 2000.0}
    assert texts.status_text(account, []) == STATUS
    assert "A         1.0000  9.0000" in texts.status_text(account, [{"symbol": "A", "qty": 1.0, "market_value": 9.0}])


def test_holdout_pages():
    short = texts.holdout_text({"n_bars": 40, "sufficient": False}, [], 5, 252, 0.6)
    assert "212 more bars" in short and "verdict" not in short
    row = TEST | {"n_bars": 300, "sufficient": True, "dsr_1": 0.7, "dsr_5": 0.5, "retain_1": True, "retain_5": False}
    whole = texts.holdout_text(row, WINDOWS, 5, 252, 0.6)
    assert "verdict, trials: 1: retain\nverdict, trials: 5: reject\n" in whole and "rests on" not in whole
    assert "rests on the deflated Sharpe ratio alone" in texts.holdout_text(row | {"n_windows": 1}, WINDOWS[:1], 1, 252, 0.6)


def test_pages_of_rows_of_the_plans(spark):
    w = registry.weighted(spark, TESTDATA)
    row = validate.holdout_verdict(w, registry.WEEK, registry.DECISION, 5, validate.Holdout(min_bars=52, wf_bars=(26, 13, 13))).first()
    page = texts.holdout_text(row.asDict(), [], 5, 52, 0.6)
    assert f"bars        {row['n_bars']}" in page and page.count("verdict, trials") == 2
    target, held, px = registry._planned(spark, TESTDATA)
    orders = live.plan_orders(target, held, px, registry.EQUITY, 100.0)
    summary = live.plan_summary(orders, target, 2.0).first()
    page = texts.preview_text({"asof": registry.ASOF, "action": "submit"}, orders.collect(), summary.asDict())
    assert page.count(" @ ") == summary["n_orders"] > 0
    book = live.reconcile(target, held, px, registry.EQUITY)
    page = texts.reconcile_text(live.reconcile_summary(book).first().asDict(), book.collect(), 0.25)
    assert page.count("\n") >= book.count() + 8 and book.agg(F.count("*")).first()[0] > 0

import numpy as np
import pandas as pd
import pytest
from helpers import business_days, frame, walk, wide
from pyspark.sql import functions as F

from quantloom.operators.backtest import rebalances, run_backtest
from quantloom.operators.metrics import attribution, drawdowns, performance
from quantloom.operators.panel import complete_grid
from quantloom.plans.validate import cost_stress, strategy_weights
from quantloom.sources.config import Strategy


def step_by_step(px, target, rebalance, bps, capital):
    r = pd.DataFrame(px).pct_change(fill_method=None).replace([np.inf, -np.inf], np.nan).fillna(0).to_numpy()
    want = np.vstack([np.zeros(px.shape[1]), target[:-1]])
    book, eq, out = np.zeros(px.shape[1]), capital, []
    for t in range(len(px)):
        turn = 0.0
        if rebalance[t]:
            turn, book = np.abs(want[t] - book).sum(), want[t].copy()
        g = book @ r[t]
        eq *= (1 - bps * 1e-4 * turn) * (1 + g)
        out.append((eq, turn, book.copy()))
        if 1 + g != 0:
            book = book * (1 + r[t]) / (1 + g)
    return np.array([x[0] for x in out]), np.array([x[1] for x in out]), np.array([x[2] for x in out])


def panel(spark, px, target):
    target = np.asarray(target, float)
    target = target[:, None] if target.ndim == 1 else target
    rows = [(i, "ABCDEFGH"[j], float(target[i, j])) for i in range(target.shape[0]) for j in range(target.shape[1])]
    return complete_grid(frame(spark, px)).join(spark.createDataFrame(rows, "bar int, asset string, target_w double"), ["bar", "asset"], "left")


def equity(b):
    return b.bars.orderBy("bar").toPandas()


@pytest.mark.parametrize("cadence", ["daily", "weekly", "monthly"])
def test_closed_form_equals_the_recursion(spark, cadence):
    rng = np.random.default_rng(5)
    px, target = walk(90, 4), rng.normal(0, 0.3, (90, 4))
    days = pd.DatetimeIndex(business_days(90))
    code = {"daily": days, "weekly": days.to_period("W"), "monthly": days.to_period("M")}[cadence]
    mask = np.r_[True, code[1:] != code[:-1]]
    b = run_backtest(panel(spark, px, target), cadence, 10.0, 1000.0)
    eq, turn, held = step_by_step(px, target, mask, 10.0, 1000.0)
    got = equity(b)
    np.testing.assert_allclose(got.equity, eq, rtol=1e-12)
    np.testing.assert_allclose(got.turnover, turn, atol=1e-13)
    np.testing.assert_allclose(wide(b.held, "w").to_numpy(), held, atol=1e-13)
    assert list(got["rebalance"]) == list(mask)


def test_full_weight_at_no_cost_is_the_asset(spark):
    px = walk(60, 1, gaps=0)
    got = equity(run_backtest(panel(spark, px, np.ones(60)), "daily", 0.0, 1.0))
    np.testing.assert_allclose(got.equity, np.r_[1, px[1:, 0] / px[0, 0]], rtol=1e-12)


def test_targets_act_one_bar_later_and_flat_prices_earn_nothing(spark):
    target = np.zeros((10, 2))
    target[4] = (0.5, -0.3)
    b = run_backtest(panel(spark, np.full((10, 2), 100.0), target), "daily", 0.0, 1.0)
    held = wide(b.held, "w").to_numpy()
    assert (held[5] == (0.5, -0.3)).all() and not held[[0, 1, 2, 3, 4, 6, 7, 8, 9]].any()
    assert (equity(b).equity == 1.0).all()


def test_the_ledger(spark):
    b = run_backtest(panel(spark, np.full((5, 1), 100.0), np.ones(5)), "daily", 10.0, 1000.0)
    (t,) = b.trades.collect()
    assert t["bar"] == 1 and t["delta_weight"] == 1.0 and t["cost"] == pytest.approx(1.0)
    assert equity(b).equity.iloc[-1] == pytest.approx(999.0)


def test_cost_lowers_equity_and_all_levels_run_together(spark):
    cfg = Strategy(lookbacks=(5, 10), vol_window=10, rebalance="weekly", cost_stress_levels=(2.0, 5.0, 50.0))
    w = strategy_weights(complete_grid(frame(spark, walk(70, 3))), cfg)
    got = cost_stress(w, cfg).orderBy("bps").toPandas()
    assert list(got.bps) == [2.0, 5.0, 50.0] and list(got.is_base) == [True, False, False]
    assert got.final_equity.is_monotonic_decreasing and got.total_cost.is_monotonic_increasing


def test_a_wiped_out_book_goes_bar_by_bar(spark):
    px = np.array([[100.0, 100], [100, 100], [100, 10], [100, 10], [120, 11], [110, 12]])
    target = np.tile([0.5, 1.2], (6, 1))
    both = panel(spark, px, target).withColumn("run", F.lit("bad")).unionByName(panel(spark, px, target * 0.1).withColumn("run", F.lit("good")))
    b = run_backtest(both, "monthly", 5.0, 1.0, ["run"], wipeout="sequential")
    monthly = np.array([True] + [False] * 5)
    for run, k in (("bad", 1.0), ("good", 0.1)):
        eq, _, _ = step_by_step(px, target * k, monthly, 5.0, 1.0)
        np.testing.assert_allclose(b.bars.where(F.col("run") == run).orderBy("bar").toPandas().equity, eq, rtol=1e-12)


def test_rebalances_once_a_period(spark):
    g = complete_grid(frame(spark, walk(70, 1, gaps=0)))
    for cadence, n in (("daily", 70), ("weekly", 14), ("monthly", 4)):
        assert rebalances(g, cadence).where("rebalance").count() == n
    with pytest.raises(ValueError):
        rebalances(g, "yearly")


def curve(spark, values, turnover=0.0):
    rows = [(d, i, float(v), turnover) for i, (d, v) in enumerate(zip(business_days(len(values)), values))]
    return spark.createDataFrame(rows, "dt date, bar int, equity double, turnover double")


def measure(spark, values):
    return performance(curve(spark, values), 252).first()


def test_constant_growth_has_no_sharpe(spark):
    m = measure(spark, 100 * 1.001 ** np.arange(51))
    assert m["sharpe"] is None and m["annual_vol"] == 0.0 and m["profit_factor"] == float("inf") and m["calmar"] == float("inf")


def test_known_metrics(spark):
    r = np.tile([0.01, -0.005, 0.02, -0.005], 5)
    m = measure(spark, 100 * np.cumprod(np.r_[1, 1 + r]))
    assert m["sharpe"] == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252))
    assert m["sortino"] == pytest.approx(r.mean() / 0.005 * np.sqrt(252))
    assert m["hit_rate"] == 0.5 and m["profit_factor"] == pytest.approx(3.0)
    assert measure(spark, 2 ** (np.arange(253) / 252))["cagr"] == pytest.approx(1.0)


def test_drawdown_and_its_length(spark):
    assert measure(spark, [100, 120, 90, 110])["max_drawdown"] == pytest.approx(-0.25)
    assert measure(spark, [100, 110, 100, 105, 120])["max_drawdown_duration"] == 2
    assert measure(spark, [100, 101, 102])["max_drawdown_duration"] == 0
    d = drawdowns(curve(spark, [100, 120, 90, 95, 130])).orderBy("bar").toPandas()
    assert list(d.below) == [0, 2, 2, 2, 0]


def test_short_and_sunk_curves(spark):
    one = measure(spark, [100])
    assert one["cagr"] is None and one["sharpe"] is None and one["max_drawdown"] == 0.0
    assert measure(spark, [100, -5])["cagr"] is None


def test_attribution_adds_up(spark):
    px, target = walk(40, 3, gaps=0), np.tile([0.3, 0.2, 0.1], (40, 1))
    b = run_backtest(panel(spark, px, target), "daily", 0.0, 1000.0)
    eq = equity(b).equity
    assert attribution(b.bars, b.held).agg(F.sum("pnl")).first()[0] == pytest.approx(eq.iloc[-1] - eq.iloc[1], rel=1e-9)

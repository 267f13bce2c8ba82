import numpy as np
import pytest
from helpers import business_days, date, frame, walk, wide

from quantloom.operators.panel import as_of, complete_grid, exposures, last_months, last_prices, trim_trailing_gaps, usability, with_returns
from quantloom.operators.risk import covariance, covariance_long, fits, target_weights, with_volatility
from quantloom.operators.signal import momentum
from quantloom.plans.validate import strategy_weights
from quantloom.sources.config import Strategy

CFG = Strategy(lookbacks=(5, 21), direction="long_short", vol_window=20, rebalance="weekly")


def test_grid_has_every_cell_and_null_gaps(spark):
    g = complete_grid(frame(spark, [[1, np.nan], [np.nan, 2], [3, 4]]))
    assert g.count() == 6 and g.where("px IS NULL").count() == 2
    assert {(r["bar"], str(r["dt"])) for r in g.select("bar", "dt").collect()} == {(i, str(d)) for i, d in enumerate(business_days(3))}


def test_grid_of_no_rows_and_asked_assets(spark):
    none = spark.createDataFrame([], "dt date, asset string, px double")
    assert complete_grid(none).count() == 0
    asked = spark.createDataFrame([("A",), ("Z",)], "asset string")
    g = complete_grid(frame(spark, [1.0, 2.0]), asked).toPandas()
    assert g[g.asset == "Z"].px.isna().all() and len(g) == 4


def test_nan_and_infinity_are_gaps(spark):
    rows = [(date("2020-01-01"), "A", float("nan")), (date("2020-01-02"), "A", float("inf")), (date("2020-01-03"), "A", 1.0)]
    g = complete_grid(spark.createDataFrame(rows, "dt date, asset string, px double"))
    assert g.where("px IS NULL").count() == 2


def test_a_gap_loses_two_returns(spark):
    px = np.arange(100.0, 110.0)
    px[2] = np.nan
    r = wide(with_returns(complete_grid(frame(spark, np.c_[px, np.full(10, 5.0)]))), "ret")["A"]
    assert list(np.flatnonzero(r.isna())) == [0, 2, 3]


def test_trailing_gaps_go_and_inner_gaps_stay(spark):
    px = [[1, 1], [np.nan, np.nan], [2, 2], [3, np.nan]]
    days = business_days(5)
    df = frame(spark, px).unionByName(spark.createDataFrame([(days[4], "A", None), (days[1], "A", None)], "dt date, asset string, px double"))
    g = trim_trailing_gaps(complete_grid(df))
    assert sorted({r["bar"] for r in g.collect()}) == [0, 1, 2, 3]


def test_last_prices_and_as_of(spark):
    g = complete_grid(frame(spark, np.array([[1, 10], [2, 11], [3, 12], [np.nan, 13]])))
    assert {r["asset"]: r["px"] for r in last_prices(g).collect()} == {"A": 3.0, "B": 13.0}
    assert {r["asset"]: r["px"] for r in as_of(g, "2018-01-03").collect()} == {"A": 3.0, "B": 12.0}
    assert as_of(g, "2017-01-01").count() == 0


def test_last_months_clamps_to_the_month(spark):
    rows = [(date(d), "A", 1.0) for d in ("2024-02-28", "2024-02-29", "2024-03-01", "2024-03-31")]
    left = last_months(complete_grid(spark.createDataFrame(rows, "dt date, asset string, px double")), 1)
    assert sorted(str(r["dt"]) for r in left.collect()) == ["2024-03-01", "2024-03-31"]


def test_usability(spark):
    g = complete_grid(frame(spark, walk(50, 2)))
    assert usability(g, (5, 21), 20, ["A"]).first()["usable"]
    assert not usability(g, (5, 21), 40, ["A"]).first()["usable"]
    assert not usability(g, (5, 21), 20, ["Q"]).first()["usable"]


def test_momentum_needs_all_lookbacks_and_keeps_gaps(spark):
    px = np.linspace(100, 200, 60)
    px[40] = np.nan
    s = wide(momentum(complete_grid(frame(spark, np.c_[px, np.full(60, 5.0)])), (5, 21), "long_only"), "signal")["A"]
    assert s[:21].isna().all() and np.isnan(s[40]) and np.isnan(s[45]) and s[30] == 1.0
    down = wide(momentum(complete_grid(frame(spark, px[::-1])), (5,), "long_only"), "signal")["A"]
    assert np.isnan(down[0]) and down[10] == 0.0


@pytest.mark.parametrize("bad", [((), "long_only"), ((0,), "long_only"), ((5,), "both")])
def test_momentum_rejects(spark, bad):
    with pytest.raises(ValueError):
        momentum(complete_grid(frame(spark, [1.0])), *bad)


def test_the_past_ignores_the_future(spark):
    px = walk(80, 3)
    whole = strategy_weights(complete_grid(frame(spark, px)), CFG)
    part = strategy_weights(complete_grid(frame(spark, px[:60])), CFG)
    for c in ("signal", "sigma", "target_w"):
        a, b = wide(whole, c)[:60].to_numpy(), wide(part, c).to_numpy()
        np.testing.assert_array_equal(a, b)


def test_risk_equals_the_recursion(spark):
    import pandas as pd

    px = walk(90, 3)
    ret = pd.DataFrame(px).pct_change(fill_method=None)
    g = with_returns(complete_grid(frame(spark, px)))
    sigma = wide(with_volatility(g, 20.0, 252.0), "sigma").to_numpy()
    np.testing.assert_allclose(sigma, (ret.ewm(com=20.0, min_periods=2).std() * np.sqrt(252)).to_numpy(), rtol=1e-9)
    keys = ["bar", "asset_i", "asset_j"]
    a, b = (f(g, 20.0, 252.0).toPandas().sort_values(keys)["cov"].to_numpy(float) for f in (covariance, covariance_long))
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-15)
    assert fits(60.0, 20_000) and not fits(1.0, 600)


def test_cap_kelly_and_unusable_cells(spark):
    px = walk(60, 3, gaps=0)
    g = with_returns(momentum(complete_grid(frame(spark, px)), CFG.lookbacks, "long_short"))
    tight = Strategy(**{**CFG.__dict__, "max_gross_leverage": 0.05})
    w = target_weights(g, tight)
    gross = exposures(w, "target_w").toPandas()["gross"]
    assert gross.max() <= 0.05 + 1e-12 and (gross > 0.049).any()
    assert w.where("target_w IS NULL").count() == 0
    assert w.where("(signal IS NULL OR signal = 0) AND target_w <> 0").count() == 0
    free = Strategy(**{**CFG.__dict__, "max_gross_leverage": 1e9})
    half = Strategy(**{**CFG.__dict__, "max_gross_leverage": 1e9, "kelly_fraction": 0.5})
    a, b = (wide(target_weights(g, c), "target_w").to_numpy() for c in (free, half))
    np.testing.assert_allclose(a / 2, b, rtol=1e-12)


def test_risk_over_long_histories_with_long_gaps(spark):
    import pandas as pd

    # weights of this window grow beyond a double after some 1200 bars; one asset has no price for 900 bars
    px = walk(5000, 2, gaps=0)
    px[::37, 0] = np.nan
    px[1500:2400, 0] = np.nan
    ret = pd.DataFrame(px).pct_change(fill_method=None)
    g = with_returns(complete_grid(frame(spark, px)))
    sigma = wide(with_volatility(g, 3.0, 252.0), "sigma").to_numpy()
    want = (ret.ewm(com=3.0, min_periods=2).std() * np.sqrt(252)).to_numpy()
    # pandas counts positions, also within the long gap
    np.testing.assert_allclose(sigma[:1500], want[:1500], rtol=1e-9)
    np.testing.assert_allclose(sigma[2500:], want[2500:], rtol=1e-9)
    np.testing.assert_array_equal(np.isnan(sigma), np.isnan(want))
    keys = ["bar", "asset_i", "asset_j"]
    a, b = (f(g, 3.0, 252.0).toPandas().sort_values(keys)["cov"].to_numpy(float) for f in (covariance, covariance_long))
    np.testing.assert_array_equal(np.isnan(a), np.isnan(b))
    np.testing.assert_allclose(a[: 3 * 1500], b[: 3 * 1500], rtol=1e-8, atol=1e-12)
    w = target_weights(with_returns(momentum(complete_grid(frame(spark, px[:1500])), (5, 21), "long_short")), Strategy(**{**CFG.__dict__, "vol_window": 3}))
    assert w.where("target_w IS NULL OR isnan(target_w)").count() == 0

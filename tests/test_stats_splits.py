import math

import numpy as np
import pytest
from helpers import business_days, frame, walk
from pyspark.sql import functions as F

from quantloom.functions.scalar import normal_cdf, period_key_of
from quantloom.operators.panel import complete_grid
from quantloom.operators.splits import locked_split, out_of_sample, purged_folds, walk_forward
from quantloom.operators.stats import bootstrap_indices, bootstrap_means, bootstrap_runs, deflated_sharpe, distinct_trials, expected_max_factor, hansen_spa, moments, white_reality_check
from quantloom.plans.validate import Holdout, final_verdict, holdout_verdict, stability, strategy_weights
from quantloom.sources.config import Strategy


def bars(spark, n):
    return spark.createDataFrame([(d, i) for i, d in enumerate(business_days(n))], "dt date, bar int")


def returns(spark, r):
    return spark.createDataFrame([(float(x),) for x in r], "r double")


def test_locked_split(spark):
    got = locked_split(bars(spark, 101), 0.7).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in got} == {"train": 70, "test": 31}


def test_walk_forward_windows_are_complete_and_follow(spark):
    w = walk_forward(bars(spark, 300), 126, 63, 63).collect()
    test = sorted((r["lo"], r["hi"]) for r in w if r["role"] == "test")
    assert test == [(126, 189), (189, 252)]
    assert walk_forward(bars(spark, 188), 126, 63, 63).count() == 0
    assert out_of_sample(bars(spark, 300), walk_forward(bars(spark, 300), 126, 63, 21)).count() == 63 + 5 * 21


@pytest.mark.parametrize("n,k,h,e", [(100, 5, 0, 0.0), (97, 4, 10, 0.05), (200, 5, 63, 0.01)])
def test_purged_folds(spark, n, k, h, e):
    got = purged_folds(bars(spark, n), k, h, e).toPandas()
    length = int(round(e * n))
    for fold, test in enumerate(np.array_split(np.arange(n), k)):
        f = got[got.fold == fold].set_index("pos").sort_index()
        lo, hi, pos = test[0], test[-1], f.index.to_numpy()
        out = (pos < lo) | (pos > hi)
        assert (f.is_test.to_numpy() == ~out).all()
        assert (f.is_purged.to_numpy() == (out & (pos + h >= lo) & (pos - h <= hi))).all()
        assert (f.is_embargoed.to_numpy() == ((pos > hi) & (pos <= hi + length))).all()
        assert (f.is_train == ~(f.is_test | f.is_purged | f.is_embargoed)).all()


def test_moments_are_bias_corrected(spark):
    import pandas as pd

    r = np.random.default_rng(1).gamma(2.0, 1.0, 60)
    m = moments(returns(spark, r)).first()
    assert m["skew"] == pytest.approx(pd.Series(r).skew()) and m["kurtosis"] == pytest.approx(pd.Series(r).kurt() + 3)
    assert moments(returns(spark, [1.0, 2.0])).first()["skew"] is None


def test_deflated_sharpe(spark):
    r = np.random.default_rng(42).normal(0.001, 0.01, 1000)
    got = [deflated_sharpe(returns(spark, r), n).first()["dsr"] for n in (1, 2, 10)]
    assert got[0] > got[1] > got[2] and got[1] > 0.5 and got[2] > 0.3
    m = moments(returns(spark, r)).first()
    sr = r.mean() / r.std(ddof=1)
    psr = normal_cdf(sr * math.sqrt(999) / math.sqrt(1 - m["skew"] * sr + (m["kurtosis"] - 1) / 4 * sr * sr))
    assert got[0] == pytest.approx(psr, rel=1e-12)
    assert deflated_sharpe(returns(spark, [0.01] * 5), 2).first()["dsr"] is None
    assert expected_max_factor(1) == 0 and expected_max_factor(10) > expected_max_factor(3) > 0
    with pytest.raises(ValueError):
        expected_max_factor(0)


@pytest.mark.parametrize("n,block", [(50, 8), (40, 1), (40, 20)])
def test_bootstrap_goes_on_by_one_or_restarts(spark, n, block):
    got = bootstrap_indices(spark, n, 37, block).orderBy("b", "step").toPandas()
    t = got.t.to_numpy().reshape(37, n)
    assert t.min() >= 0 and t.max() < n and got.groupby("b").size().eq(n).all()
    on = (t[:, 1:] == (t[:, :-1] + 1) % n).mean()
    assert abs(on - (1 - 1 / block + 1 / block / n)) < 0.06
    again = bootstrap_indices(spark, n, 37, block).orderBy("b", "step").toPandas()
    assert (again.t == got.t).all()


def matrix(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "t int, k int, d double")


def test_reality_checks(spark):
    rng = np.random.default_rng(7)
    null = rng.normal(0, 0.01, (150, 5))
    good = null.copy()
    good[:, 0] += 0.006
    ix = bootstrap_indices(spark, 150, 100, 10.0)
    assert white_reality_check(matrix(spark, good), ix).first()["p_value"] < 0.05 < white_reality_check(matrix(spark, null), ix).first()["p_value"]
    worse = np.c_[good, rng.normal(-0.004, 0.01, (150, 6)), np.full(150, 0.0)]
    s = hansen_spa(matrix(spark, worse), ix).first()
    assert s["k_best"] == 0 and s["p_value_lower"] <= s["p_value"] <= s["p_value_upper"]
    assert s["p_value"] <= white_reality_check(matrix(spark, worse), ix).first()["p_value"]


@pytest.mark.parametrize("n,block", [(30, 5), (20, 1), (12, 40), (1, 3)])
def test_means_of_runs_equal_those_of_their_rows(spark, n, block):
    m = np.random.default_rng(n).normal(0, 1, (n, 4))
    got, want = ({(r["b"], r["k"]): r["boot_mean"] for r in bootstrap_means(matrix(spark, m), f(spark, n, 25, block)).collect()} for f in (bootstrap_runs, bootstrap_indices))
    assert len(got) == 100 and got == pytest.approx(want, abs=1e-12)
    runs = bootstrap_runs(spark, n, 25, block).toPandas()
    assert runs.groupby("b").length.sum().eq(n).all() and (runs.length > 0).all()


def test_bootstrap_means_equal_a_gather(spark):
    m = np.random.default_rng(2).normal(0, 1, (30, 3))
    ix = bootstrap_indices(spark, 30, 40, 5.0)
    t = ix.orderBy("b", "step").toPandas().t.to_numpy().reshape(40, 30)
    v = np.sqrt(30) * m.mean(0).max()
    p = (np.sqrt(30) * (m - m.mean(0))[t].mean(1)).max(1) >= v
    assert white_reality_check(matrix(spark, m), ix).first()["p_value"] == pytest.approx(p.mean())


def test_distinct_trials(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, None), (None, None)], "s string, n int")
    assert tuple(distinct_trials(t).first()) == (3, 5)
    assert tuple(distinct_trials(t.limit(0)).first()) == (1, 0)


def test_stability(spark):
    w = lambda *s: spark.createDataFrame([(i, x) for i, x in enumerate(s)], "fold int, sharpe double")
    assert stability(w(1.0, 1.2, 0.8)).first()["is_stable"]
    assert not stability(w(1.0)).first()["is_stable"] and not stability(w(-1.0, -2.0)).first()["is_stable"]
    none = stability(w(None, None)).first()
    assert not none["is_stable"] and none["dispersion"] == float("inf") and none["n_windows"] == 2


def test_verdicts(spark):
    cfg = Strategy(lookbacks=(5, 10), vol_window=10, rebalance="weekly", wf_train_years=0.2, wf_test_years=0.1, wf_step_years=0.1)
    w = strategy_weights(complete_grid(frame(spark, walk(130, 2))), cfg)
    v = final_verdict(w, cfg, 5).first()
    assert v["n_periods"] == 130 - 91 and v["retain"] == ((v["dsr"] or 0) > 0.6 and v["is_stable"])
    h = holdout_verdict(w, cfg, "2018-04-30", 5, Holdout(min_bars=500)).first()
    assert not h["sufficient"] and h["retain_5"] is None
    h = holdout_verdict(w, cfg, "2018-04-30", 5, Holdout(min_bars=20)).first()
    assert h["sufficient"] and h["n_bars"] == 130 - 86 and h["dsr_5"] < h["dsr_1"]


def test_period_keys_and_months(spark):
    df = spark.createDataFrame([("2020-12-31",), ("2021-01-03",), ("2024-12-30",)], "d string").select(F.to_date("d").alias("d"))
    from quantloom.functions.scalar import period_key

    for r in df.select("d", *(period_key(F.col("d"), c).alias(c) for c in ("daily", "weekly", "monthly"))).collect():
        assert all(r[c] == period_key_of(f"{r['d']}T10:00:00", c) for c in ("daily", "weekly", "monthly"))
    with pytest.raises(ValueError):
        period_key_of("2020-13-01", "daily")

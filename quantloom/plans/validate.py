"""Validation plans: cost stress, replays on slices, stability, verdicts, pre-registration and hold-outs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalar import normal_cdf_of
from quantloom.operators.backtest import run_backtest
from quantloom.operators.metrics import equity_returns, performance
from quantloom.operators.panel import after, last_months, rebased, with_returns
from quantloom.operators.risk import target_weights
from quantloom.operators.signal import momentum
from quantloom.operators.splits import in_windows, walk_forward, years_to_bars
from quantloom.operators.stats import hurdle_and_z, sharpe_moments
from quantloom.sources.config import Strategy
from quantloom.sources.scratch import kept

DSR_THRESHOLD, MIN_POSITIVE, MAX_DISPERSION = 0.60, 0.5, 2.0


def strategy_weights(grid: DataFrame, cfg: Strategy, by: Sequence[str] = ()) -> DataFrame:
    """grid with signal, ret, sigma, raw and target_w."""
    return target_weights(with_returns(momentum(grid, cfg.lookbacks, cfg.direction, by), by), cfg, by)


def _columns(weighted: DataFrame) -> DataFrame:
    return weighted.select("dt", "bar", "asset", "px", "target_w")


def written_panel(weighted: DataFrame) -> DataFrame:
    """What a replay reads of a weighted panel, as a table: replays read their rows several times, and would work out signal and risk anew each time."""
    return kept(_columns(weighted), "panel")


def distinct_levels(levels: DataFrame) -> DataFrame:
    """(bps, is_base): each level once; the base level where any of its rows is."""
    return levels.groupBy("bps").agg(F.bool_or("is_base").alias("is_base"))


def cost_levels(grid: DataFrame, cfg: Strategy) -> DataFrame:
    """(bps, is_base): the base cost and the stress levels, each once."""
    spark = grid.sparkSession
    rows = [(float(cfg.cost_bps_per_side), True), *((float(x), False) for x in cfg.cost_stress_levels)]
    return distinct_levels(spark.createDataFrame(rows, "bps double, is_base boolean"))


def cost_stress(weighted: DataFrame, cfg: Strategy) -> DataFrame:
    """One row per cost level: is_base and the replay's metrics; all levels in one job. The book's weights don't depend on the cost.

    The panel and the replay's bars are written once, and read from there.
    """
    levels = cost_levels(weighted, cfg)
    runs = written_panel(weighted).crossJoin(F.broadcast(levels.select("bps")))
    b = run_backtest(runs, cfg.rebalance, F.col("bps"), cfg.initial_capital, by=["bps"])
    return performance(kept(b.bars, "stress-bars"), cfg.periods_per_year, ["bps"]).join(levels, "bps")


def replay(slices: DataFrame, cfg: Strategy, by: Sequence[str]):
    """Backtest of each run's slice of a weighted panel: it starts flat and counts its bars from 0."""
    return run_backtest(rebased(slices, by), cfg.rebalance, cfg.cost_bps_per_side, cfg.initial_capital, by)


def window_metrics(weighted: DataFrame, windows: DataFrame, cfg: Strategy) -> DataFrame:
    """(fold, sharpe, total_return) of each test window's replay, whose bars are written once. weighted is read several times: see ``written_panel``."""
    slices = in_windows(_columns(weighted), windows.where("role = 'test'")).drop("lo", "hi")
    bars = kept(replay(slices, cfg, ["fold"]).bars, "window-bars")
    gain = equity_returns(bars, ["fold"]).groupBy("fold").agg((F.coalesce(F.product(1 + F.col("r")), F.lit(1.0)) - 1).alias("total_return"))
    return performance(bars, cfg.periods_per_year, ["fold"]).select("fold", "sharpe").join(gain, "fold")


def stability(per_window: DataFrame, min_positive: float = MIN_POSITIVE, max_dispersion: float = MAX_DISPERSION) -> DataFrame:
    """One row over all windows: n_windows, mean_sharpe, std_sharpe, positive_fraction, dispersion, is_stable."""
    s = F.col("sharpe")
    got = per_window.agg(F.count("*").alias("n_windows"), F.count("sharpe").alias("__k"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_samp("sharpe").alias("std_sharpe"), F.avg((s > 0).cast("double")).alias("positive_fraction"))
    got = got.withColumn("std_sharpe", F.when(F.col("__k") == 1, 0.0).otherwise(F.col("std_sharpe")))
    got = got.withColumn("dispersion", F.when(F.abs("mean_sharpe") > 1e-9, F.try_divide(F.col("std_sharpe"), F.abs("mean_sharpe"))).otherwise(float("inf")))
    ok = (F.col("n_windows") >= 2) & (F.col("mean_sharpe") > 0) & (F.col("positive_fraction") >= min_positive) & (F.col("dispersion") <= max_dispersion)
    return got.withColumn("is_stable", F.coalesce(ok, F.lit(False))).drop("__k")


#: The fold of the judged slice beside those of the windows.
SLICE = -1


def _judged(panel: DataFrame, lo, hi, windows: DataFrame, cfg: Strategy, trials: Sequence[int], threshold: float, always_stable_under: int = 0) -> DataFrame:
    """The bars from lo to before hi and all test windows are the runs of one replay, whose bars are written once; all figures come from these.

    The deflated Sharpe ratios of all numbers of trials come from one set of moments.
    """
    slice_ = panel.agg(F.lit(SLICE).alias("fold"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    runs = slice_.unionByName(windows.where("role = 'test'").select("fold", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))
    b = replay(in_windows(panel, runs).drop("lo", "hi"), cfg, ["fold"])
    bars = kept(b.bars, "verdict-bars")
    figures = kept(performance(bars, cfg.periods_per_year, ["fold"]), "verdict-figures")
    m = sharpe_moments(equity_returns(bars.where(F.col("fold") == SLICE), ["fold"]), by=["fold"])
    found = {}
    for n in trials:
        _, z = hurdle_and_z(n)
        found |= {f"z_{n}": z, f"dsr_{n}": normal_cdf_of(z)}
    out = figures.where(F.col("fold") == SLICE).join(m.select("fold", *(c.alias(k) for k, c in found.items())), "fold", "left")
    out = out.crossJoin(stability(figures.where("fold >= 0")))
    leg = F.col("is_stable") | (F.col("n_windows") < always_stable_under)
    for n in trials:
        out = out.withColumn(f"retain_{n}", F.coalesce(F.col(f"dsr_{n}") > threshold, F.lit(False)) & leg)
    return out.drop("fold")


def final_verdict(weighted: DataFrame, cfg: Strategy, n_trials: int, threshold: float = DSR_THRESHOLD) -> DataFrame:
    """One row: the locked test's metrics, its deflated Sharpe ratio, stability over the whole history, and whether to retain."""
    panel = written_panel(weighted)
    bars = panel.select("dt", "bar").distinct()
    w = [years_to_bars(x, cfg.periods_per_year) for x in (cfg.wf_train_years, cfg.wf_test_years, cfg.wf_step_years)]
    n = F.max("bar") + 1
    out = _judged(panel, F.floor(n * F.lit(float(cfg.train_test_ratio))), n, walk_forward(bars, *w), cfg, [n_trials], threshold)
    return out.withColumnsRenamed({f"dsr_{n_trials}": "dsr", f"z_{n_trials}": "z", f"retain_{n_trials}": "retain"})


@dataclass(frozen=True)
class Holdout:
    """What a hold-out is judged by."""

    mode: str = "forward"
    months: int = 12
    min_bars: int = 252
    threshold: float = DSR_THRESHOLD
    wf_bars: tuple[int, int, int] | None = None


def holdout_slice(weighted: DataFrame, how: Holdout, decision_date: str) -> DataFrame:
    """Rows strictly after the decision, or (retrospective) strictly after the last months' begin."""
    if how.mode == "forward":
        return after(weighted, decision_date)
    if how.mode == "retrospective":
        return last_months(weighted, how.months)
    raise ValueError(f"mode must be forward or retrospective: {how.mode!r}")


def holdout_verdict(weighted: DataFrame, cfg: Strategy, decision_date: str, n_trials: int, how: Holdout = Holdout()) -> DataFrame:
    """One row for the hold-out: n_bars and sufficient; if so, metrics and verdicts with one and with the carried number of trials.

    Fewer than two windows do not judge stability. Weights come from the whole history, the replay starts flat.
    """
    part = kept(rebased(_columns(holdout_slice(weighted, how, decision_date))), "verdict-panel")
    size = part.agg(F.count_distinct("bar").alias("n_bars")).withColumn("sufficient", F.col("n_bars") >= how.min_bars)
    w = how.wf_bars or [years_to_bars(x, cfg.periods_per_year) for x in (cfg.wf_train_years, cfg.wf_test_years, cfg.wf_step_years)]
    judged = _judged(part, F.lit(0), F.max("bar") + 1, walk_forward(part.select("dt", "bar").distinct(), *w), cfg, sorted({1, n_trials}), how.threshold, always_stable_under=2)
    return size.join(judged, F.col("sufficient"), "left")

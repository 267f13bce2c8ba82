"""The cost-aware backtest in closed form.

Lagged targets are known beforehand, so between two rebalances the book is bought and held: with the segment's
weights w0 and each asset's gross return G since the segment began, the book is worth V = 1 + sum(w0 (G - 1)), an asset's held
weight is w0 G / V, and the book that drifted to the next rebalance is that of the segment's last bar. No row depends on a
row before it but by running products.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import cadence_bucket, linear_cost
from quantloom.operators.panel import in_time, with_returns


#: A change of weight within this is one of the last bits of the running products, and no trade.
NO_TRADE = 1e-12


class Backtest(NamedTuple):
    """bars: equity, turnover, gross exposure and cost of each bar; held: weight of each bar and asset; trades: the ledger."""

    bars: DataFrame
    held: DataFrame
    trades: DataFrame


def rebalance_mask(dt: Column, cadence: str, window) -> Column:
    """True on the first bar and where a new period begins."""
    bucket = cadence_bucket(dt, cadence)
    before = F.lag(bucket).over(window)
    return before.isNull() | (bucket != before) if cadence != "daily" else F.lit(True)


def rebalances(panel: DataFrame, cadence: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., dt, bar, rebalance, segment) for each bar; segments count from 1."""
    bars = panel.select(*by, "dt", "bar").distinct()
    w = in_time(by, asset=False)
    bars = bars.withColumn("rebalance", rebalance_mask(F.col("dt"), cadence, w))
    return bars.withColumn("segment", F.sum(F.col("rebalance").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _book(panel: DataFrame, cadence: str, by: Sequence[str], bps: float | Column):
    """Per bar and asset: w0, gross return until the bar and until the bar before, and both values of the book."""
    clean = with_returns(panel, by).withColumn("r", F.coalesce("ret", F.lit(0.0)))
    lagged = clean.withColumn("want", F.coalesce(F.lag("target_w").over(in_time(by)), F.lit(0.0)))
    rows = lagged.join(rebalances(panel, cadence, by), [*by, "dt", "bar"])
    seg = Window.partitionBy(*by, "asset", "segment").orderBy("bar")
    upto = seg.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"w0": F.first("want").over(upto), "g": F.product(1 + F.col("r")).over(upto)})
    rows = rows.withColumn("gp", F.coalesce(F.lag("g").over(seg), F.lit(1.0)))
    # in order of assets, so that the last bits don't depend on how rows are dealt
    bar = Window.partitionBy(*by, "bar").orderBy("asset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"v": 1 + F.sum(F.col("w0") * (F.col("g") - 1)).over(bar), "vp": 1 + F.sum(F.col("w0") * (F.col("gp") - 1)).over(bar)})
    return rows.withColumns({"held": F.try_divide(F.col("w0") * F.col("gp"), F.col("vp")), "drifted": F.try_divide(F.col("w0") * F.col("g"), F.col("v"))})


def closed_form(panel: DataFrame, cadence: str, bps: float | Column, capital: float, by: Sequence[str] = ()) -> Backtest:
    """The backtest of panel (dt, bar, asset, px, target_w); see ``run_backtest``."""
    rows = _book(panel, cadence, by, bps)
    # the book just before a bar is the one that drifted over the bar before
    rows = rows.withColumn("before", F.coalesce(F.lag("drifted").over(in_time(by)), F.lit(0.0)))
    rows = rows.withColumn("delta", F.when(F.col("rebalance"), F.col("w0") - F.col("before")).otherwise(0.0))
    rate = bps * 1e-4 if isinstance(bps, Column) else F.lit(bps * 1e-4)
    order = Window.partitionBy(*by, "bar").orderBy("asset")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = rows.withColumns({"turnover": F.sum(F.abs("delta")).over(whole), "gross": F.sum(F.abs("held")).over(whole), "__at": F.row_number().over(order)})
    bars = one.where("__at = 1").select(*by, "dt", "bar", "rebalance", "turnover", "v", "vp", "gross")
    w = in_time(by, asset=False)
    growth = (1 - rate * F.col("turnover")) * F.try_divide(F.col("v"), F.col("vp"))
    bars = bars.withColumn("equity", capital * F.product(growth).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bars = bars.withColumns({"ret": F.try_divide(F.col("v"), F.col("vp")) - 1, "equity_before": F.coalesce(F.lag("equity").over(w), F.lit(float(capital)))})
    bars = bars.withColumn("cost", rate * F.col("turnover") * F.col("equity_before"))
    held = rows.select(*by, "dt", "bar", "asset", F.col("held").alias("w"))
    ledger = rows.where(F.abs("delta") > NO_TRADE).select(*by, "dt", "bar", "asset", F.col("delta").alias("delta_weight"))
    trades = ledger.join(bars.select(*by, "bar", "equity_before"), [*by, "bar"]).withColumn("cost", linear_cost(F.col("delta_weight"), bps) * F.col("equity_before"))
    return Backtest(bars.drop("v", "vp"), held, trades.drop("equity_before"))


def value_of_book(panel: DataFrame, cadence: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., least): the least value of a run's book relative to its segment's start. At 0 or below, the closed form doesn't hold."""
    return _book(panel, cadence, by, 0.0).groupBy(*by).agg(F.min("v").alias("least"))


def sequential(panel: DataFrame, cadence: str, bps: float, capital: float, by: Sequence[str]) -> DataFrame:
    """Bar by bar, for runs whose book is wiped out; rows of (by..., dt, bar, asset, w, equity, turnover, delta, ret, rebalance, equity_before).

    A group is one run's panel.
    """
    rate = bps * 1e-4
    rows = with_returns(panel, by).withColumn("r", F.coalesce("ret", F.lit(0.0))).join(rebalances(panel, cadence, by), [*by, "dt", "bar"])
    rows = rows.withColumn("want", F.coalesce(F.lag("target_w").over(in_time(by)), F.lit(0.0))).select(*by, "dt", "bar", "asset", "r", "want", "rebalance")
    schema = rows.select(*by, "dt", "bar", "asset").schema
    for name in ("w", "equity", "turnover", "delta", "ret", "equity_before"):
        schema = schema.add(name, "double")
    schema = schema.add("rebalance", "boolean")

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bar", "asset"])
        n = group["asset"].nunique()
        shape = (len(group) // n, n)
        r, want, trade = (group[c].to_numpy().reshape(shape) for c in ("r", "want", "rebalance"))
        book, equity = np.zeros(n), capital
        out = {k: np.zeros(shape) for k in ("w", "equity", "turnover", "delta", "ret", "equity_before")}
        for t in range(shape[0]):
            out["equity_before"][t] = equity
            if trade[t, 0]:
                out["delta"][t] = want[t] - book
                out["turnover"][t] = np.abs(out["delta"][t]).sum()
                book = want[t].copy()
            gain = float(book @ r[t])
            equity *= (1 - rate * out["turnover"][t, 0]) * (1 + gain)
            out["w"][t], out["equity"][t], out["ret"][t] = book, equity, gain
            if 1 + gain != 0:
                book = book * (1 + r[t]) / (1 + gain)
        return group[[*by, "dt", "bar", "asset"]].assign(**{k: v.ravel() for k, v in out.items()}, rebalance=trade.ravel())

    return rows.groupBy(*by).applyInPandas(along, schema)


def run_backtest(panel: DataFrame, cadence: str, bps: float = 0.0, capital: float = 1.0, by: Sequence[str] = (), wipeout: str = "ignore") -> Backtest:
    """Backtest panel (dt, bar, asset, px, target_w) at a cadence, with costs in basis points per side.

    Targets act one bar later, the first bar is flat. A gap earns nothing, nor does the jump after it. Cost is taken from the equity before
    the bar's return; the ledger's cost is on the equity before cost. ``wipeout="sequential"`` looks (one action) for
    runs whose book falls to nothing, where the closed form ends, and goes through these bar by bar.
    """
    if isinstance(bps, (int, float)) and bps < 0:
        raise ValueError(f"bps must not be negative: {bps}")
    if wipeout == "ignore":
        return closed_form(panel, cadence, bps, capital, by)
    one = not by
    if one:
        panel, by = panel.withColumn("__run", F.lit(0)), ["__run"]
    least = value_of_book(panel, cadence, by).where("least <= 0").select(*by)
    if least.isEmpty():
        done = closed_form(panel, cadence, bps, capital, by)
    else:
        good = closed_form(panel.join(least, [*by], "left_anti"), cadence, bps, capital, by)
        rows = sequential(panel.join(least, [*by], "left_semi"), cadence, bps, capital, by)
        gross = F.sum(F.abs("w")).over(Window.partitionBy(*by, "bar").orderBy("asset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        bars = rows.withColumn("gross", gross).select(*by, "dt", "bar", "rebalance", "turnover", "equity", "ret", "equity_before", "gross").distinct()
        bars = bars.withColumn("cost", F.col("turnover") * bps * 1e-4 * F.col("equity_before"))
        trades = rows.where(F.abs("delta") > NO_TRADE).select(*by, "bar", "dt", "asset", F.col("delta").alias("delta_weight"), (F.abs("delta") * bps * 1e-4 * F.col("equity_before")).alias("cost"))
        done = Backtest(good.bars.unionByName(bars), good.held.unionByName(rows.select(*by, "dt", "bar", "asset", "w")), good.trades.unionByName(trades))
    return Backtest(*(x.drop("__run") for x in done)) if one else done

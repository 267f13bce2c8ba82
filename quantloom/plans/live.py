"""Live planning as relations: the target book, orders, reconciliation and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalar import not_nan, truncate
from quantloom.operators.asof import asof_join, every_days
from quantloom.operators.panel import as_of

FLAT = 1e-6
TOLERANCE = 0.25


def target_book(weighted: DataFrame, day: str) -> DataFrame:
    """(symbol, target_w) of the last bar at or before a date. A date before all bars is an error when the book is read: an empty
    book would close all that is held."""
    found = as_of(weighted.select("dt", "asset", "target_w"), day).select(F.col("asset").alias("symbol"), "target_w")
    early = F.assert_true(F.col("first") <= F.lit(day).cast("date"), F.lit(f"no bar at or before {day}"))
    known = weighted.agg(F.min("dt").alias("first")).where(early.isNull())
    # one row, and a row for each asset
    return known.join(found, F.lit(True), "left").select("symbol", "target_w")


def prices_as_of(prices: DataFrame, runs: DataFrame) -> DataFrame:
    """(asof, asset, dt, px, bar_dt): for each run (asof, each once) every asset's last price at or before it, and the run's last bar with any price.

    Nothing after asof is seen; bars at the end without any price are no bars; gaps before are passed over, asset by asset. One plan for all runs. An asset without a
    price by then has a null; a run before all prices has no bar.
    """
    known = prices.select("dt", "asset", not_nan(F.col("px")).alias("px")).where("px IS NOT NULL")
    asked = runs.select("asof").distinct()
    each = asked.crossJoin(F.broadcast(prices.select("asset").where("asset IS NOT NULL").distinct()))
    found = asof_join(each, known, "asof", "dt", ["asset"])
    bars = found.groupBy("asof").agg(F.max("dt").alias("bar_dt"))
    return found.join(bars, "asof").select("asof", "asset", "dt", "px", "bar_dt")


def books_as_of(weighted: DataFrame, runs: DataFrame) -> DataFrame:
    """(asof, symbol, target_w, bar_dt): each run's target book, the weights of the last bar with any price at or before it. A run before all bars is an error."""
    bars = weighted.where("px IS NOT NULL").select(F.col("dt").alias("bar_dt")).distinct()
    at = asof_join(runs.select("asof").distinct(), bars, "asof", "bar_dt", bucket=every_days(36_500))
    early = F.concat(F.lit("no bar at or before "), F.col("asof").cast("string"))
    at = at.where(F.when(F.col("bar_dt").isNotNull(), F.lit(True)).otherwise(F.raise_error(early).cast("boolean")))
    book = weighted.select(F.col("dt").alias("bar_dt"), F.col("asset").alias("symbol"), "target_w")
    return book.join(F.broadcast(at), "bar_dt").select("asof", "symbol", "target_w", "bar_dt")


def _union(target: DataFrame, positions: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    keys = [*by, "symbol"]
    t = target.select(*keys, F.coalesce(F.nanvl(F.col("target_w"), F.lit(0.0)), F.lit(0.0)).alias("target_w"))
    both = t.join(positions, keys, "full").join(prices.select(*keys, "px"), keys, "left")
    return both.withColumn("target_w", F.coalesce("target_w", F.lit(0.0)))


def _per_run(rows: DataFrame, equity: float | DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with equity: one number, or a table of one for each run."""
    return rows.join(F.broadcast(equity.select(*by, "equity")), [*by]) if isinstance(equity, DataFrame) else rows.withColumn("equity", F.lit(float(equity)))


def plan_orders(target: DataFrame, positions: DataFrame, prices: DataFrame, equity: float | DataFrame, min_notional: float = 0.0, fractional: bool = False, max_gross: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Orders that take positions (symbol, qty) to target (symbol, target_w), at prices (symbol, px); in order of symbol.

    Symbols without a positive price, changes under ``min_notional`` and whole quantities of 0 are left out. A target of more gross
    exposure than ``max_gross`` fails. With ``by`` all tables have these columns, too, and so has equity, a table: every run is planned at once.
    """
    if max_gross is not None:
        gross = target.groupBy(*by).agg(F.sum(F.abs("target_w")).alias("g")).select(*by, F.assert_true(F.coalesce("g", F.lit(0.0)) <= max_gross + 1e-9, "the target's gross exposure exceeds the cap").alias("ok"), F.lit(1).alias("one"))
        target = (target.join(F.broadcast(gross), [*by]) if by else target.crossJoin(F.broadcast(gross))).where("ok IS NULL").drop("ok", "one")
    rows = _per_run(_union(target, positions.select(*by, "symbol", "qty"), prices, by), equity, by).withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    rows = rows.where((F.col("px") > 0) & ~F.isnan("px") & (F.col("px") < float("inf")))
    held, money = F.col("qty") * F.col("px"), F.col("equity")
    rows = rows.withColumns({"current_weight": F.when(money > 0, F.try_divide(held, money)).otherwise(0.0), "change": F.col("target_w") * money - held})
    rows = rows.where(F.abs("change") >= min_notional)
    delta = F.try_divide(F.col("change"), F.col("px"))
    rows = rows.withColumn("delta", delta if fractional else truncate(delta)).where("delta <> 0")
    return rows.select(
        *by,
        "symbol",
        F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"),
        F.abs("delta").alias("qty"),
        F.col("px").alias("est_price"),
        (F.abs("delta") * F.col("px")).alias("notional"),
        F.col("target_w").alias("target_weight"),
        "current_weight",
        F.when((F.col("target_w") == 0) & (F.col("qty") != 0), "close").otherwise("rebalance").alias("reason"),
    ).orderBy(*by, "symbol")


def plan_summary(orders: DataFrame, target: DataFrame, bps: float) -> DataFrame:
    """One row: n_orders, buy and sell notional, gross notional, est_cost and target_gross."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("notional"))), F.lit(0.0))
    o = orders.agg(F.count("*").alias("n_orders"), side("buy").alias("buy_notional"), side("sell").alias("sell_notional"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("gross_notional"))
    t = target.agg(F.coalesce(F.sum(F.abs("target_w")), F.lit(0.0)).alias("target_gross"))
    return o.withColumn("est_cost", F.col("gross_notional") * (bps * 1e-4)).crossJoin(t)


def reconcile(target: DataFrame, positions: DataFrame, prices: DataFrame, equity: float | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(symbol, target_weight, current_weight, deviation) of all targets and positions; without a price a position's market_value counts. With ``by`` for each run."""
    rows = _per_run(_union(target, positions.select(*by, "symbol", "qty", "market_value"), prices, by), equity, by)
    value = F.when((F.col("px") > 0) & ~F.isnan("px"), F.col("qty") * F.col("px")).otherwise(F.col("market_value"))
    current = F.when(F.col("equity") > 0, F.coalesce(F.try_divide(value, F.col("equity")), F.lit(0.0))).otherwise(0.0)
    return rows.select(*by, "symbol", F.col("target_w").alias("target_weight"), current.alias("current_weight"), (F.col("target_w") - current).alias("deviation"))


def reconcile_summary(book: DataFrame, tolerance: float = TOLERANCE, by: Sequence[str] = ()) -> DataFrame:
    """One row (for each run): l1, max_deviation, gross exposures and the flags flat (but meant to be invested), off_target and anomaly."""
    if tolerance <= 0:
        raise ValueError(f"tolerance must be positive: {tolerance}")
    zero = F.lit(0.0)
    s = lambda c: F.coalesce(F.sum(F.abs(c)), zero)
    out = book.groupBy(*by).agg(s("deviation").alias("l1"), F.coalesce(F.max(F.abs("deviation")), zero).alias("max_deviation"), s("target_weight").alias("target_gross"), s("current_weight").alias("current_gross"))
    out = out.withColumns({"flat": (F.col("current_gross") <= FLAT) & (F.col("target_gross") > tolerance), "off_target": F.col("l1") > tolerance})
    return out.withColumn("anomaly", F.col("flat") | F.col("off_target"))


def without_order(target: DataFrame, orders: DataFrame) -> DataFrame:
    """Targeted symbols that no order is for."""
    return target.where(F.abs("target_w") > 1e-9).join(orders.select("symbol"), "symbol", "left_anti")


def freshness(panel: DataFrame, day: str, max_stale_days: int) -> DataFrame:
    """One row: last bar's date, age_days and stale (also where there is no bar)."""
    out = panel.agg(F.max("dt").alias("last_dt")).withColumn("age_days", F.datediff(F.lit(day).cast("date"), "last_dt"))
    return out.withColumn("stale", F.coalesce(F.col("age_days") > max_stale_days, F.lit(True)))


def data_gate(source: str, stale: bool, live: bool, allow_synthetic: bool = False) -> str:
    """ok, warn (dry run) or refuse (live)."""
    bad = stale or (source == "synthetic" and not allow_synthetic)
    return "ok" if not bad else "refuse" if live else "warn"


def drift_gate(recorded_hash: str | None, current_hash: str, live: bool) -> str:
    """The same for a strategy that isn't the recorded one."""
    bad = recorded_hash is not None and recorded_hash != current_hash
    return "ok" if not bad else "refuse" if live else "warn"


def submits(last_key: str | None, key: str, force: bool = False) -> bool:
    """One submission per period."""
    return force or last_key != key


def escalates(skipped: bool, anomaly: bool, against_submitted: bool, flat: bool) -> bool:
    """Whether a skipped run's book calls for an alert."""
    return skipped and anomaly and (against_submitted or flat)


def order_preview(orders: Sequence, width: int = 10) -> str:
    """Orders as lines of text."""
    return "\n".join(f"{o['side']:<5}{o['symbol']:<{width}}{o['qty']:>14,.4f} @ {o['est_price']:>12,.2f} = {o['notional']:>14,.2f}  {o['reason']}" for o in orders) or "no orders"

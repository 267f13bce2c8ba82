"""Price panels in long form: (keys..., dt, bar, asset, px), complete over calendar and assets.

``by`` names further key columns, such as run_id: every operator works on all runs at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions.scalar import not_nan, simple_return
from quantloom.operators.guards import one_of_each


def in_time(by: Sequence[str] = (), asset: bool = True) -> WindowSpec:
    keys = [*by, *(["asset"] if asset else [])]
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bar")


def until_now(by: Sequence[str] = (), asset: bool = True) -> WindowSpec:
    return in_time(by, asset).rowsBetween(Window.unboundedPreceding, 0)


def calendar(prices: DataFrame) -> DataFrame:
    """dt and its ordinal bar, from 0; one row per date."""
    return prices.select("dt").where("dt IS NOT NULL").distinct().withColumn("bar", F.row_number().over(Window.orderBy("dt")) - 1)


def complete_grid(prices: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row for each date and asset, px null where there is no price. A (dt, asset) that prices have twice ends the query with the number of its rows.

    Offsets of bars mean rows only once every asset has all bars. ``assets`` (a column asset) sets the assets, also such
    without prices.
    """
    named = prices.select("asset").where("asset IS NOT NULL").distinct() if assets is None else assets.select("asset").distinct()
    grid = calendar(prices).crossJoin(named)
    cells = one_of_each(prices.where("dt IS NOT NULL AND asset IS NOT NULL").select("dt", "asset", not_nan(F.col("px")).alias("px")), ["dt", "asset"], "px")
    return grid.join(cells, ["dt", "asset"], "left").select("dt", "bar", "asset", "px")


def with_returns(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """panel with ret, the return over one bar; null where either price is a gap."""
    return panel.withColumn("ret", simple_return(F.col("px"), F.lag("px").over(in_time(by))))


def clip(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included."""
    if start:
        panel = panel.where(F.col("dt") >= F.lit(start).cast("date"))
    return panel.where(F.col("dt") <= F.lit(end).cast("date")) if end else panel


def rebased(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """panel with bars counted from 0 in each run."""
    return panel.withColumn("bar", F.col("bar") - F.min("bar").over(Window.partitionBy(*(by or [F.lit(0)]))))


def trim_trailing_gaps(panel: DataFrame) -> DataFrame:
    """panel without the bars after the last one that has any price."""
    last = panel.where("px IS NOT NULL").agg(F.max("bar").alias("__last"))
    return panel.join(F.broadcast(last), F.col("bar") <= F.col("__last")).drop("__last")


def last_prices(panel: DataFrame) -> DataFrame:
    """Each asset's last known price; null for one without any."""
    known = F.max_by(F.when(F.col("px").isNotNull(), F.col("px")), F.when(F.col("px").isNotNull(), F.col("bar")))
    return panel.groupBy("asset").agg(known.alias("px"))


def after(panel: DataFrame, day: str) -> DataFrame:
    """Rows strictly after a date."""
    return panel.where(F.col("dt") > F.lit(day).cast("date"))


def last_months(panel: DataFrame, months: int) -> DataFrame:
    """Rows strictly after the last date less so many months."""
    end = panel.agg(F.max("dt").alias("__end"))
    return panel.join(F.broadcast(end), F.col("dt") > F.add_months("__end", -months)).drop("__end")


def as_of(rows: DataFrame, day: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """The last rows at or before a date, by key."""
    value = F.struct(*(F.col(c) for c in rows.columns if c not in keys))
    found = rows.where(F.col("dt") <= F.lit(day).cast("date")).groupBy(*keys).agg(F.max_by(value, "dt").alias("__row"))
    return found.select(*keys, "__row.*")


def exposures(weights: DataFrame, w: str = "w", by: Sequence[str] = ()) -> DataFrame:
    """Gross and net exposure of each bar."""
    return weights.groupBy(*by, "dt", "bar").agg(F.sum(F.abs(F.col(w))).alias("gross"), F.sum(w).alias("net"))


def usability(panel: DataFrame, lookbacks: Sequence[int], vol_window: int, universe: Sequence[str]) -> DataFrame:
    """One row: n_bars, n_assets with prices among the universe, and usable: enough bars and any asset."""
    need = max(lookbacks) + vol_window + 5
    found = panel.agg(F.count_distinct("dt").alias("n_bars"), F.count_distinct(F.when(F.col("px").isNotNull() & F.col("asset").isin(*universe), F.col("asset"))).alias("n_assets"))
    return found.withColumn("usable", (F.col("n_bars") >= need) & (F.col("n_assets") > 0))

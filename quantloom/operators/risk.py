"""Exponentially weighted risk and volatility-targeted weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.config import Strategy

#: Largest exponent of e that the growing weights of the running sums may reach.
MAX_EXPONENT = 690.0


def decay(com: float) -> float:
    if com <= 0:
        raise ValueError(f"com must be positive: {com}")
    return com / (1.0 + com)


def fits(com: float, n_bars: int) -> bool:
    """Whether weights that grow over so many bars stay within a double."""
    return -2.0 * n_bars * math.log(decay(com)) < MAX_EXPONENT


def ewm_cov(panel: DataFrame, x: str, y: str, com: float, keys: Sequence[str], to: str) -> DataFrame:
    """panel with ``to``: the unbiased exponentially weighted covariance of what both columns know up to the row; null under two values.

    Weights decay^(-bar) cancel but for their ratio, so plain running sums do. They are taken in blocks of bars over which the weights grow
    by e^300 at most; the block before comes in by its sums, scaled down, and what is older no longer counts in a double. So histories of any
    length work. Gaps carry the estimate on.
    """
    block = max(1, int(-300.0 / math.log(decay(com))))
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    w = F.when(both, F.pow(F.lit(decay(com)), -F.pmod(F.col("bar"), F.lit(block)).cast("double")))
    rows = panel.withColumns({"__block": F.floor(F.col("bar") / block).cast("long"), "__w": w})
    inside = Window.partitionBy(*keys, "__block").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    w, cx, cy = F.col("__w"), F.col(x), F.col(y)
    sums = {"n": F.count(w), "s0": F.sum(w), "s2": F.sum(w * w), "sx": F.sum(w * cx), "sy": F.sum(w * cy), "sxy": F.sum(w * cx * cy)}
    rows = rows.withColumn("__run", F.when(w.isNotNull(), F.struct("bar", "__block", *(f.over(inside).alias(k) for k, f in sums.items()))))
    earlier = Window.partitionBy(*keys).orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__old", F.max("__run").over(earlier))
    down = F.pow(F.lit(decay(com) ** block), F.col("__block") - F.col("__old.__block"))

    def total(name: str, power: int = 1) -> Column:
        return F.col(f"__run.{name}") + F.coalesce(F.col(f"__old.{name}") * F.pow(down, F.lit(power)), F.lit(0.0))

    s0, s2 = total("s0"), total("s2", 2)
    cov = F.try_divide(total("sxy"), s0) - F.try_divide(total("sx"), s0) * F.try_divide(total("sy"), s0)
    several = (F.col("__run.n") >= 2) | F.col("__old").isNotNull()
    now = F.when(several & (s0 * s0 > s2), cov * F.try_divide(s0 * s0, s0 * s0 - s2))
    upto = Window.partitionBy(*keys).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("__run").isNotNull(), F.struct(now.alias("v"))), ignorenulls=True).over(upto)
    return rows.withColumn(to, known["v"]).drop("__block", "__w", "__run", "__old")


def with_volatility(panel: DataFrame, com: float, periods_per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """panel (with ret) with sigma, the annualised exponentially weighted volatility; null under two returns."""
    out = ewm_cov(panel, "ret", "ret", com, [*by, "asset"], "__var")
    v = F.col("__var")
    return out.withColumn("sigma", F.sqrt(F.when(v < 0, 0.0).otherwise(v) * periods_per_year)).drop("__var")


def covariance(panel: DataFrame, com: float, periods_per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., dt, bar, asset_i, asset_j, cov) for asset_i <= asset_j: annualised, pairwise complete.

    The output has a row per bar and pair by its nature; it is only ever summed, never pivoted.
    """
    keys = [*by, "dt", "bar"]
    a = panel.select(*keys, F.col("asset").alias("asset_i"), F.col("ret").alias("ret_i"))
    b = panel.select(*keys, F.col("asset").alias("asset_j"), F.col("ret").alias("ret_j"))
    pairs = a.join(b, keys).where("asset_i <= asset_j")
    found = ewm_cov(pairs, "ret_i", "ret_j", com, [*by, "asset_i", "asset_j"], "cov")
    return found.select(*keys, "asset_i", "asset_j", (F.col("cov") * periods_per_year).alias("cov"))


def covariance_long(panel: DataFrame, com: float, periods_per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """The same by pandas' own recursion, one pair's history at a time: what the running sums are held against."""
    keys = [*by, "dt", "bar"]
    a = panel.select(*keys, F.col("asset").alias("asset_i"), F.col("ret").alias("ret_i"))
    b = panel.select(*keys, F.col("asset").alias("asset_j"), F.col("ret").alias("ret_j"))
    pairs = a.join(b, keys).where("asset_i <= asset_j")
    schema = pairs.drop("ret_i", "ret_j").schema.add("cov", "double")

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bar")
        x, y = group["ret_i"].astype(float), group["ret_j"].astype(float)
        known = x.notna() & y.notna()
        cov = x.where(known).ewm(com=com, min_periods=2).cov(y.where(known)) * periods_per_year
        return group.drop(columns=["ret_i", "ret_j"]).assign(cov=cov)

    return pairs.groupBy(*by, "asset_i", "asset_j").applyInPandas(along, schema)


def portfolio_variance(weights: DataFrame, cov: DataFrame, w: str = "raw", by: Sequence[str] = ()) -> DataFrame:
    """(by..., bar, variance): w' cov w over the assets with a weight; null where a covariance between two of them is unknown."""
    keys = [*by, "bar"]
    held = weights.where(F.col(w) != 0).select(*keys, "asset", F.col(w).alias("w"))
    i = held.select(*keys, F.col("asset").alias("asset_i"), F.col("w").alias("w_i"))
    j = held.select(*keys, F.col("asset").alias("asset_j"), F.col("w").alias("w_j"))
    terms = cov.join(i, [*keys, "asset_i"]).join(j, [*keys, "asset_j"])
    twice = F.when(F.col("asset_i") == F.col("asset_j"), 1.0).otherwise(2.0)
    # in order of the pairs, so that the last bits don't depend on how rows are dealt
    order = Window.partitionBy(*keys).orderBy("asset_i", "asset_j")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = terms.select(*keys, F.row_number().over(order).alias("__at"), F.sum(twice * F.col("w_i") * F.col("w_j") * F.col("cov")).over(whole).alias("v"), F.count_if(F.col("cov").isNull()).over(whole).alias("unknown"))
    return total.where("__at = 1").select(*keys, F.when(F.col("unknown") == 0, F.col("v")).alias("variance"))


def raw_weights(panel: DataFrame, cfg: Strategy, by: Sequence[str] = ()) -> DataFrame:
    """panel (with signal and ret) with sigma and raw, signal times target over volatility; 0 where either is unusable."""
    out = with_volatility(panel, float(cfg.vol_window), float(cfg.periods_per_year), by)
    good = F.col("signal").isNotNull() & (F.col("signal") != 0) & (F.col("sigma") > 0) & ~F.isnan("sigma")
    return out.withColumn("raw", F.when(good, F.col("signal") * F.try_divide(F.lit(float(cfg.asset_vol_target)), F.col("sigma"))).otherwise(0.0))


def target_weights(panel: DataFrame, cfg: Strategy, by: Sequence[str] = ()) -> DataFrame:
    """panel (with signal and ret) with target_w, never null: volatility targeted, scaled to the portfolio's target, Kelly, capped."""
    keys = [*by, "bar"]
    raw = raw_weights(panel, cfg, by)
    var = portfolio_variance(raw, covariance(panel, float(cfg.vol_window), float(cfg.periods_per_year), by), "raw", by)
    good = (F.col("variance") > 0) & ~F.isnan("variance")
    k = F.when(good, F.try_divide(F.lit(float(cfg.portfolio_vol_target)), F.sqrt("variance"))).otherwise(1.0)
    scaled = raw.join(var, keys, "left").withColumn("scaled", F.col("raw") * k * float(cfg.kelly_fraction))
    # in order of assets, so that the last bits don't depend on how rows are dealt
    gross = F.sum(F.abs("scaled")).over(Window.partitionBy(*keys).orderBy("asset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cap = F.lit(float(cfg.max_gross_leverage))
    return scaled.withColumn("target_w", F.col("scaled") * F.when(gross > cap, cap / gross).otherwise(1.0)).drop("scaled", "variance")

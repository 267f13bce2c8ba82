"""Performance of equity curves, one row per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import not_nan, simple_return
from quantloom.operators.panel import in_time, until_now

#: A dispersion below this is none: sums in another order leave as much.
TINY = 1e-14
INF = float("inf")


def equity_returns(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with r, the return of equity over one bar; null on the first bar."""
    return bars.withColumn("r", not_nan(simple_return(F.col("equity"), F.lag("equity").over(in_time(by, asset=False)))))


def drawdowns(bars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bars with drawdown (from the running maximum) and below, the number of bars of its unbroken run under the maximum."""
    now = until_now(by, asset=False)
    out = bars.withColumn("drawdown", F.try_divide(F.col("equity"), F.max("equity").over(now)) - 1)
    out = out.withColumn("__island", F.sum((F.col("drawdown") >= 0).cast("int")).over(now))
    return out.withColumn("below", F.sum((F.col("drawdown") < 0).cast("long")).over(Window.partitionBy(*by, "__island"))).drop("__island")


def performance(bars: DataFrame, periods_per_year: float, by: Sequence[str] = ()) -> DataFrame:
    """All scalar metrics of each run from bars (bar, dt, equity, turnover; gross exposure and cost where they are known).

    One pass over the bars. Undefined values are null; ratios without a loss or a drawdown are infinite.
    """
    ppy = float(periods_per_year)
    rows = drawdowns(equity_returns(bars, by), by)
    r = F.col("r")
    got = rows.groupBy(*by).agg(
        F.count("*").alias("n_periods"),
        F.min("dt").alias("start"),
        F.max("dt").alias("end"),
        F.min_by("equity", "bar").alias("first_equity"),
        F.max_by("equity", "bar").alias("final_equity"),
        F.count("r").alias("n"),
        F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("sd"),
        F.sqrt(F.avg(F.when(r < 0, r * r))).alias("downside"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("gains"),
        F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0)).alias("losses"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.min("drawdown").alias("max_drawdown"),
        F.max(F.when(F.col("drawdown") < 0, F.col("below")).otherwise(0)).alias("max_drawdown_duration"),
        (F.avg("turnover") * ppy).alias("annual_turnover"),
        *([F.avg("gross").alias("avg_exposure")] if "gross" in bars.columns else []),
        *([F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost")] if "cost" in bars.columns else []),
    )
    ok = F.col("n") >= 2
    sd = F.when(F.col("sd") > TINY, F.col("sd"))
    cagr = F.when((F.col("n_periods") >= 2) & (F.col("first_equity") > 0) & (F.col("final_equity") > 0), F.pow(F.try_divide(F.col("final_equity"), F.col("first_equity")), F.try_divide(F.lit(ppy), F.col("n_periods") - 1)) - 1)
    got = got.withColumns(
        {
            "cagr": cagr,
            "annual_vol": F.when(ok, F.coalesce(sd, F.lit(0.0)) * F.sqrt(F.lit(ppy))),
            "sharpe": F.when(ok, F.try_divide(F.col("mean"), sd) * F.sqrt(F.lit(ppy))),
            "sortino": F.when(ok, F.try_divide(F.col("mean"), F.col("downside")) * F.sqrt(F.lit(ppy))),
            "profit_factor": F.when(F.col("losses") > 0, F.try_divide(F.col("gains"), F.col("losses"))).when(F.col("gains") > 0, INF),
        }
    )
    calmar = F.when(F.col("max_drawdown") < 0, F.try_divide(F.col("cagr"), F.abs("max_drawdown"))).when(F.col("cagr") > 0, INF)
    return got.withColumn("calmar", calmar).withColumn("mar", F.col("calmar")).drop("gains", "losses", "downside", "sd", "mean", "n", "first_equity")


def attribution(bars: DataFrame, held: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., asset, pnl): each bar's change of equity, split by the signed exposures held into the bar.

    A bar without exposure (a sum within 1e-12 of 0) is given to no asset.
    """
    w = in_time(by, asset=False)
    eq = bars.select(*by, "bar", F.lag("equity").over(w).alias("eq0"), (F.col("equity") - F.lag("equity").over(w)).alias("gain"))
    rows = held.select(*by, "bar", "asset", F.lag("w").over(in_time(by)).alias("w0")).join(eq, [*by, "bar"]).where("eq0 IS NOT NULL")
    rows = rows.withColumn("dollars", F.col("w0") * F.col("eq0"))
    total = F.sum("dollars").over(Window.partitionBy(*by, "bar").orderBy("asset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("part", F.when(F.abs(total) > 1e-12, F.try_divide(F.col("dollars"), total) * F.col("gain")).otherwise(0.0))
    return rows.groupBy(*by, "asset").agg(F.sum(F.coalesce(not_nan(F.col("part")), F.lit(0.0))).alias("pnl"))

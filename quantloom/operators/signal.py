"""Time-series momentum over several horizons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.scalar import simple_return
from quantloom.operators.panel import in_time


def momentum(panel: DataFrame, lookbacks: Sequence[int], direction: str = "long_short", by: Sequence[str] = ()) -> DataFrame:
    """panel with signal: the mean sign of the returns over all lookbacks, null unless all are known.

    ``long_only`` keeps the positive part; gaps stay gaps.
    """
    if not lookbacks or min(lookbacks) < 1:
        raise ValueError(f"lookbacks must be positive: {lookbacks}")
    if direction not in ("long_short", "long_only"):
        raise ValueError(f"direction must be long_short or long_only: {direction!r}")
    signs = [F.signum(simple_return(F.col("px"), F.lag("px", n).over(in_time(by)))) for n in lookbacks]
    mean = reduce(lambda a, b: a + b, signs) / F.lit(float(len(signs)))
    out = panel.withColumn("signal", mean)
    if direction == "long_only":
        out = out.withColumn("signal", F.when(F.col("signal") < 0, 0.0).otherwise(F.col("signal")))
    return out

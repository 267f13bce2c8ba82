"""Validation splits as rows: locked split, walk-forward windows, purged folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def locked_split(bars: DataFrame, ratio: float) -> DataFrame:
    """bars with role train or test: the first floor(n * ratio) bars train."""
    n = bars.agg(F.count("*").alias("__n"))
    return bars.crossJoin(F.broadcast(n)).withColumn("role", F.when(F.col("bar") < F.floor(F.col("__n") * F.lit(float(ratio))), "train").otherwise("test")).drop("__n")


def years_to_bars(years: float, periods_per_year: float) -> int:
    return int(round(years * periods_per_year))


def walk_forward(bars: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(fold, role, lo, hi): rolling windows of bars [lo, hi), complete ones only; the test follows its training at once."""
    if min(train, test, step) < 1:
        raise ValueError(f"train, test and step must be positive: {train}, {test}, {step}")
    n = bars.agg((F.max("bar") + 1).alias("n"))
    room = (F.col("n") - train - test).cast("int")
    starts = n.select(F.explode(F.when(room >= 0, F.sequence(F.lit(0), room, F.lit(step)))).alias("at"))
    starts = starts.withColumn("fold", F.floor(F.col("at") / step).cast("int"))
    part = F.explode(F.array(F.struct(F.lit("train").alias("role"), F.col("at").alias("lo"), (F.col("at") + train).alias("hi")), F.struct(F.lit("test").alias("role"), (F.col("at") + train).alias("lo"), (F.col("at") + train + test).alias("hi"))))
    return starts.select("fold", part.alias("x")).select("fold", "x.role", "x.lo", "x.hi")


def in_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows of each window, with its fold; a few windows against all bars."""
    return rows.join(F.broadcast(windows.select("fold", "lo", "hi")), (F.col("bar") >= F.col("lo")) & (F.col("bar") < F.col("hi")))


def out_of_sample(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """The bars of any test window, once each."""
    return in_windows(bars, windows.where("role = 'test'")).select(*bars.columns).distinct()


def purged_folds(bars: DataFrame, n_splits: int, horizon: int, embargo: float) -> DataFrame:
    """(fold, pos, is_test, is_purged, is_embargoed, is_train) for each bar and fold.

    Folds are runs of near-equal length. Bars whose horizon touches the test run are purged, those in the share after it embargoed; both may be
    true. The rest train.
    """
    if n_splits < 2 or horizon < 0 or not 0 <= embargo < 1:
        raise ValueError(f"n_splits, horizon, embargo: {n_splits}, {horizon}, {embargo}")
    pos = bars.select(F.col("bar").alias("pos")).distinct()
    folds = pos.withColumn("f", F.ntile(n_splits).over(Window.orderBy("pos")) - 1)
    spans = folds.groupBy("f").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).select(F.col("f").alias("fold"), "lo", "hi")
    total = pos.agg(F.count("*").alias("n"))
    rows = pos.crossJoin(F.broadcast(spans)).crossJoin(F.broadcast(total))
    p, h = F.col("pos"), F.lit(horizon)
    test = p.between(F.col("lo"), F.col("hi"))
    purged = ~test & (p + h >= F.col("lo")) & (p - h <= F.col("hi"))
    late = ~test & (p > F.col("hi")) & (p <= F.col("hi") + F.bround(F.lit(float(embargo)) * F.col("n"), 0))
    return rows.select("fold", "pos", test.alias("is_test"), purged.alias("is_purged"), late.alias("is_embargoed"), (~test & ~purged & ~late).alias("is_train"))

"""As-of joins of two tables: each row meets the last row of the other table at or before its time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 365


def every_days(days: int) -> Callable[[Column], Column]:
    """The number of the run of so many days, counted from 1970, that a date or timestamp is in."""
    if days < 1:
        raise ValueError(f"days must be positive: {days}")
    return lambda t: F.floor(F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")) / days)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[str] = (),
    how: str = "left",
    exact: bool = True,
    within_days: int | None = None,
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """left's columns and, of the last right row with the same keys at or before left's time, right's other columns.

    ``exact=False`` asks for a row strictly before; ``within_days`` for one that is no older; ``how`` is left (rows without a match keep nulls) or inner.
    Of right rows at one time the greatest by its other columns, in order, counts. Rows with a null time or key match nothing; left rows
    that repeat stay. Names that both sides have, but for the keys, are an error.

    No row is compared with rows of the other side: both are put in one order and a running last value is taken. A key's times are cut into runs
    (``bucket``, a function that grows with time, a year by default) that are sorted side by side, so that a long key is no single task; each
    run begins with the last right row of the runs before, found from one row for each key and run.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner: {how!r}")
    taken = [c for c in right.columns if c not in by]
    if both := sorted(set(left.columns) & set(taken)):
        raise ValueError(f"both sides have {both}; rename them on one")
    keys = [f"__k{i}" for i in range(len(by))]
    bucket = bucket or every_days(BUCKET_DAYS)
    key = lambda df: {k: df[c] for k, c in zip(keys, by, strict=True)}

    def known(df: DataFrame, time: str) -> Column:
        ok = df[time].isNotNull()
        for c in by:
            ok = ok & df[c].isNotNull()
        return ok

    value = F.struct(*(right[c].alias(f"v{i}") for i, c in enumerate(taken)))
    r = right.where(known(right, right_time)).select(*(v.alias(k) for k, v in key(right).items()), right[right_time].alias("__t"), value.alias("__r")).withColumn("__b", bucket(F.col("__t")))
    row = F.struct(*(left[c].alias(f"v{i}") for i, c in enumerate(left.columns)))
    parts = left.select(*(v.alias(k) for k, v in key(left).items()), left[left_time].alias("__t"), row.alias("__l"), known(left, left_time).alias("__ok"))
    # rows that can match nothing are dealt by their content
    parts = parts.withColumn("__b", F.when(F.col("__ok"), bucket(F.col("__t"))).otherwise(F.xxhash64("__l")))
    last = r.groupBy(*keys, "__b").agg(F.max(F.struct("__t", "__r")).alias("__last"))
    runs = last.unionByName(parts.where("__ok").select(*keys, "__b").distinct(), allowMissingColumns=True).groupBy(*keys, "__b").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("__last", F.last("__last", ignorenulls=True).over(before)).where("__last IS NOT NULL").select(*keys, "__b", F.col("__last.__t").alias("__t"), F.col("__last.__r").alias("__r"))
    rows = parts.drop("__ok").unionByName(r, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    is_left = F.col("__l").isNotNull()
    order = [F.col("__t"), (is_left if exact else ~is_left), F.col("__r")]
    until = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__r").isNotNull(), F.struct("__t", "__r")), ignorenulls=True).over(until)
    out = rows.withColumn("__f", found).where(is_left)
    ok = F.col("__t").isNotNull() & F.col("__f").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if within_days is not None:
        ok = ok & (F.datediff(F.col("__t").cast("date"), F.col("__f.__t").cast("date")) <= within_days)
    if how == "inner":
        out = out.where(ok)
    mine = [F.col(f"__l.v{i}").alias(c) for i, c in enumerate(left.columns)]
    return out.select(*mine, *(F.when(ok, F.col(f"__f.__r.v{i}")).alias(c) for i, c in enumerate(taken)))

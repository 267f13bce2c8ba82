"""Guards on inputs, counted and asserted in the pass that reads the rows anyway."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

INF = float("inf")


class BadInput(ValueError):
    """Rows that an operator can't take; the message has each fault and how many rows have it."""


def _number(c: str) -> Column:
    return F.col(c).cast("double")


def _infinite(c: str) -> Column:
    return F.abs(_number(c)) == INF


def price_faults(px: str = "px") -> dict[str, Column]:
    """Of long prices: rows without a date or asset, prices at or below 0, infinite ones. NaN and null are gaps."""
    return {
        "rows without a date": F.col("dt").isNull(),
        "rows without an asset": F.col("asset").isNull(),
        "prices at or below 0": (_number(px) <= 0) & ~F.isnan(_number(px)),
        "infinite prices": (_number(px) == INF),
    }


def return_faults(ret: str = "ret") -> dict[str, Column]:
    return {"returns below -1": (_number(ret) < -1) & (_number(ret) > -INF), "infinite returns": _infinite(ret)}


def weight_faults(w: str = "target_w") -> dict[str, Column]:
    return {"infinite weights": _infinite(w)}


def performance_faults(d: str = "d") -> dict[str, Column]:
    """Of a performance matrix every cell must be a finite number."""
    return {"performances that are no finite number": F.coalesce(F.isnan(_number(d)) | _infinite(d), F.lit(True))}


class Guard:
    """Counts the faults of the rows that pass it.

    ``watched`` adds nothing but running counts to the plan of its rows; ``check``, after an action on them, raises ``BadInput`` if
    there was any. ``stopped`` ends the action itself at the first faulty row.
    """

    def __init__(self, faults: Mapping[str, Column], name: str = "input"):
        self.faults, self.name = dict(faults), name
        self._seen: Observation | None = None

    def watched(self, rows: DataFrame) -> DataFrame:
        self._seen = Observation()
        counts = [F.count_if(F.coalesce(f, F.lit(False))).alias(k) for k, f in self.faults.items()]
        return rows.observe(self._seen, F.count(F.lit(1)).alias("rows"), *counts)

    def counts(self) -> dict[str, int]:
        """Rows and faults of the action that has read the watched rows."""
        if self._seen is None:
            raise RuntimeError("nothing is watched")
        return dict(self._seen.get)

    def check(self) -> int:
        """How many rows passed, all without a fault."""
        found = self.counts()
        bad = {k: n for k, n in found.items() if k != "rows" and n}
        if bad:
            raise BadInput(f"{self.name}: " + ", ".join(f"{n} {k}" for k, n in bad.items()))
        return found["rows"]

    def stopped(self, rows: DataFrame) -> DataFrame:
        """rows, of which a faulty one ends the query that reads it."""
        said = F.coalesce(*(F.when(f, F.lit(f"{self.name}: {k}")) for k, f in self.faults.items()))
        return rows.where(F.when(said.isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def one_of_each(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value) of rows with different keys; a repeated key ends the query with its number of rows.

    A grouping by the keys that the join behind it needs as well; it reads nothing more.
    """
    got = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(value).alias(value))
    said = F.concat(F.col("__n").cast("string"), F.lit(" rows of "), F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))
    return got.select(*keys, F.when(F.col("__n") == 1, F.col(value)).otherwise(F.raise_error(said).cast(got.schema[value].dataType)).alias(value))

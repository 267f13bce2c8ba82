"""Panels that grow batch by batch: late rows are kept aside, phantom bars withheld, and a hold-out is judged once it is long enough.

Each batch's tables and marks are written under its number and read from the number before, so that a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.panel import complete_grid
from quantloom.plans.validate import Holdout, holdout_verdict, strategy_weights
from quantloom.sources.config import Strategy
from quantloom.sources.records import plain
from quantloom.sources.store import Conflict, Store, as_json

PRICES = "dt date, asset string, px double"


class Versions:
    """Tables below a folder, a version for each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def write(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, name: str, schema: str, until: int | None = None) -> DataFrame:
        """All rows of the batches up to one."""
        there = [int(n.split("=")[1]) for n in self.store.names(name) if n.startswith("batch=")]
        paths = [f"{self.root}/{name}/batch={n}" for n in there if until is None or n <= until]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def one(self, name: str, schema: str, number: int) -> DataFrame:
        """The rows of one batch."""
        there = f"batch={number}" in self.store.names(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={number}") if there else self.spark.createDataFrame([], schema)

    def mark(self, number: int) -> dict:
        """What the last batch before this one has noted."""
        known = [int(n) for n in self.store.names("marks") if n.isdigit() and int(n) < number]
        return json.loads(self.store.read(f"marks/{max(known)}")) | {"batch": max(known)} if known else {"batch": -1}

    def note(self, number: int, values: dict) -> None:
        self.store.delete(f"marks/{number}")
        self.store.create(f"marks/{number}", as_json(plain(values)))


class GrowingPanel:
    """A sink for (dt, asset, px) rows. Bars after the last one with any price are withheld: a new bar is often there before its prices are.

    * panel: the rows of bars up to the last priced one, each written once.
    * pending: the withheld rows, all without a price, carried from batch to batch until a price comes for their bar or a later one.
    * late: rows more than ``late_days`` older than the newest bar of the batches before; they are counted and kept, and stay out of the panel.
    Rows without a date or asset are late, too. The panel equals the trimmed panel of all rows that were not late.
    """

    def __init__(self, spark: SparkSession, root: str, late_days: int = 5):
        self.late_days, self.versions = late_days, Versions(spark, root)

    def __call__(self, batch: DataFrame, number: int) -> None:
        v, before = self.versions, self.versions.mark(number)
        rows = batch.select("dt", "asset", F.nanvl(F.col("px").cast("double"), F.lit(None).cast("double")).alias("px"))
        late = F.col("dt").isNull() | F.col("asset").isNull()
        if before.get("newest"):
            late = late | (F.col("dt") < F.date_sub(F.lit(before["newest"]).cast("date"), self.late_days))
        judged = v.write("incoming", number, rows.withColumn("late", late))
        on_time = judged.where("NOT late").drop("late")
        open_ = on_time.unionByName(v.one("pending", PRICES, before["batch"]))
        newest, last, n_late = judged.agg(F.max(F.when(~F.col("late"), F.col("dt"))), F.max(F.when(~F.col("late") & F.col("px").isNotNull(), F.col("dt"))), F.count_if("late")).first()
        last = max(filter(None, [str(last) if last else None, before.get("last_priced")]), default=None)
        newest = max(filter(None, [str(newest) if newest else None, before.get("newest")]), default=None)
        known = F.col("dt") <= F.lit(last).cast("date") if last else F.lit(False)
        v.write("panel", number, open_.where(known))
        v.write("pending", number, open_.where(~known))
        v.write("late", number, judged.where("late").drop("late"))
        v.note(number, {"newest": newest, "last_priced": last, "late": before.get("late", 0) + n_late})

    def panel(self) -> DataFrame:
        return self.versions.read("panel", PRICES)

    def late(self) -> DataFrame:
        return self.versions.read("late", PRICES)

    def n_late(self) -> int:
        return self.versions.mark(1 << 60).get("late", 0)


class HoldoutAccrual:
    """A sink that collects a hold-out's bars and judges it once, as soon as it has enough of them.

    Bars only ever follow the newest one: rows at or before the mark that the batch before left are late and kept aside. The history before the decision comes
    with the bars or is given at the start. With ``min_bars`` bars after the decision the verdict is written, under a name that can be taken once.
    """

    def __init__(self, spark: SparkSession, root: str, cfg: Strategy, decision_date: str, n_trials: int, how: Holdout, history: DataFrame | None = None):
        self.cfg, self.decision, self.n_trials, self.how, self.history = cfg, decision_date, n_trials, how, history
        self.versions = Versions(spark, root)

    def __call__(self, batch: DataFrame, number: int) -> None:
        v, before = self.versions, self.versions.mark(number)
        rows = batch.select("dt", "asset", F.col("px").cast("double").alias("px"))
        old = F.col("dt").isNull() | F.col("asset").isNull()
        if before.get("newest"):
            old = old | (F.col("dt") <= F.lit(before["newest"]).cast("date"))
        judged = v.write("incoming", number, rows.withColumn("late", old))
        v.write("bars", number, judged.where("NOT late").drop("late"))
        v.write("late", number, judged.where("late").drop("late"))
        after = F.when(~F.col("late") & (F.col("dt") > F.lit(self.decision).cast("date")), F.col("dt"))
        newest, fresh = judged.agg(F.max(F.when(~F.col("late"), F.col("dt"))), F.count_distinct(after)).first()
        # bars never come twice, so that their number is a running sum
        n_bars = before.get("n_bars", 0) + fresh
        if n_bars >= self.how.min_bars and self.verdict() is None:
            self._judge(number)
        v.note(number, {"newest": str(newest) if newest else before.get("newest"), "n_bars": n_bars})

    def _judge(self, number: int) -> None:
        prices = self.versions.read("bars", PRICES, number)
        if self.history is not None:
            prices = prices.unionByName(self.history.select("dt", "asset", "px"))
        weighted = strategy_weights(complete_grid(prices), self.cfg)
        row = holdout_verdict(weighted, self.cfg, self.decision, self.n_trials, self.how).first()
        try:
            self.versions.store.create("verdict", as_json(plain({"batch": number, **row.asDict()})))
        except Conflict:
            pass  # another run of this batch was first

    def verdict(self) -> dict | None:
        text = self.versions.store.read("verdict")
        return json.loads(text) if text else None

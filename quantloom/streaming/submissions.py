"""One submission per period and book as keyed streaming state: the last submitted period and its targets are carried, requests come in order of their time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.functions.scalar import period_key_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECIDED = "book string, ts timestamp, asof string, forced boolean, period_key string, action string, submitted_period string, submitted_asof string, submitted string"
WEIGHTS = "map<string,double>"


def decide(pending: Iterable[tuple], last: tuple | None, cadence: str) -> tuple[list[tuple], tuple | None]:
    """Decisions on requests (ts, asof, force, targets) of one book in order, and what is carried on: (period, asof, targets).

    A period that was submitted is skipped, one before it is late; a forced request is always submitted. Each decision comes with the submission in
    force after it: what the held book is to be compared with.
    """
    out = []
    for ts, asof, force, targets in sorted(pending, key=lambda r: (r[0], r[1], not r[2], r[3])):
        key = period_key_of(asof, cadence)
        action = "submit" if force or last is None or key > last[0] else "skip" if key == last[0] else "late"
        if action == "submit":
            last = (key, asof, targets)
        out.append((ts, asof, force, key, action, *(last or (None, None, None))))
    return out, last


class Submissions(StatefulProcessor):
    """Requests wait until the watermark has passed them, so that their order is that of their times, however they arrive."""

    def __init__(self, cadence: str):
        self.cadence = cadence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "period string, asof string, targets string")
        self.waiting = handle.getListState("waiting", "ts timestamp, asof string, force boolean, targets string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # a request counts as a whole from its second on
            due = (part["ts"].astype("datetime64[ms]").astype("int64") // 1000 + 1) * 1000
            self.waiting.appendList([(t.to_pydatetime(), a, bool(f), w) for t, a, f, w in zip(part["ts"], part["asof"], part["force"], part["targets"], strict=True)])
            for ms in sorted(set(due)):
                self.handle.registerTimer(int(ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        ready, rest = [], []
        for r in self.waiting.get():
            (ready if pd.Timestamp(r[0]).tz_localize(None) < until else rest).append(tuple(r))
        if not ready:
            return iter(())
        last = tuple(self.last.get()) if self.last.exists() else None
        made, last = decide([(pd.Timestamp(r[0]).tz_localize(None), *r[1:]) for r in ready], last, self.cadence)
        if last:
            self.last.update(last)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        return iter([pd.DataFrame([(key[0], *m) for m in made], columns=[c.split()[0] for c in DECIDED.split(", ")])])


def submissions(requests: DataFrame, cadence: str, late: str = "0 seconds") -> DataFrame:
    """Decisions on a stream of requests (book, ts, asof, force, targets): action is submit, skip or late; submitted is the targets in force.

    asof is a date; targets a map of weights by symbol; a null force is none. Requests of a book are decided by time as soon as the watermark (``late`` behind the latest request of
    any book) passes them; later ones are dropped by the stream. State is a row for each book and its waiting requests.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = requests.select("book", "ts", F.col("asof").cast("string").alias("asof"), F.coalesce("force", F.lit(False)).alias("force"), F.to_json("targets").alias("targets"))
    rows = rows.where("book IS NOT NULL AND ts IS NOT NULL AND asof IS NOT NULL").withWatermark("ts", late)
    found = rows.groupBy("book").transformWithStateInPandas(Submissions(cadence), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")
    return found.withColumn("submitted", F.from_json("submitted", WEIGHTS))


def in_force(decisions: DataFrame) -> DataFrame:
    """(book, symbol, target_w) of each book's last decision: the reference to reconcile held positions with."""
    last = decisions.groupBy("book").agg(F.max_by("submitted", F.struct("ts", "asof", "forced")).alias("w"))
    return last.select("book", F.explode("w").alias("symbol", "target_w"))

"""Price sources: the provider interface, a synthetic source, a Parquet cache, and selection with a fallback."""

from __future__ import annotations

import hashlib
import json
import logging
import uuid
from collections.abc import Callable, Sequence
from datetime import date
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalar import not_nan
from quantloom.operators.panel import complete_grid, usability
from quantloom.sources.config import Strategy
from quantloom.sources.store import Conflict, Store, as_json
from quantloom.sources.wide import price_columns

log = logging.getLogger(__name__)
SCHEMA = "dt date, asset string, px double"


@runtime_checkable
class PriceSource(Protocol):
    """Adjusted closes (dt, asset, px) of tickers from start to end, both included; gaps are missing rows or nulls."""

    def prices(self, tickers: Sequence[str], start: str, end: str) -> DataFrame: ...


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Mondays to Fridays from start to end."""
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("z"))
    days = bounds.select(F.explode(F.expr("CASE WHEN a <= z THEN sequence(a, z, interval 1 day) END")).alias("dt"))
    return days.where(~F.dayofweek("dt").isin(1, 7))


def ticker_seed(seed: int, ticker: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{ticker}".encode()).digest()[:4], "big")


class SyntheticSource:
    """Geometric Brownian motion per ticker, from a seed of its own: the same prices whatever else is asked for."""

    def __init__(self, spark: SparkSession, seed: int = 42, periods_per_year: int = 252):
        self.spark, self.seed, self.ppy = spark, seed, periods_per_year

    def prices(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        seed, ppy = self.seed, self.ppy
        names = self.spark.createDataFrame([(t,) for t in tickers], "asset string")
        rows = business_days(self.spark, start, end).crossJoin(names)

        def walk(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("dt")
            own = ticker_seed(seed, group["asset"].iloc[0])
            shape = np.random.default_rng(own)
            drift = 0.05 + shape.normal(0.0, 0.04)
            vol = max(0.15 * shape.uniform(0.6, 1.6), 1e-3)
            shocks = np.random.default_rng(own).standard_normal(len(group))
            step = (drift - 0.5 * vol * vol) / ppy + vol * np.sqrt(1.0 / ppy) * shocks
            step[0] = 0.0
            return group[["dt", "asset"]].assign(px=100.0 * np.exp(np.cumsum(step)))

        return rows.groupBy("asset").applyInPandas(walk, SCHEMA)


def long_prices(wide: DataFrame, tickers: Sequence[str], end: str, dt: str = "dt", field: str = "Close") -> DataFrame:
    """A wide payload as prices: asked tickers only, no rows after end, NaN as null.

    It has one column per ticker, or two levels of columns (a field and a ticker, in either order), named by pairs.
    """
    at = price_columns(wide.columns, field)
    there = {t: wide.columns[at[t]] for t in tickers if t in at and wide.columns[at[t]] != dt}
    w = wide.select(F.to_date(dt).alias("dt"), *(F.col(f"`{c}`").cast("double").alias(t) for t, c in there.items()))
    rows = w.unpivot(["dt"], [F.col(f"`{t}`") for t in there], "asset", "px") if there else w.select("dt", F.lit(None).cast("string").alias("asset"), F.lit(None).cast("double").alias("px")).limit(0)
    return rows.where(F.col("dt") <= F.lit(end).cast("date")).select("dt", "asset", not_nan(F.col("px")).alias("px"))


def cache_key(tickers: Sequence[str], start: str, end: str) -> str:
    """The same for any order of tickers."""
    return hashlib.sha256("|".join([",".join(sorted(tickers)), start, end]).encode()).hexdigest()[:16]


def table_digest(rows: DataFrame) -> str:
    """A digest of a table's rows in any order, from one pass."""
    h = F.xxhash64("dt", "asset", "px").cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(h)).first()
    return f"{n}:{total or 0}"


class CachedSource:
    """A source behind a folder of Parquet tables on any file system that Spark reads. Only answers with rows are kept; a broken table counts as missing.

    A request's table is written under a new name, and then a small document is put that names it and its digest: readers follow that document, so
    that they see a whole table, the one before or the new one, while another one is written. Of two writers at the same time one drops its table.
    """

    def __init__(self, spark: SparkSession, source: PriceSource, folder: str):
        self.spark, self.source, self.folder = spark, source, folder

    def _read(self, path: str) -> DataFrame | None:
        try:
            _, text = Store(self.spark, path).latest("current")
            if text is None:
                return None
            known = json.loads(text)
            df = self.spark.read.schema(SCHEMA).parquet(f"{path}/{known['table']}")
            if table_digest(df) != known["digest"]:
                raise ValueError("its digest differs")
            return df
        except (PySparkException, Py4JJavaError, ValueError, KeyError) as e:
            log.warning("no cached prices at %s: %s", path, type(e).__name__)
            return None

    def _keep(self, path: str, found: DataFrame) -> DataFrame:
        table = f"data-{uuid.uuid4().hex}"
        found.select("dt", "asset", "px").write.parquet(f"{path}/{table}")
        kept = self.spark.read.schema(SCHEMA).parquet(f"{path}/{table}")
        store = Store(self.spark, path)
        try:
            store.put("current", as_json({"table": table, "digest": table_digest(kept)}), store.latest("current")[0])
        except Conflict:
            store.delete(table)
            return self._read(path) or found
        return kept

    def prices(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/prices-{cache_key(tickers, start, end)}"
        found = self._read(path)
        if found is None:
            found = self.source.prices(tickers, start, end)
            if found.isEmpty():
                return found
            try:
                found = self._keep(path, found)
            except (PySparkException, Py4JJavaError) as e:
                log.warning("prices were not cached: %s", e)
        return found.where(F.col("asset").isin(list(tickers)))


def date_window(years: int, end: str | None = None) -> tuple[str, str]:
    """From so many calendar years before end (today) to end."""
    last = date.fromisoformat(end) if end else date.today()
    try:
        first = last.replace(year=last.year - years)
    except ValueError:  # 29 February
        first = last.replace(year=last.year - years, day=28)
    return first.isoformat(), last.isoformat()


def select_source(real: PriceSource | None, synthetic: PriceSource, cfg: Strategy, start: str, end: str) -> tuple[DataFrame, str]:
    """The panel of the real source if it is usable, else of the synthetic one, and which: real or synthetic."""
    if real is not None:
        try:
            panel = complete_grid(real.prices(cfg.universe, start, end))
            if usability(panel, cfg.lookbacks, cfg.vol_window, cfg.universe).first()["usable"]:
                return panel, "real"
            log.warning("the real source has too few prices")
        except Exception as e:  # any failure of a plugged-in source means the fallback
            log.warning("the real source failed: %s", e)
    return complete_grid(synthetic.prices(cfg.universe, start, end)), "synthetic"


class FunctionSource:
    """A plugged-in reader: a function of tickers, start and end that gives a pandas or Spark table in long form."""

    def __init__(self, spark: SparkSession, read: Callable):
        self.spark, self.read = spark, read

    def prices(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        got = self.read(list(tickers), start, end)
        df = got if isinstance(got, DataFrame) else self.spark.createDataFrame(got)
        return df.select(F.to_date("dt").alias("dt"), "asset", not_nan(F.col("px")).alias("px")).where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def positions_from_json(spark: SparkSession, text: str) -> DataFrame:
    """(symbol, qty) from a JSON object of quantities by symbol."""
    got = json.loads(text)
    if not isinstance(got, dict):
        raise ValueError("positions must be a JSON object of quantities by symbol")
    return spark.createDataFrame([(str(k), float(v)) for k, v in got.items()], "symbol string, qty double")

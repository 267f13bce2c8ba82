"""Folders of wide price files as a Spark data source: ``spark.read.format("wide_prices")``.

A file has a date column and a column for each ticker, or two levels of columns: a field (Close, Volume, ...) and a ticker, in either order. CSV files
name two levels in two header rows, Parquet files by names that are pairs, such as ``('Close', 'AAA')``.
"""

from __future__ import annotations

import ast
import csv
import io
import logging
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

log = logging.getLogger(__name__)
SCHEMA = "dt date, asset string, px double"
DATE_NAMES = ("date", "dt", "datetime", "timestamp", "index", "__index_level_0__")


def two_levels(name: str) -> tuple[str, str] | None:
    """The two levels of a column's name, if it is a pair."""
    if not name.startswith("("):
        return None
    try:
        pair = ast.literal_eval(name)
    except (ValueError, SyntaxError):
        return None
    return (str(pair[0]), str(pair[1])) if isinstance(pair, tuple) and len(pair) == 2 else None


def price_columns(names: Sequence[str | tuple[str, str]], field: str) -> dict[str, int]:
    """The place of each ticker's column. Of two levels the one that has the field is its level, the other one the tickers'."""
    pairs = {i: n if isinstance(n, tuple) else two_levels(n) for i, n in enumerate(names)}
    pairs = {i: p for i, p in pairs.items() if p}
    if not pairs:
        return {n: i for i, n in enumerate(names) if n}
    level = 0 if any(p[0] == field for p in pairs.values()) else 1
    return {p[1 - level]: i for i, p in pairs.items() if p[level] == field and p[1 - level]}


@dataclass(frozen=True)
class File:
    """One file's columns: the date's place and each ticker's."""

    path: str
    date_at: int
    tickers: dict
    skip: int  # header rows of a CSV file


def _date_at(names: Sequence) -> int:
    flat = [n if isinstance(n, str) else n[0] for n in names]
    return next((i for i, n in enumerate(flat) if n.lower() in DATE_NAMES), 0)


def _open(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa_fs.LocalFileSystem(), path)


def inspect(path: str, field: str) -> File:
    """What columns a file has, from its head alone."""
    fs, inner = _open(path)
    if path.endswith(".parquet"):
        with fs.open_input_file(inner) as f:
            names = pq.read_schema(f).names
        at, skip = _date_at([two_levels(n) or n for n in names]), 0
    else:
        with fs.open_input_stream(inner) as f:
            head = f.read(1 << 20).decode("utf-8", "replace")
        rows = list(csv.reader(io.StringIO(head)))[:3]
        if not rows:
            raise ValueError(f"no header: {path}")
        names, skip, at = rows[0], 1, None
        if len(rows) > 1 and (field in rows[0] or field in rows[1]) and len(set(rows[0])) < len(rows[0]) | (field in rows[1]):
            names = [(a, b) for a, b in zip(rows[0], rows[1], strict=True)]
            # a third header row may name the dates alone
            skip = 3 if len(rows) > 2 and not any(rows[2][1:]) else 2
            at = 0
        at = _date_at(names) if at is None else at
    found = {t: i for t, i in price_columns(names, field).items() if i != at}
    return File(path, at, found, skip)


def _days(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """Dates of dates, timestamps (of any zone, by their own wall clock) or ISO texts; what is none is null."""
    kind = column.type
    if pa.types.is_timestamp(kind):
        return (pc.local_timestamp(column) if kind.tz else column).cast(pa.date32(), safe=False)
    if pa.types.is_date(kind):
        return column.cast(pa.date32())
    text = pc.utf8_slice_codeunits(column.cast(pa.string()), 0, 10)
    iso = pc.match_substring_regex(text, r"^\d{4}-\d{2}-\d{2}$")
    return pc.if_else(iso, text, None).cast(pa.date32())


def read_file(file: File, tickers: Sequence[str]) -> pa.Table:
    """The date column (dt) and the tickers' columns of one file; other columns are not read."""
    fs, inner = _open(file.path)
    there = [t for t in tickers if t in file.tickers]
    if file.path.endswith(".parquet"):
        with fs.open_input_file(inner) as f:
            reader = pq.ParquetFile(f)
            names = reader.schema_arrow.names
            got = reader.read(columns=[names[i] for i in (file.date_at, *(file.tickers[t] for t in there))])
            columns = [got.column(names[file.date_at]), *(got.column(names[file.tickers[t]]) for t in there)]
    else:
        width = max([file.date_at, *file.tickers.values()]) + 1
        labels = [f"c{i}" for i in range(width)]
        wanted = [labels[i] for i in (file.date_at, *(file.tickers[t] for t in there))]
        with fs.open_input_stream(inner) as f:
            first = f.read()
        rows = first.decode().splitlines()
        width = max(len(next(csv.reader([rows[0]]))), width) if rows else width
        labels = [f"c{i}" for i in range(width)]
        body = io.BytesIO("\n".join(rows[file.skip :]).encode() + b"\n")
        kinds = {w: pa.string() if w == wanted[0] else pa.float64() for w in wanted}
        got = pa_csv.read_csv(body, pa_csv.ReadOptions(column_names=labels), convert_options=pa_csv.ConvertOptions(include_columns=wanted, column_types=kinds, strings_can_be_null=True))
        columns = [got.column(w) for w in wanted]
    return pa.table([_days(columns[0]), *(c.cast(pa.float64()) for c in columns[1:])], names=["dt", *there])


@dataclass
class Block(InputPartition):
    """Some tickers, and the files that have any of them."""

    tickers: tuple
    files: tuple


class WidePricesReader(DataSourceReader):
    """A partition for each block of tickers; filters on ticker and date are answered here."""

    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("wide_prices needs a path")
        self.path, self.field = options["path"], options.get("field", "Close")
        self.block = int(options.get("block", 16))
        self.tickers: set | None = set(filter(None, options["tickers"].split(","))) if options.get("tickers") else None
        self.low, self.high = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        name = ".".join(getattr(f, "attribute", ()))
        if name == "asset" and isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.tickers = asked if self.tickers is None else self.tickers & asked
            return True
        value = getattr(f, "value", None)
        if name != "dt" or not isinstance(value, date) or isinstance(value, datetime):
            return False
        one = date.resolution
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.low = max(self.low, value + one * isinstance(f, GreaterThan) if value < date.max else value)
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.high = min(self.high, value - one * isinstance(f, LessThan) if value > date.min else value)
        return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))

    def files(self) -> list[str]:
        fs, inner = _open(self.path)
        info = fs.get_file_info(inner)
        if info.type == pa_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [self.path]
        names = sorted(x.path for x in fs.get_file_info(pa_fs.FileSelector(inner, recursive=True)) if x.is_file and x.path.endswith((".parquet", ".csv")) and not posixpath.basename(x.path).startswith(("_", ".")))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [scheme + n if scheme else n for n in names]

    def partitions(self) -> Sequence[Block]:
        heads = []
        for path in self.files():
            try:
                heads.append(inspect(path, self.field))
            except Exception as e:  # a broken file is a gap, not the end of the run
                log.warning("%s was left out: %s: %s", path, type(e).__name__, e)
        there = sorted({t for h in heads for t in h.tickers if self.tickers is None or t in self.tickers})
        blocks = [there[i : i + self.block] for i in range(0, len(there), self.block)]
        return [Block(tuple(b), tuple(h for h in heads if any(t in h.tickers for t in b))) for b in blocks] or [Block((), ())]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("dt", pa.date32()), ("asset", pa.string()), ("px", pa.float64())])
        try:
            tables = [read_file(f, partition.tickers) for f in partition.files]
        except Exception as e:  # of one block; the others are read
            log.warning("no prices of %s: %s: %s", ",".join(partition.tickers), type(e).__name__, e)
            return
        for table in tables:
            known = pc.and_(pc.greater_equal(table["dt"], pa.scalar(self.low, pa.date32())), pc.less_equal(table["dt"], pa.scalar(self.high, pa.date32())))
            table = table.filter(known)
            for ticker in table.column_names[1:]:
                px = table[ticker]
                px = pc.if_else(pc.is_finite(px), px, None)
                rows = pa.table([table["dt"], pa.array([ticker] * len(table), pa.string()), px], schema=kind)
                yield from rows.combine_chunks().to_batches(max_chunksize=10_000)


class WidePrices(DataSource):
    """Options: path (a file or folder), field (Close), tickers (all that are there), block (tickers to a partition)."""

    @classmethod
    def name(cls) -> str:
        return "wide_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WidePricesReader:
        return WidePricesReader(dict(self.options))


class FolderSource:
    """A price source over a folder of wide files. Filters go to the files' reader, which reads the asked columns alone."""

    def __init__(self, spark: SparkSession, path: str, field: str = "Close", block: int = 16):
        self.spark, self.path, self.field, self.block = spark, path, field, block
        spark.dataSource.register(WidePrices)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def prices(self, tickers: Sequence[str], start: str, end: str) -> DataFrame:
        rows = self.spark.read.format("wide_prices").options(field=self.field, block=self.block).load(self.path)
        return rows.where(F.col("asset").isin(list(tickers)) & F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

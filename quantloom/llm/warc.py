"""Deterministic sharded WARC archives: write, commit by manifest, read back."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import saved, scratch

#: Payloads from this size on are written once.
REVISIT_BYTES = 100
#: Payload bytes of a key range, and compressed bytes at which a file is closed.
RANGE_BYTES, ROLL_BYTES = 16 << 20, 8 << 20
#: Tasks that key ranges are dealt to, in order: one for each range, up to so many, which then get several.
MOST_TASKS = 50_000
#: Key cells that ranges are made of, by powers of two: a level of them has at most so many. Rows of one id, or none, are cut by digest.
CELLS, CELLS_ABOVE, PARTS = 16, 8, 10
CELLS_A_RANGE = 64
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(digest: Column, shift: int, below: int, parts: int) -> tuple[Column, Column]:
    """cell and part of a page: its id without the last bits, and its digest modulo parts (rows without an id: 2 ** PARTS, in the cell below)."""
    page_id = F.col("page_id").cast("long")
    bits = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    part = F.when(page_id.isNull(), bits % (1 << PARTS)).otherwise(bits % parts if parts > 1 else F.lit(0).cast("long"))
    return F.coalesce(F.shiftright(page_id, shift), F.lit(below).cast("long")).alias("cell"), part.alias("part")


def _in_order(sums: DataFrame, parent: Column, above: Column) -> DataFrame:
    """sums (cell, part, bytes, at: where its parent begins) with at: where the cell itself begins, in bytes of the whole.

    The running sum is taken in two levels, so no task sees more than about 2 ** CELLS_ABOVE sums of a parent.
    """
    sums = sums.withColumns({"parent": parent, "above": above})
    over = sums.groupBy("parent", "above").agg(F.sum("bytes").alias("sum"))
    earlier = Window.partitionBy("parent").orderBy("above").rowsBetween(Window.unboundedPreceding, -1)
    before = over.select("parent", "above", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("parent", "above").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("at") + F.col("before") + F.coalesce(F.sum("bytes").over(inner), F.lit(0))
    return sums.join(before, ["parent", "above"]).select("cell", "part", "bytes", at.alias("at"))


def key_ranges(narrow: DataFrame) -> list[tuple[int, int, int, DataFrame]]:
    """Levels (shift, below, parts, ranges) with ranges cell, part -> grp: page_id space cut into cells, put together in order up to RANGE_BYTES.

    Cells over RANGE_BYTES (or a MOST_TASKS-th of all) are cut again in the next level, down to single ids and then by digest, so ids far from
    all others don't widen the ranges of the rest. A level has at most 2 ** CELLS cells and parts, besides those of rows without an id. The
    result depends on the pages alone, never on how they are partitioned.
    """
    weight = F.col("payload_bytes") + 512
    lo, hi, total = narrow.agg(F.min("page_id"), F.max("page_id"), F.sum(weight)).first()
    lo, hi, most = lo or 0, hi or 0, max(RANGE_BYTES, (total or 0) // MOST_TASKS)
    # about CELLS_A_RANGE cells for a range, where ids lie close
    cells = min(CELLS, (CELLS_A_RANGE * (total or 0) // RANGE_BYTES).bit_length() + 1)
    shift, parts = max(1, (hi - lo).bit_length() - cells + 1), 1
    below, levels = (lo >> shift) - 1, []
    sums = narrow.groupBy(*_place(F.col("digest"), shift, below, 1)).agg(F.sum(weight).alias("bytes")).withColumn("at", F.lit(0).cast("long"))
    parent, above = F.lit(0), F.shiftright("cell", CELLS_ABOVE)
    while True:
        level = saved(_in_order(sums, parent, above), "warc-ranges")
        large = (F.col("bytes") > most) & (F.col("cell") != below) if parts == 1 else F.lit(False)
        levels.append((shift, below, parts, level.where(~large).select("cell", "part", F.floor(F.col("at") / RANGE_BYTES).cast("long").alias("grp"))))
        heavy = level.where(large).select(F.col("cell").alias("parent"), "at")
        n = heavy.count()
        if not n:
            return levels
        # at most MOST_TASKS cells are heavy
        parents = F.broadcast(heavy)
        inside = narrow.join(parents, F.shiftright(F.col("page_id").cast("long"), shift) == F.col("parent"))
        cuts = max(1, ((1 << CELLS) // n).bit_length() - 1)
        bits, parts = min(shift, cuts), 1 if shift else 1 << min(PARTS, cuts)
        shift -= bits
        sums = inside.groupBy(*_place(F.col("digest"), shift, below, parts)).agg(F.sum(weight).alias("bytes"), F.first("at").alias("at"))
        parent, above = F.shiftright("cell", bits), F.shiftright("cell", min(bits, CELLS_ABOVE))


def _ranged(rows: DataFrame, digest: Column, levels: list[tuple[int, int, int, DataFrame]]) -> DataFrame:
    """rows with grp. Broadcasts have at most 2 ** CELLS + 2 ** PARTS rows of three numbers."""
    rows = rows.withColumn("grp", F.lit(None).cast("long"))
    for shift, below, parts, ranges in levels:
        cell, part = _place(digest, shift, below, parts)
        found = F.broadcast(ranges.select(F.col("cell").alias("__cell"), F.col("part").alias("__part"), F.col("grp").alias("__grp")))
        rows = rows.join(found, (cell == F.col("__cell")) & (part == F.col("__part")), "left")
        rows = rows.withColumn("grp", F.coalesce("grp", "__grp")).drop("__cell", "__part", "__grp")
    return rows


def _record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; headers follow from the page alone."""
    identity = f"{page_id}:{digest}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, identity)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


class _Shards:
    """Files of one task: gzip members are gathered up to ROLL_BYTES, written under a temporary name and renamed."""

    def __init__(self, root: str, roll: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.roll, self.grp, self.seq = roll, None, 0
        self.members: list[bytes] = []
        self.size, self.pages, self.done = 0, [], []

    def add(self, grp: int, page_id, record: bytes) -> None:
        if grp != self.grp:
            self.close()
            self.grp, self.seq = grp, 0
        m = _member(record)
        if self.members and self.size + len(m) > self.roll:
            self.close()
        self.members.append(m)
        self.size += len(m)
        self.pages.append(page_id)

    def close(self) -> None:
        if not self.members:
            return
        body = b"".join(self.members)
        name = f"part-{self.grp:08d}-{self.seq:06d}.warc.gz"
        temporary = f"{self.root}/_{name}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(temporary, compression=None) as out:
            out.write(body)
        self.fs.move(temporary, f"{self.root}/{name}")
        ids = [p for p in self.pages if p is not None]
        self.done.append((name, self.grp, self.seq, len(self.members), len(body), hashlib.sha256(body).hexdigest(), min(ids, default=None), max(ids, default=None)))
        self.members, self.size, self.pages, self.seq = [], 0, [], self.seq + 1


MANIFEST = "name string, grp long, seq long, n_records long, bytes long, sha256 string, first_page long, last_page long"


def write_warc(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under ``root``; the manifest, one row per file.

    Records come in order of page_id. A file ends where the next record would take it over ``roll_bytes``
    compressed, or where its key range ends. Names, bytes and digests depend on the pages alone, so a task that
    runs again writes the same files; only files in the manifest, which Spark commits at the end, count.
    Payloads of at least REVISIT_BYTES are written once, at their smallest page_id; equal ones are revisits. Null html
    is an empty payload, a null url about:blank. A null page_id comes first and is never referred to.
    Rows that repeat page_id and payload are all of the same type. Payloads of any length are written whole. page_id must be a whole number;
    other columns, of any name, are not looked at. An empty table writes no file.
    """
    spark = pages.sparkSession
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(root)
    where.create_dir(path, recursive=True)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = saved(pages.select("page_id", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("digest")), "warc-pages")
    levels = key_ranges(narrow)
    large = narrow.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    again = narrow.where(F.col("payload_bytes") >= REVISIT_BYTES).join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    tasks = min(MOST_TASKS, 1 + max(ranges.agg(F.max("grp")).first()[0] or 0 for *_, ranges in levels))
    role = again.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("body"), "digest", "refers_to")
    page = pages.select("page_id", F.lit(1).alias("kind"), "url", body.alias("body"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = _ranged(role, F.col("digest"), levels).unionByName(_ranged(page, F.sha2("body", 256), levels))
    dealt = both.repartitionByRange(tasks, "grp").sortWithinPartitions("grp", "page_id", "kind", "digest", F.sha2("body", 256), "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, at, roles = _Shards(root, roll_bytes), None, {}
        for batch in batches:
            for grp, page_id, kind, url, content, digest, refers_to in zip(*(batch[c] for c in ("grp", "page_id", "kind", "url", "body", "digest", "refers_to")), strict=True):
                page = None if pd.isna(page_id) else int(page_id)
                if page != at:
                    at, roles = page, {}
                if kind == 0:
                    roles[digest] = int(refers_to)
                    continue
                d = hashlib.sha256(content).hexdigest()
                to = roles.get(d)
                url = url if isinstance(url, str) else None
                if to is None:
                    shards.add(grp, page, _record("response", page, url, content, d, len(content), None))
                else:
                    shards.add(grp, page, _record("revisit", page, url, b"", d, len(content), to))
            if shards.done:
                yield pd.DataFrame(shards.done, columns=[x.split()[0] for x in MANIFEST.split(", ")])
                shards.done = []
        shards.close()
        yield pd.DataFrame(shards.done, columns=[x.split()[0] for x in MANIFEST.split(", ")])

    manifest = dealt.mapInPandas(write, MANIFEST)
    manifest.write.parquet(f"{root}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def parse_warc(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payload of each record of a gzipped archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(archive)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            body = f.read(int(head["content-length"]))
            if "sha256:" + hashlib.sha256(body).hexdigest() != head["warc-block-digest"]:
                raise ValueError(f"{head['warc-record-id']}: the block doesn't match its digest")
            yield head, body


RECORD = "name string, sha256 string, n long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_warc(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of the files in the manifest under ``root``; ``payload`` False leaves the html null.

    A listed file that is gone is an error at once, one whose bytes don't match its digest in the manifest or that has another number of records, or a block that doesn't
    match its own digest, is an error. Files that are not listed are not looked at.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(root)
    files = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                rows, digest_of_file = [], hashlib.sha256(content).hexdigest()
                for head, body in parse_warc(bytes(content)):
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    size = len(body) if kind == "response" else int(head["x-payload-length"])
                    rows.append((name, digest_of_file, 0, page and int(page), head["warc-target-uri"], size, digest, kind, to and int(to), body.decode() if payload and kind == "response" else None))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).assign(n=len(rows))
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    listed = manifest.select("name", F.col("sha256").alias("__listed"), F.col("n_records").alias("__n"))
    # names alone are listed here, no contents are read
    gone = [r["name"] for r in listed.join(files.select("name"), "name", "left_anti").select("name").orderBy("name").limit(5).collect()]
    if gone:
        raise FileNotFoundError(f"a file of the manifest is missing: {', '.join(gone)}")
    found = files.mapInPandas(records, RECORD).join(listed, "name")
    whole = F.assert_true(F.col("sha256") == F.col("__listed"), F.concat(F.lit("digest of the manifest does not match: "), F.col("name")))
    counted = F.assert_true(F.col("n") == F.col("__n"), F.concat(F.lit("number of records of the manifest does not match: "), F.col("name")))
    return found.where(whole.isNull() & counted.isNull()).drop("sha256", "n", "__listed", "__n")


def op7_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), root)
    return read_warc(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d
"""

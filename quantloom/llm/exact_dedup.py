"""Exact deduplication by an extendible-hash index on shared files (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower, saved

#: Entries that a bucket holds before it is split.
CAPACITY = 100_000
#: Bits of the key by which the directory is deepened at a time.
DEEPEN = 6
#: A directory of up to so many buckets is broadcast; a larger one is joined by shuffle.
BROADCAST_BUCKETS = 1 << 20

#: Names that no input column clashes with.
HASH, NORM, KEEP, SIZE, ROW, OWNER = (f"__dedup_{x}" for x in ("hash", "norm", "keep", "size", "row", "owner"))


def key_of(norm: Column, bits: int) -> Column:
    """The 64-bit key of a text, of which only the leading ``bits`` are used; fewer make collisions (for tests)."""
    return leading(F.xxhash64(norm), F.lit(bits))


def leading(key: Column, depth: Column) -> Column:
    """The key with all but its leading ``depth`` bits at 0: the first key of the range that a bucket of this depth owns."""
    cut = F.call_function("shiftleft", F.call_function("shiftrightunsigned", key, (64 - depth).cast("int")), (64 - depth).cast("int"))
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(cut)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The extendible directory over different keys: depth and first (the first key of the range) of each bucket.

    It starts as one bucket for the whole key space. Every bucket that holds over ``capacity`` keys is split in halves, and these again,
    until none is overfull; only the keys of overfull buckets are counted again. A single key is never split.
    """
    n = keys.count()
    step = max(1, min(20, math.ceil(math.log2(max(2, n / capacity))) + 1))
    done, at = None, 0
    open_ = keys.select(HASH)
    while True:
        to = min(64, at + step)
        # all depths of this step from one count of the deepest cells
        cells = open_.groupBy(leading(F.col(HASH), F.lit(to)).alias("cell")).agg(F.count("*").alias("n"))
        cells = saved(cells.withColumn("depth", F.explode(F.sequence(F.lit(at), F.lit(to)))).withColumn("first", leading(F.col("cell"), F.col("depth"))), "dedup-cells")
        full = cells.groupBy("depth", "first").agg(F.sum("n").alias("n"))
        fits = cells.drop("n").join(full.where((F.col("n") <= capacity) | (F.col("depth") == 64)), ["depth", "first"])
        own = fits.groupBy("cell").agg(F.min("depth").alias("depth"))
        found = own.select("depth", leading(F.col("cell"), F.col("depth")).alias("first")).distinct()
        done = saved(found if done is None else done.unionByName(found), "dedup-directory")
        left = cells.select("cell").distinct().join(own, "cell", "left_anti")
        if to == 64 or left.isEmpty():
            return done
        left = saved(left, "dedup-overfull")
        open_ = open_.join(left, leading(F.col(HASH), F.lit(to)) == F.col("cell"), "left_semi")
        at, step = to, DEEPEN


def owned(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows with OWNER, the first key of the bucket that owns their key, looked up in the directory depth by depth."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    small = buckets.count() <= BROADCAST_BUCKETS
    found = []
    for d in depths:
        one = buckets.where(F.col("depth") == d).select(F.col("first").alias(f"__first_{d}"))
        rows = rows.join(F.broadcast(one) if small else one, leading(F.col(HASH), F.lit(d)) == F.col(f"__first_{d}"), "left")
        found.append(F.col(f"__first_{d}"))
    return rows.withColumn(OWNER, F.coalesce(*found, F.lit(None).cast("long"))).drop(*(f"__first_{d}" for d in depths))


def build_index(rows: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index in shared files and its directory. rows: staged documents with HASH and ROW.

    A row goes to the bucket that owns its key. There its text is compared byte by byte with those of the same key: a key's chain has an
    entry for each different text, with the row that stays, the number of rows and, where a chain has several, the text itself. Each
    task first merges its own copies, so a text that a third of the rows hold reaches its owner once from every task. Owners write key
    ranges in key order.
    """
    buckets = directory(rows.select(HASH).distinct(), capacity)
    texts = owned(rows.select(HASH, ROW, F.col(doc_id).alias(KEEP), ascii_lower(F.col(text)).alias(NORM)), buckets)
    entry = texts.groupBy(OWNER, HASH, NORM).agg(F.max(KEEP).alias(KEEP), F.coalesce(F.max_by(ROW, KEEP), F.min(ROW)).alias(ROW), F.count("*").alias(SIZE))
    # the texts stay behind
    entry = saved(entry.select(OWNER, HASH, KEEP, ROW, SIZE, F.sha2(NORM, 256).alias("sha")), "dedup-entries")
    several = entry.groupBy(OWNER, HASH).agg(F.count("*").alias("chain")).where("chain > 1").select(OWNER, HASH)
    if several.isEmpty():
        index = entry.withColumn(NORM, F.lit(None).cast("string"))
    else:
        chained = entry.join(several, [OWNER, HASH], "left_semi").select(ROW)
        index = entry.join(rows.join(chained, ROW, "left_semi").select(ROW, ascii_lower(F.col(text)).alias(NORM)), ROW, "left")
    return saved(index.repartitionByRange(OWNER, HASH).sortWithinPartitions(OWNER, HASH, "sha"), "dedup-index"), buckets


def staged(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """docs with HASH and ROW (a number for each row), as a table: row numbers must not change between passes."""
    return saved(docs.withColumns({HASH: key_of(ascii_lower(docs[text]), bits), ROW: F.monotonically_increasing_id()}), "dedup-rows")


def _looked_up(rows: DataFrame, index: DataFrame, buckets: DataFrame, text: str) -> DataFrame:
    """rows (with HASH and text) and the entry of each, read from its owner.

    A key with one entry needs no look at the text: every row of the key was compared when the entry was made. In a
    longer chain the entry of the same bytes counts.
    """
    rows = owned(rows, buckets)
    entry = index.select(OWNER, HASH, KEEP, SIZE, F.col(ROW).alias("__stays"), "sha", F.col(NORM).alias("__chained"))
    several = index.where(F.col(NORM).isNotNull()).select(OWNER, HASH).distinct()
    if several.isEmpty():
        return rows.drop(text).join(entry, [OWNER, HASH])
    one = rows.join(several, [OWNER, HASH], "left_anti").drop(text).join(entry, [OWNER, HASH])
    many = rows.join(several, [OWNER, HASH], "left_semi").withColumn(NORM, ascii_lower(F.col(text))).drop(text)
    many = many.join(entry.withColumnRenamed("__chained", NORM), [OWNER, HASH, NORM])
    return one.drop("__chained").unionByName(many.drop(NORM))


def resolve(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """Which row stays for every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id
    stays (a null doc_id is below all). Of rows that repeat both the doc_id and the text, one stays. Texts of any length are compared
    whole. An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", bits)
    index, buckets = build_index(rows, "doc_id", "text", capacity)
    found = _looked_up(rows.select("doc_id", "text", HASH, ROW), index, buckets, "text")
    return found.select("doc_id", F.col(KEEP).alias("keep_id"), F.col(SIZE).alias("group_size"), (F.col(ROW) == F.col("__stays")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """docs without the rows that ``resolve`` drops; columns as they were."""
    rows = staged(docs, text, bits)
    index, _ = build_index(rows, doc_id, text, capacity)
    # a merge join, so that it works alike at every size
    return rows.join(index.select(ROW).hint("merge"), ROW, "left_semi").select(*docs.columns)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return resolve(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
TOKEN = r"[^\x20\x09-\x0D]+"
#: Hex digits of a row's place by which ranges are cut at a time: 65,536 ranges of a source, or of a range.
DIGITS = 4
#: Rows up to which a range is not cut again but sorted.
SORTED_ROWS = 1 << 16
#: Hex digits of a whole place.
PLACE_DIGITS = 64

SOURCE, PLACE, RANGE, TOKENS, LEFT, ROWS, CUT, WHOLE, TURN = (f"__mix_{x}" for x in ("source", "place", "range", "tokens", "left", "rows", "cut", "whole", "turn"))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size and target, from SOURCE and source_size.

    Sources in code-point order take the weights in turn. They share ``share`` times all sizes by weight; a target stops
    at ``epochs`` times its source's size and the excess is reshared by weight until none is above. In order of
    size per weight the sources that stop come first, so the common level is found by running sums over
    one row per source.
    """
    w = F.element_at(F.array(*(F.lit(int(x)) for x in weights)), ((F.row_number().over(Window.orderBy(SOURCE)) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", SOURCE)
    s = s.withColumns(
        {
            "budget": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * share,
            "stopped": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rest_w": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    s = s.withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("rest_w"))
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", SOURCE, "level"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("common", first["level"])
    target = F.when(F.col("common").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")))
    return s.select(SOURCE, "source_size", target.alias("target"))


def _ranges(rows: DataFrame, digits: int) -> DataFrame:
    """Sums over the ranges of places that share so many leading digits."""
    sums = rows.groupBy(SOURCE, F.substring(PLACE, 1, digits).alias(RANGE))
    return saved(sums.agg(F.sum(TOKENS).alias(TOKENS), F.count("*").alias(ROWS), F.min(PLACE).alias("lo"), F.max(PLACE).alias("hi")), "mix-ranges")


def _ends_in(ranges: DataFrame, left: DataFrame) -> DataFrame:
    """Of each source of left (SOURCE, LEFT: words to take) the range where they end, with LEFT, what is taken of it."""
    earlier = Window.partitionBy(SOURCE).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum(TOKENS).over(earlier), F.lit(0))).join(left, SOURCE)
    here = before.where((F.col("before") < F.col(LEFT)) & (F.col(LEFT) <= F.col("before") + F.col(TOKENS)))
    return saved(here.select(SOURCE, RANGE, (F.col(LEFT) - F.col("before")).alias(LEFT), ROWS, (F.col("lo") < F.col("hi")).alias("open")), "mix-ends")


def cuts(rows: DataFrame, ranges: DataFrame, left: DataFrame, digits: int = DIGITS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Where the words to take end: SOURCE, CUT (a place), LEFT (words that its rows give) and ROWS (how many rows have it).

    Places before CUT are taken whole, places behind it not at all. The range where the words end is found by prefix sums over all ranges of the
    source; while one has more rows than are sorted it is cut into ranges again, at last by whole places. So neither a source nor a key that
    many rows repeat is ever in one task, at any size.
    """
    ends = _ends_in(ranges, left)
    length = digits
    while length < PLACE_DIGITS:
        many = ends.where((F.col(ROWS) > sorted_rows) & F.col("open")).limit(1).count()
        inside = (rows[SOURCE] == ends[SOURCE]) & (F.substring(rows[PLACE], 1, length) == ends[RANGE])
        length = min(PLACE_DIGITS, length + digits) if many else PLACE_DIGITS
        ends = _ends_in(_ranges(rows.join(ends, inside, "left_semi"), length), ends.select(SOURCE, LEFT))
    return ends.select(SOURCE, F.col(RANGE).alias(CUT), LEFT, ROWS)


def mix(
    docs: DataFrame,
    tokens: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    seed: str = "mix",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MAX_EPOCHS,
    digits: int = DIGITS,
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """docs with size, source_size, target and taken, the words that the mix takes of each row, repeats counted. Columns of
    those names are replaced.

    Every row gets a hash-random key. Within a source, rows in key order are taken whole for as many epochs as the
    target holds, then up to the word at which the rest of the target ends. Keys and sizes alone are sorted, in ranges, and added up by prefix sums,
    until the row where each source's target ends is known; the rows themselves, whatever else they hold, are only compared with it and never move.
    A null source is a source of its own, the last; a row with a null doc_id has its key from its other columns; rows with equal
    keys are taken in order of size and a digest of all columns, so that reruns cut the same row; rows that are alike in all columns are taken one
    after the other. Rows of no words (null, empty texts) are taken 0 times; long texts count whole. An empty table gives no rows.
    """
    order = F.concat(F.when(F.col(source).isNull(), "1").otherwise("0"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    # rows without an id are dealt by their content
    digest = F.xxhash64(*docs.columns)
    known = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("~"), digest.cast("string")))
    hex16 = lambda n: F.lpad(F.hex(n), 16, "0")
    place = F.concat(F.md5(F.concat(F.lit(seed + ":"), known)), hex16(F.col(TOKENS)), hex16(digest))
    rows = docs.withColumns({TOKENS: tokens, SOURCE: order}).withColumn(PLACE, place).drop("size", "source_size", "target", "taken")

    narrow = saved(rows.select(SOURCE, PLACE, TOKENS), "mix-places")
    ranges = _ranges(narrow, digits)
    goal = targets(ranges.groupBy(SOURCE).agg(F.sum(TOKENS).alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn(WHOLE, whole).withColumn(LEFT, F.floor(F.col("target") - F.col(WHOLE) * F.col("source_size")))
    goal = saved(goal, "mix-goal")
    found = cuts(narrow, ranges, goal.where(F.col(LEFT) > 0).select(SOURCE, LEFT), digits, sorted_rows)
    # one row a source: Spark broadcasts it by its size in the shared folder, or else shuffles and splits hot sources
    goal = saved(goal.drop(LEFT).join(found, SOURCE, "left"), "mix-cuts")

    rows = rows.join(goal, SOURCE)
    here = F.col(PLACE) == F.col(CUT)
    part = F.when(F.col(PLACE) < F.col(CUT), F.col(TOKENS)).when(here, F.col(LEFT)).otherwise(0)
    kept = [F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")]

    def told(some: DataFrame, part: Column) -> DataFrame:
        return some.select(*kept, F.col(TOKENS).alias("size"), "source_size", "target", (F.col(WHOLE) * F.col(TOKENS) + part).cast("long").alias("taken"))

    if not goal.where(F.col(ROWS) > 1).limit(1).count():
        return told(rows, part)
    # rows that are alike share one place: the words end in one of them
    alike = F.coalesce(here & (F.col(ROWS) > 1), F.lit(False))
    turn = F.row_number().over(Window.partitionBy(SOURCE).orderBy(PLACE)) - 1
    in_turn = F.greatest(F.lit(0), F.least(F.col(TOKENS), F.col(LEFT) - F.col(TURN) * F.col(TOKENS)))
    return told(rows.where(~alike), part).unionByName(told(rows.where(alike).withColumn(TURN, turn), in_turn))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = saved(docs.select("doc_id", "source", token_count(F.col("text")).alias("words")), "mix-sizes")
    return mix(narrow, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source
), r AS (SELECT *, source_size * 2 AS cap, source_size * 2 / w AS ratio FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
           - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
         / CAST(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM r
), c AS (SELECT (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), common * w) END AS target FROM l, c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p
"""

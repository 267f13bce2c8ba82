"""The trie of conversation prefixes: Spark SQL ROLLUP over positional turn columns, block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import saved, scratch
from quantloom.llm.mixing import token_count

#: Turn columns of the first, second and all further blocks.
WIDTHS = (8, 16, 32)
#: Conversations that take their first turns from the same one, and the kinds of how many.
FAMILY, KINDS = 20, 4


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, tokens): turns of each conversation from 1, by turn (null first, ties by key); key is the digest of role and text.

    A null role or text is empty; rows that repeat are turns of their own; rows without a conv_id belong to no conversation. Other
    columns are ignored, texts of any length count whole.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), token_count(F.col("text")).alias("tokens"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key", "tokens")
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), "key", "tokens")


def rebuild(turns: DataFrame, family: int = FAMILY, kinds: int = KINDS) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % family; h = crc32(decimal c) % kinds. Columns as in ``ordered_turns``.

    Where that conversation has fewer turns, all of its turns come first; where there is none, none. Then c's own turns after its first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds).cast("int")
    own = turns.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family})
    sizes = turns.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("size"))
    led = own.select("conv_id", "base", "h").distinct()
    first = turns.where(F.col("pos") < kinds).withColumnRenamed("conv_id", "base")
    head = led.join(first, "base").where("pos <= h").select("conv_id", "pos", "key", "tokens")
    at = F.col("pos") - F.col("h") + F.least(F.col("h").cast("long"), F.coalesce("size", F.lit(0)))
    tail = own.where("pos > h").join(sizes, "base", "left").select("conv_id", at.cast("int").alias("pos"), "key", "tokens")
    return head.unionByName(tail)


def _blocks(longest: int, widths: Sequence[int]) -> list[tuple[int, int]]:
    """(turns before, turn columns) of each block."""
    out, before = [], 0
    while not out or before < longest:
        out.append((before, widths[min(len(out), len(widths) - 1)]))
        before += out[-1][1]
    return out


def _whole(width: int) -> Column:
    """All turn columns in one; keys are of one length and gaps are at the end, so that it tells all paths apart."""
    return F.concat(*(F.coalesce(F.col(f"t{j}"), F.lit(b"")) for j in range(1, width + 1)))


def _digest(path: Column) -> Column:
    return F.unhex(F.sha2(path, 256))


def _at(name: str, width: int) -> Column:
    """Of the columns t1... or k1... the d-th, null for none."""
    return F.get(F.array(*(F.col(f"{name}{j}") for j in range(1, width + 1))), F.col("d") - 1)


def _rolled(rows: DataFrame, width: int, *aggs: Column) -> DataFrame:
    """ROLLUP over base and the turn columns; d, the number of turns of a prefix, from grouping_id. Groups that end in a gap are none."""
    names = [f"t{j}" for j in range(1, width + 1)]
    found = rows.rollup("base", *names).agg(F.grouping_id().alias("gid"), *aggs).withColumn("d", width - F.bit_count("gid")).drop("gid")
    return found.where((F.col("d") == 0) | (F.col("d") > 0) & _at("t", width).isNotNull())


def _nodes(wide: DataFrame, width: int) -> DataFrame:
    """The block's nodes: base, t1..., d, path, parent (its path), conv_id, n_convs and the tokens of the last turn."""
    tokens = [F.max(f"k{j}").alias(f"k{j}") for j in range(1, width + 1)]
    found = _rolled(wide, width, F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *tokens).withColumn("whole", _whole(width))
    above = F.substring("whole", F.lit(1), F.octet_length("t1") * (F.col("d") - 1))
    found = found.withColumns({"path": _digest(F.col("whole")), "parent": _digest(above), "tokens": F.coalesce(_at("k", width), F.lit(0).cast("long"))})
    return found.drop("whole", *(f"k{j}" for j in range(1, width + 1)))


def _wide(turns: DataFrame, block: int, width: int) -> DataFrame:
    """One row for each conversation with a turn of the block: t1... (keys) and k1... (tokens)."""
    pick = lambda j, c: F.max(F.when(F.col("at") == j, F.col(c)))
    each = range(1, width + 1)
    return turns.where(F.col("block") == block).groupBy("conv_id").agg(*(pick(j, "key").alias(f"t{j}") for j in each), *(pick(j, "tokens").alias(f"k{j}") for j in each))


def _blocked(turns: DataFrame, blocks: list[tuple[int, int]], widths: Sequence[int]) -> DataFrame:
    """turns with block (its number) and at (the place in it, from 1)."""
    steady = len(widths) - 1
    first, width = (blocks[steady][0], widths[-1]) if len(blocks) > steady else (1 << 60, 1)
    block, before = F.floor((F.col("pos") - 1 - first) / width) + steady, first + F.floor((F.col("pos") - 1 - first) / width) * width
    for i in reversed(range(min(steady, len(blocks)))):
        end = blocks[i][0] + blocks[i][1]
        block, before = F.when(F.col("pos") <= end, i).otherwise(block), F.when(F.col("pos") <= end, blocks[i][0]).otherwise(before)
    return turns.withColumns({"block": block.cast("int"), "at": (F.col("pos") - before).cast("int")})


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (depth, node, conv_id) as pieces of text."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = []
        for (depth, node), run in groupby(rows, key=lambda r: r[:2]):
            ids = [r[2] for r in run]
            out.append((depth, node, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "node", "first", "text"]) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["depth", "node", "first", "text"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order; one piece is held at a time."""
    now, state = None, None

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.string())], ["depth", "node", "ends_sha256"])

    for batch in batches:
        found = []
        for depth, node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "text")), strict=True):
            if (depth, node) == now:
                state.update(b",")
            else:
                if now is not None:
                    found.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256()
            state.update(text.encode())
        yield out(found)
    if now is not None:
        yield out([(*now, state.hexdigest())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ends (depth, node, conv_id): the digest of each node's ids in order, comma-joined.

    Ranges of ids are sorted and joined side by side, whatever node they belong to; a digest then runs over its node's pieces, of at most one Arrow
    batch of ids each, as a stream.
    """
    rows = ends.select(F.col("depth").cast("long").alias("depth"), F.col("node").cast("long").alias("node"), F.col("conv_id").cast("long").alias("conv_id"))
    order = ["depth", "node", "conv_id"]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, node long, first long, text string")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, "depth long, node long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """One row for each different sequence of first turns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    convs: conv_id, each once. turns: conv_id, pos (from 1, without holes), key (binary of one length), tokens. Conversations without turns are members of
    the root. All prefixes of a block of turn columns are aggregated by one ROLLUP, told apart by grouping_id; longer conversations go on in
    a further block, grouped by the node that they left the one before at. Sums over subtrees are a second ROLLUP over the nodes,
    from the last block to the first. No conversation gives no row.
    """
    turns = saved(turns, "trie-turns")
    longest = turns.agg(F.max("pos")).first()[0] or 0
    blocks = _blocks(longest, widths)
    turns = saved(_blocked(turns, blocks, widths).repartition("block"), "trie-blocks") if len(blocks) > 1 else _blocked(turns, blocks, widths)
    spark = turns.sparkSession
    found, ended = scratch(spark, "trie-found"), scratch(spark, "trie-ended")
    at, nodes = convs.select("conv_id", F.lit(0).cast("long").alias("base")), []
    for i, (before, width) in enumerate(blocks):
        wide = saved(at.join(_wide(turns, i, width), "conv_id", "inner" if i else "left").withColumn("path", _digest(_whole(width))), "trie-wide")
        nodes.append(saved(_nodes(wide, width).where(F.lit(True) if not i else F.col("d") > 0), "trie-nodes"))
        # the last node of each conversation in this block
        left = wide.select("conv_id", "base", "path").join(nodes[i].select("base", "path", "d", F.col("conv_id").alias("node")), ["base", "path"])
        left = left.select("conv_id", "node", (F.col("d") + before).alias("depth"))
        if i + 1 < len(blocks):
            on = turns.where((F.col("block") == i + 1) & (F.col("at") == 1)).select("conv_id", F.lit(True).alias("on"))
            left = saved(left.join(on, "conv_id", "left"), "trie-left")
            at = left.where("on").select("conv_id", F.col("node").alias("base"))
            left = left.where("on IS NULL").drop("on")
        left.write.mode("append").parquet(ended)
    below = None
    for i in reversed(range(len(blocks))):
        before, width = blocks[i]
        mine = nodes[i]
        inner = mine.where("d > 0" if not i else "d > 1").groupBy("base", F.col("parent").alias("path")).agg(F.count("*").alias("__inner"))
        mine = mine.join(inner, ["base", "path"], "left")
        if below is None:
            mine = mine.withColumns({"__outer": F.lit(None).cast("long"), "__leaves": F.lit(0).cast("long"), "__saved": F.lit(0).cast("long")})
        else:
            mine = mine.join(below.withColumnsRenamed({"base": "conv_id", "children": "__outer", "leaves": "__leaves", "saved": "__saved"}).withColumn("d", F.lit(width)), ["conv_id", "d"], "left")
        mine = mine.withColumn("n_children", F.coalesce("__inner", "__outer", F.lit(0)).cast("long"))
        mine = saved(mine.withColumns({"__leaves": F.coalesce("__leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "__saved": F.coalesce("__saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("tokens")}), "trie-counted")
        sums = _rolled(mine.drop("d"), width, F.sum("__leaves").alias("n_leaves"), F.sum("__saved").alias("saved_tokens"))
        sums = saved(sums.withColumn("path", _digest(_whole(width))).select("base", "path", "d", "n_leaves", "saved_tokens"), "trie-sums")
        parents = mine.select("base", F.col("path").alias("parent"), F.col("conv_id").alias("__up"))
        whole = mine.join(sums.drop("d"), ["base", "path"]).join(parents, ["base", "parent"], "left")
        up = F.when(F.col("d") > 1, F.col("__up")) if i else F.when(F.col("d") > 0, F.col("__up"))
        up = F.coalesce(up, F.col("base")) if i else up
        whole.select("conv_id", (F.col("d") + before).cast("long").alias("depth"), up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens").write.mode("append").parquet(found)
        below = sums.where("d = 0").select("base", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).join(mine.where("d = 1").groupBy("base").agg(F.count("*").alias("children")), "base")
    digests = ends_digest(spark.read.parquet(ended)).withColumnRenamed("node", "conv_id")
    return spark.read.parquet(found).join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = saved(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-ordered")
    return prefix_trie(turns.select("conv_id").distinct(), rebuild(turns))


OP13_SQL = """
WITH o AS (
  SELECT conv_id, role, text, sha256(concat(CAST(length(coalesce(role, '')) AS VARCHAR), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, turn FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT conv_id, k, tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos FROM o),
c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % 20 AS base, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, t.pos, t.k, t.tokens FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.size, 0)), t.k, t.tokens FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.base
), p AS (SELECT conv_id, pos, tokens, list(k) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM r),
m AS (SELECT conv_id, pos AS depth, tokens, path FROM p UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT path, depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(tokens) AS own, string_agg(CASE WHEN depth = e.last THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id) AS ends FROM m JOIN e ON e.conv_id = m.conv_id GROUP BY path, depth),
k AS (SELECT n.path, count(x.path) AS n_children FROM n LEFT JOIN n x ON x.depth = n.depth + 1 AND x.path[1:n.depth] = n.path GROUP BY n.path),
s AS (SELECT a.path, CAST(sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(a.own) AS BIGINT) AS saved_tokens FROM (SELECT path AS whole, own, path[1:d] AS path FROM n, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d)) a JOIN k ON k.path = a.whole GROUP BY a.path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
"""

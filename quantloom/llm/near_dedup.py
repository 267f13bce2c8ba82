"""Near-duplicates by ProbMinHash sketches of weighted five-word shingles, banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.arrays import counted, jaccard, mix64, shingle_set, shingles, slices, words
from quantloom.llm.common import WORD_BYTES, saved
from quantloom.llm.components import connected_components

SIMILARITY = 0.8
#: A pair at the threshold shares all rows of one band or more with a probability of 0.9991, by the bands of unit weights.
BANDS, ROWS = 30, 7
#: Members that one task compares with one pivot.
BLOCK = 512
#: Rounds of pivots before the exact join, at most; they end as soon as one joins nothing.
PIVOTS = 4
#: A hot key is dealt to so many groups, each of which has a copy of the small side's row.
SPREAD = 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Sketches (n_docs x m): for each register the item whose arrival there comes first.

    Each item of weight w is a Poisson process of rate w, driven by its hash alone, whose arrivals fall on
    random registers. Two sketches agree in a register with the probability Jaccard similarity of the weighted sets.
    An item's process ends as soon as its next arrival is later than the latest of the text's first arrivals.
    Registers are drawn by 11 bits, so there are 2048 at most.
    """
    if not 0 < m <= 2048:
        raise ValueError(f"m must be from 1 to 2048: {m}")
    first = np.full(n_docs * m, np.inf)
    held = np.zeros(n_docs * m, np.uint64)
    size = np.bincount(doc, minlength=n_docs)
    # so many arrivals of each item at a time that few rounds fill all registers, for short texts as well
    step = np.ceil(np.log2(np.maximum(1, m / np.maximum(size, 1)))).astype(np.int64)
    for s in np.unique(step[size > 0]):
        live = step[doc] == s
        d, h, w, t, k = doc[live], item[live], weight[live], np.zeros(live.sum()), 0
        c = 1 << int(s)
        while len(d):
            x = mix64(h[:, None] + np.arange(k + 1, k + c + 1, dtype=np.uint64) * _GOLD)
            gap = -np.log1p(-((x >> np.uint64(11)) * 2.0**-53)) / w[:, None]
            at = t[:, None] + np.cumsum(gap, axis=1)
            register = d[:, None] * m + (((x & np.uint64(2047)) * np.uint64(m)) >> np.uint64(11)).astype(np.int64)
            early = at < first[register]
            r, a, who = register[early], at[early], np.broadcast_to(h[:, None], at.shape)[early]
            np.minimum.at(first, r, a)
            won = a == first[r]
            held[r[won]] = who[won]
            last = first.reshape(n_docs, m).max(axis=1)
            t = at[:, -1]
            on = t < last[d]
            d, h, w, t, k = d[on], h[on], w[on], t[on], k + c
    return held.reshape(n_docs, m)


def _bands(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    sketch = prob_minhash(doc, item, weight, n, bands * rows).reshape(n, bands, rows)
    value = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for k in range(rows):
        value = mix64(value * _GOLD + sketch[:, :, k])
    return value.view(np.int64)


def sketch_slice(texts: list[bytes], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of different shingles of each text, and its band values.

    A text that repeats shingles also has the bands of unit weights, since links are plain Jaccard, which its weights
    can hide. In other texts all weights are 1, so these bands are the same.
    """
    n = len(texts)
    doc, h, _, _ = words(texts)
    d, s, count = counted(*shingles(doc, h))
    values = list(_bands(d, s, 1.0 + np.log(np.maximum(count, 1)), n, bands, rows))
    again = np.unique(d[count > 1])
    of = np.isin(d, again)
    plain = _bands(np.searchsorted(again, d[of]), s[of], np.ones(of.sum()), len(again), bands, rows)
    for i, row in zip(again, plain, strict=True):
        values[i] = np.union1d(values[i], row)
    return np.bincount(d, minlength=n), values


def _sketcher(bands: int, rows: int):
    @F.pandas_udf("same binary, n long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        same, n, values = [], [], []
        for _, run in slices(list(texts)):
            same += [hashlib.md5(b" ".join(t.translate(WORD_BYTES).split())).digest() for t in run]
            k, v = sketch_slice(run, bands, rows)
            n += k.tolist()
            values += [row if c else [] for row, c in zip(v, k, strict=True)]
        return pd.DataFrame({"same": same, "n": n, "bands": values})

    return sketch


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, same (equal for texts of equal words), n (different shingles) and bands, as a table in the shared folder."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    found = docs.select(F.col(doc_id).alias("doc_id"), _sketcher(bands, rows)(body).alias("s"))
    return saved(found.select("doc_id", "s.same", "s.n", "s.bands"), "sketches")


def dealt_to(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SPREAD)).cast("int")


def spread(small: DataFrame) -> DataFrame:
    """small once for each of SPREAD groups, so that no task gets all rows of a hot key."""
    return small.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def verify(pairs: DataFrame, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """pairs (a, b) with their exact similarity: shared over all different shingles of the whole texts.

    The members of a pivot b are dealt into blocks; the pivot's text goes once to each block and is read first, then the
    members stream past it, so no task holds a group.
    """
    of = pairs.select("a", "b").distinct().withColumns({"part": F.pmod(F.xxhash64("a"), F.lit(1 << 16)).cast("int"), "lane": dealt_to("a")})
    of = saved(of, "pairs")
    blocks = of.groupBy("b").agg(F.count("*").alias("n")).select("b", F.expr(f"cast(ceil(n / {block}) as int)").alias("parts"))
    member = of.join(spread(blocks).hint("merge"), ["b", "lane"]).select("b", F.expr("part % parts").alias("part"), F.lit(1).alias("role"), F.col("a").alias("id"))
    pivot = blocks.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("b").alias("id"))
    rows = member.unionByName(pivot).join(docs, "id")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, mine = None, None
        for batch in batches:
            out = []
            for b, part, role, i, t in zip(batch["b"], batch["part"], batch["role"], batch["id"], batch["text"], strict=True):
                if role == 0:
                    at, mine = (b, part), shingle_set(t)
                elif at == (b, part):
                    out.append((i, b, jaccard(shingle_set(t), mine)))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    dealt = rows.repartition("b", "part").sortWithinPartitions("b", "part", "role")
    return dealt.select("b", "part", "role", "id", "text").mapInPandas(compare, "a long, b long, similarity double")


def rare_shingles(docs: DataFrame, similarity: float) -> DataFrame:
    """(id, n, s, ahead): the rarest of each text's n different shingles, so many that two texts of ``similarity`` share one.

    A text misses less than a share of 1 - similarity of a similar text's shingles, so one of its rarest such share and one more stands
    in both. Rarity counts these texts alone; ``ahead`` is the number of a text's shingles that are rarer still.
    """

    @F.pandas_udf("array<long>")
    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in texts])

    each = saved(docs.select("id", F.explode(listed("text")).alias("s")).distinct(), "shingles")
    often = each.groupBy("s").agg(F.count("*").alias("often"))
    ranked = each.join(often, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "s"))).alias("all"))
    n = F.size("all")
    few = F.slice("all", 1, n - F.ceil(n * similarity - 1e-9).cast("int") + 1)
    return ranked.select("id", n.alias("n"), F.posexplode(few).alias("ahead", "x")).where("x.often > 1").select("id", "n", F.col("x.s").alias("s"), "ahead")


def _placed(mates: DataFrame, parts: DataFrame | None) -> DataFrame:
    """mates with component; a text without links is its own."""
    if parts is None:
        return mates.withColumn("component", F.col("node"))
    return mates.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))


def _split(placed: DataFrame, turn: int) -> DataFrame:
    """bucket, pivot and goal (its component) of the buckets that hold several components; each turn picks another pivot."""
    order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
    found = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("node", order).alias("pivot"), F.min_by("component", order).alias("goal"))
    return found.where("lo < hi").select("bucket", "pivot", "goal")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links of ``similarity`` or more lead to) and class_size.

    Texts of equal words are one node. Texts that share a band are candidates. In rounds, the texts of each band are compared with one
    pivot, if that is in another component, and what is alike is joined; so a group of any size costs as many comparisons in a round
    as it has members. Of bands that then still hold several components, all texts are looked at again: those of different components that
    share one of their rarest shingles, as all similar texts do, are compared. So no link is left out that could join two classes.
    Texts of under five words are one shingle. Texts without words (null, empty) and rows without a doc_id are alone in their
    class. Rows that share a doc_id count as one document. doc_id must be a whole number. Long texts cost as their words; no text is
    cut. Other columns of docs, whatever their names, are not looked at. An empty table gives no rows.
    """
    drawn = sketches(docs, doc_id, text, bands, rows)
    nodes = saved(drawn.where("n > 0 AND doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("node")), "nodes")
    own = drawn.join(nodes, (drawn["same"] == nodes["same"]) & (drawn["doc_id"] == nodes["node"])).select("node", F.explode("bands").alias("bucket"))
    shared = own.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    mates = saved(own.join(shared, "bucket").distinct(), "mates")
    # only the texts of candidates are read again; a merge join, so that it works alike at every size
    bodies = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    bodies = saved(bodies.join(mates.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi"), "candidates")

    parts, tried = None, None
    for turn in range(PIVOTS):
        placed = _placed(mates, parts)
        open_ = placed.join(_split(placed, turn), "bucket").where("component <> goal")
        stars = open_.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        if tried is not None:
            stars = stars.join(tried, ["a", "b"], "left_anti")
        found = saved(verify(stars, bodies), "tried")
        tried = found.select("a", "b") if tried is None else saved(tried.unionByName(found.select("a", "b")), "tried-all")
        links = found.where(F.col("similarity") >= similarity).select("a", "b")
        if links.isEmpty():
            break
        parts = _joined(parts, links)
    parts = _exact(mates, parts, tried, bodies, similarity)

    of = nodes if parts is None else nodes.join(parts, "node", "left")
    of = of.select("same", (F.col("node") if parts is None else F.coalesce("component", "node")).alias("class_id"))
    found = drawn.select("doc_id", F.when(F.col("n") > 0, F.col("same")).alias("same")).join(of, "same", "left")
    found = found.select("doc_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))
    found = found.withColumn("lane", F.coalesce(dealt_to("doc_id"), F.lit(0)))
    sizes = found.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1")
    return found.join(spread(sizes).hint("merge"), ["class_id", "lane"], "left").select("doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def _joined(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """node and component with the further links; a component is its smallest node."""
    if parts is not None:
        links = links.unionByName(parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
    return saved(connected_components(links), "components")


def _exact(mates: DataFrame, parts: DataFrame | None, tried: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame | None:
    """parts with all links between texts of bands that hold several components."""
    placed = _placed(mates, parts)
    rest = placed.join(_split(placed, 0).select("bucket"), "bucket").select(F.col("node").alias("id"), "component").distinct()
    rest = saved(rest.join(bodies, "id"), "rest")
    rare = rare_shingles(rest.select("id", "text"), similarity).join(rest.select("id", "component").distinct(), "id")
    rare = saved(rare, "rare")
    x, y = rare.alias("x"), rare.alias("y")
    # what may still be shared from this shingle on, in either text
    room = F.least(F.col("x.n") - F.col("x.ahead"), F.col("y.n") - F.col("y.ahead"))
    near = (F.col("x.s") == F.col("y.s")) & (F.col("x.component") < F.col("y.component")) & (room * (1 + similarity) >= (F.col("x.n") + F.col("y.n")) * similarity - 1e-9)
    more = x.join(y, near).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    more = saved(more.join(tried, ["a", "b"], "left_anti"), "more")
    if more.isEmpty():
        return parts
    links = saved(verify(more, bodies).where(F.col("similarity") >= similarity).select("a", "b"), "late")
    return parts if links.isEmpty() else _joined(parts, links)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose class has a smaller doc_id; rows without a doc_id stay."""
    found = classes(docs.select(doc_id, text), doc_id, text)
    goes = saved(found.where("doc_id > class_id").select(F.col("doc_id").alias("__gone")).distinct(), "goes")
    return docs.join(goes, docs[doc_id] == goes["__gone"], "left_anti").select(*docs.columns)


def op5_probminhash(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

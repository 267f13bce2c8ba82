"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD_BYTES, saved

WINDOW = 13
#: Bytes of benchmark text that one automaton takes (about ten times as much memory). Larger benchmarks go in several.
BLOCK_BYTES = 64 << 20
#: Different words up to which one character stands for a word; beyond, two do.
ONE_CHARACTER = 1_000_000
#: Words of the original text (A-Z included), for offsets.
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCAN = "__scan"
_cache: dict = {}


class Benchmark:
    """The automaton over a benchmark. Each different word is a character (or a pair from two alphabets).

    Every window of an item holds one of the item's blocks of half a window that start at multiples of their length, so these
    blocks are the patterns; a match is extended word by word to the run that item and text have in common, and counts if it is a window
    or longer. The trie has a node for each word of the benchmark, not for each word of each window. A short item is one pattern.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        split = [(item, text.translate(WORD_BYTES).split()) for item, text in items]
        vocabulary = {w for _, ws in split for w in ws}
        self.width = 1 if len(vocabulary) <= ONE_CHARACTER else 2
        self.code = {w: self._character(i) for i, w in enumerate(vocabulary)}
        self.window, self.ids, self.coded = window, [], []
        patterns: dict[str, list[tuple[int, int]]] = {}
        block = (window + 1) // 2
        for item, ws in split:
            if not ws:
                continue
            coded, k = "".join(map(self.code.__getitem__, ws)), len(self.ids)
            self.ids.append(item)
            self.coded.append(coded)
            size = len(ws) if len(ws) < window else block
            for i in range(0, len(ws) - size + 1, size):
                patterns.setdefault(coded[i * self.width : (i + size) * self.width], []).append((k, i * self.width))
        self.found = None
        if patterns:
            self.found = ahocorasick.Automaton()
            for pattern, of in patterns.items():
                self.found.add_word(pattern, (len(pattern), of))
            self.found.make_automaton()

    def _character(self, i: int) -> str:
        char = lambda k: chr(k + 1 if k < 0xD000 else k + 0x2000)  # noqa: E731  no surrogates
        return char(i) if self.width == 1 else char(i // 500_000) + char(500_000 + i % 500_000)

    def runs(self, coded: str) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals that windows cover (they may overlap), and the items of these windows."""
        out, of, seen, wide = [], set(), {}, self.width
        for last, (size, places) in self.found.iter(coded):
            lo, hi = last + 1 - size, last + 1
            for k, at in places:
                item = self.coded[k]
                if len(item) < self.window * wide:
                    out.append((lo // wide, hi // wide))
                    of.add(k)
                    continue
                # what this item has in common here may be known from a block before
                if seen.get((k, lo - at), 0) >= hi:
                    continue
                left, right, end = 0, 0, at + size
                while left < lo and left < at and coded[lo - left - 1] == item[at - left - 1]:
                    left += 1
                while hi + right < len(coded) and end + right < len(item) and coded[hi + right] == item[end + right]:
                    right += 1
                seen[k, lo - at] = hi + right
                a, b = -(-(lo - left) // wide), (hi + right) // wide
                if b - a >= self.window:
                    out.append((a, b))
                    of.add(k)
        return out, of


def scan_text(text: bytes, bench: Benchmark) -> tuple:
    """n_words; start and end words of the hit runs; n_items and the items; the runs' code-point spans in the original."""
    text_words = text.translate(WORD_BYTES).split()
    if bench.found is None:
        return len(text_words), [], [], 0, [], [], []
    get, none = bench.code.get, "\0" * bench.width
    found, of = bench.runs("".join([get(w, none) for w in text_words]))
    if not found:
        return len(text_words), [], [], 0, [], [], []
    hit = np.zeros(len(text_words) + 1, np.int64)
    np.add.at(hit, [lo for lo, _ in found], 1)
    np.add.at(hit, [hi for _, hi in found], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)]))
    lo, hi = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
    at = [m.span() for m in RAW_WORD.finditer(text.decode("utf-8", "replace"))]
    items = {bench.ids[k] for k in of}
    return len(text_words), lo, hi, len(items), sorted(i for i in items if i is not None), [at[i][0] for i in lo], [at[i - 1][1] for i in hi]


FIELDS = ("n_words", "lo", "hi", "n_items", "item", "start", "end")


def _scanner(spark, items: list[tuple[str | None, bytes]], window: int):
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf("n_words long, lo array<int>, hi array<int>, n_items long, item array<string>, start array<int>, end array<int>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        if _cache.get("of") != key:
            _cache["of"], _cache["automaton"] = key, Benchmark(sent.value, window)
        return pd.DataFrame([scan_text(t or b"", _cache["automaton"]) for t in texts], columns=list(FIELDS))

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the column SCAN: n_words, hit runs of words (lo, hi), n_items, item and the runs' spans (start, end) in the original.

    The benchmark is read to the driver and sent to the tasks as one automaton, and each text is scanned once. A benchmark beyond
    ``block_bytes`` goes in several, and the runs are put together per text (spans of different automata may then overlap).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    if n == 1:
        return docs.withColumn(SCAN, _scanner(spark, [(r[0], bytes(r[1])) for r in items.collect()], window)(body))
    key = F.sha2(body, 256)
    parts = []
    for k in range(n):
        block = [(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]
        one = docs.select(key.alias("__key"), _scanner(spark, block, window)(body).alias(SCAN)).where(F.size(f"{SCAN}.lo") > 0)
        parts.append(saved(one.dropDuplicates(["__key"]), "scan"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    joined = [F.flatten(F.collect_list(f"{SCAN}.{c}")).alias(c) for c in ("lo", "hi", "item", "start", "end")]
    unnamed = F.max((F.col(f"{SCAN}.n_items") > F.size(f"{SCAN}.item")).cast("long"))
    merged = hits.groupBy("__key").agg(F.first(f"{SCAN}.n_words").alias("n_words"), unnamed.alias("unnamed"), *joined)
    merged = merged.withColumn("item", F.array_sort(F.array_distinct("item"))).withColumn("n_items", F.size("item") + F.col("unnamed"))
    merged = merged.select("__key", F.struct(*FIELDS).alias("__found"))
    none = _scanner(spark, [], window)(body)
    return docs.withColumn("__key", key).join(merged, "__key", "left").withColumn(SCAN, F.coalesce("__found", none)).drop("__key", "__found")


OUTPUT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (start, end in the original text's code points).

    Columns of those names are replaced, others stay. Null and empty texts have no words and are clean; texts of any length are scanned
    whole. Without items, all texts are clean. Items of repeated ids count once; items without words have no window. Items without an id
    hit like others and count as one item, which items_sha256 does not name. An empty table gives no rows.
    """
    found = scan(docs.drop(*OUTPUT), benchmark, text, **how)
    runs = F.array_sort(F.arrays_zip(F.col(f"{SCAN}.lo").alias("lo"), F.col(f"{SCAN}.hi").alias("hi")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        new = F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], acc["end"]))
        return F.struct(F.greatest(acc["end"], x["hi"]).alias("end"), (acc["n"] + new).alias("n"))

    spans = F.array_sort(F.arrays_zip(F.col(f"{SCAN}.start").alias("start"), F.col(f"{SCAN}.end").alias("end")))
    found = found.withColumns({"n_words": F.col(f"{SCAN}.n_words"), "n_hit": F.aggregate(runs, zero, step, lambda acc: acc["n"]), "n_items": F.col(f"{SCAN}.n_items").cast("long"), "items_sha256": F.sha2(F.array_join(f"{SCAN}.item", ","), 256)})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).withColumn("hit_spans", spans).drop(SCAN)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), h AS (SELECT d.rid, d.i, d.n, win.item_id FROM dwin d JOIN win ON d.n = win.n AND d.s = win.s),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos ON dw.rid = pos.rid LEFT JOIN it ON dw.rid = it.rid
"""

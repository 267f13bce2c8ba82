"""A hierarchical Pitman-Yor language model over words: context restaurants that share the unigram restaurant as their parent.

Documents are taken together in chunks, with tables of their different words and word pairs. Chunks and shards of the hashed key space exchange sorted
arrays: a chunk sends its keys with its own counts, a shard adds up what all chunks sent and answers each in its own order. A key comes once from a
chunk at most, so that no word, however frequent, makes a shard large, and the chunks, which are bucketed, never move.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quantloom.llm.arrays import mix64, slices, words
from quantloom.llm.common import saved, scratch
from quantloom.llm.seating import base_probability, pack, pack_keys, predictive, reseat, unpack, unpack_keys

#: Bytes of text that a chunk takes together (or one longer text).
CHUNK_BYTES = 5 << 20
#: Bytes of text whose words are found together, and documents that go to Python together: more would only take memory.
WORDS_BYTES, BATCH = 512 << 10, 256
#: Tokens for which there is one shard of keys.
SHARD_TOKENS = 1 << 20
#: Buckets of chunks for each shuffle partition.
SPREAD = 2
#: Gibbs sweeps over all restaurants, and how many of the last are averaged.
SWEEPS, KEEP = 3, 2
THETA = 1.0
#: Bytes of UTF-8 text: A-Z become a-z, blanks become spaces.
BLANKS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
#: The end of a text, which is also the context of its first word.
END = np.uint64(0x9D39247E33776D41)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _ints(x) -> bytes:
    return np.ascontiguousarray(x, np.int32).tobytes()


def _of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32)


def _chunk(rows: list[tuple]) -> tuple:
    """ids, held, sizes (words of each text), words (sorted hashes) and tokens (their places), each text closed by END."""
    texts = [r[2] or b"" for r in rows]
    sizes, found = np.zeros(len(rows), np.int64), []
    for first, run in slices(texts, WORDS_BYTES):
        doc, h, _, _ = words(run, BLANKS)
        sizes[first : first + len(run)] = np.bincount(doc, minlength=len(run))
        found.append(h)
    ends = np.cumsum(sizes + 1) - 1
    seq = np.full(int(sizes.sum()) + len(rows), END)
    inside = np.ones(len(seq), bool)
    inside[ends] = False
    seq[inside] = np.concatenate(found)
    # far fewer words than tokens: only the words are sorted
    first, found = pd.factorize(seq)
    order = np.argsort(found)
    known, place = found[order], np.empty(len(found), np.int32)
    place[order] = np.arange(len(found), dtype=np.int32)
    tokens = place[first]
    return [r[0] for r in rows], [r[1] for r in rows], _ints(sizes), pack_keys(known), _ints(tokens)


def encode(docs: DataFrame, doc_id: str, text: str, held: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunks of docs: chunk, ids, held, sizes, words and tokens."""
    kind = docs.select(doc_id).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2] or b"") + 1
                if size >= chunk_bytes:
                    yield made(number, rows, batch.schema)
                    number, rows, size = number + 1, [], 0
            schema = batch.schema
        if rows:
            yield made(number, rows, schema)

    def made(number: int, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        ids, held_out, *binary = _chunk(rows)
        arrays = [pa.array([number]), pa.array([ids], pa.list_(schema.field(0).type)), pa.array([held_out], pa.list_(pa.bool_())), *(pa.array([b], pa.binary()) for b in binary)]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "held", "sizes", "words", "tokens"])

    rows = docs.select(F.col(doc_id), held.alias("held"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, sizes binary, words binary, tokens binary")


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, each key's place among them, and where each one stands first or later."""
    # places in the keys' low bits: sorting numbers is several times faster than sorting places by them
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():  # different keys whose upper bits are equal
        order = np.argsort(keys)
        ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], at, order[new]


def _followed(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, tokens, the word before each token and the key of this pair."""
    known, tokens = unpack_keys(row.pop("words")), _of(row.pop("tokens"))
    before = np.empty_like(tokens)
    before[:1], before[1:] = np.searchsorted(known, END), tokens[:-1]
    return known, tokens, before, mix64((known * _ODD)[before] + known[tokens])


def _pair_keys(row: dict) -> np.ndarray:
    """The keys of _pairs alone, for which sorting does."""
    return _runs(_followed(row)[3])[0]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and how often each stands there."""
    ranked = np.sort(keys)
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return ranked[first], np.diff(first, append=len(ranked))


def _trained(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The keys of _pairs, and how often the training texts have each."""
    followed, sizes = _followed(row)[3], _of(row.pop("sizes"))
    keys, own = _runs(followed)
    held, n = _runs(followed[np.repeat(np.array(row["held"], bool), sizes + 1)])
    own[np.searchsorted(keys, held)] -= n
    return keys, own


def _pairs(row: dict) -> dict:
    """The chunk's different (previous, current) word pairs in order of their keys, each token's pair, and which tokens are the training texts'."""
    (known, tokens, before, followed), sizes = _followed(row), _of(row.pop("sizes"))
    keys, at, some = _different(followed)
    train = np.repeat(~np.array(row["held"], bool), sizes + 1)
    return {"words": known, "tokens": tokens, "sizes": sizes, "train": train, "u": before[some], "w": tokens[some], "keys": keys, "at": at}


def _pieces(keys: np.ndarray, bits: int, values: list[np.ndarray]) -> list[tuple]:
    """(shard, keys, a, b, c) of sorted keys, for the shards that have any; of up to three values, those behind are empty."""
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    return [(int(shard[i]), pack_keys(keys[i:j]), *(pack(v[i:j]) for v in values), *[b""] * (3 - len(values))) for i, j in zip(cut[:-1], cut[1:], strict=True) if j > i]


def _answers(found: list[dict] | None, name: str) -> np.ndarray:
    """One value of all shards' answers to a chunk, in order of its keys."""
    return np.concatenate([unpack(x[name]) for x in found]) if found else np.zeros(0, np.int64)


def _each(rows: DataFrame, f: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """f of each chunk, whose rows become rows of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = list(f(batch.slice(i, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=arrow, preserve_index=False)

    parsed = StructType.fromDDL(schema)
    names, arrow = parsed.names, to_arrow_schema(parsed)
    return rows.mapInArrow(run, schema)


PIECE = "shard long, chunk long, keys binary, a binary, b binary, c binary"
ANSWER = "shard long, chunk long, a binary, b binary, c binary, d binary, s1 long, s2 long, s3 long, s4 long, s5 long, s6 long"


def _exchange(pieces: DataFrame, settle: Callable[..., list[np.ndarray]]) -> DataFrame:
    """The shards' answers to pieces. settle takes the shard's number, of each entry its key's place among the different keys, its chunk and its key, and the sums of
    a, b and c, where there are any, over each key; it gives up to four values of each entry and up to six sums of the shard."""

    def shard(got: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_keys(k) for k in got["keys"]]
        sizes = [len(k) for k in keys]
        whole = np.concatenate(keys)
        different, at, _ = _different(whole)
        columns = [np.concatenate([unpack(x) for x in got[n]]) for n in "abc" if got[n].iloc[0]]
        sums = [np.bincount(at, weights=x, minlength=len(different)).astype(np.int64) for x in columns]
        values, total = settle(int(got["shard"].iloc[0]), at, np.repeat(got["chunk"].to_numpy(), sizes), whole, columns, sums)
        out, i = [], 0
        for chunk, n in zip(got["chunk"], sizes, strict=True):
            parts = [pack(v[i : i + n]) for v in values] + [b""] * (4 - len(values))
            said = [*total, *[0] * (6 - len(total))] if not i else [0] * 6
            out.append((got["shard"].iloc[0], chunk, *parts, *said))
            i += n
        return pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return pieces.groupBy("shard").applyInPandas(shard, ANSWER)


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    # no shuffle: answers are bucketed as the chunks are
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "a", "b", "c", "d"))).alias(name))


def _sums(answers: DataFrame) -> list[int]:
    return [x or 0 for x in answers.agg(*(F.sum(f"s{i}") for i in range(1, 7))).first()]


def _owned(shard, at, chunk, keys, columns, sums):
    """Counts of pairs over all training texts; one of the chunks that train on a pair, chosen by hash, owns it."""
    # lots of one key differ, and the least of its chunks that train on it wins
    lot = np.where(columns[0] > 0, mix64(keys ^ mix64(chunk.astype(np.uint64) + _ODD)), np.uint64(2**64 - 1))
    least = np.full(len(sums[0]), np.uint64(2**64 - 1))
    np.minimum.at(least, at, lot)
    owner = ((columns[0] > 0) & (lot == least[at])).astype(np.int64)
    return [sums[0][at] * 2 + owner], [int((sums[0] == 1).sum()), int((sums[0] == 2).sum())]


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def _restaurant(sweep: int, g: dict):
    """The unigram restaurant's part in a shard: its customers are the tables of all contexts (b); contexts' tables (a) and tokens (c) are added up, too."""

    def settle(shard, at, chunk, keys, columns, sums):
        tables, customers, count = sums
        t = (customers > 0).astype(np.int64)
        if sweep:
            rng = np.random.default_rng([17, sweep, shard])
            p = 1 / (g["words"] + 1)
            some = np.flatnonzero(customers)
            others = np.full(len(some), max(0.0, g["tables"] - 1))
            t[some] = reseat(customers[some], (g["theta"] + g["d1"] * others) * p, np.full(len(some), g["d1"] * p), g["d1"], rng)
        said = [int(x) for x in (customers.sum(), t.sum(), (count > 0).sum(), count.sum(), (customers == 1).sum(), (customers == 2).sum())]
        return [x[at] for x in (tables, customers, count, t)], said

    return settle


def _state(sums: list[int], d2: float, theta: float, before: dict | None) -> dict:
    customers, tables, known, tokens, ones, twos = sums
    return {"theta": theta, "d1": before["d1"] if before else _discount(ones, twos), "d2": d2, "customers": customers, "tables": tables, "words": known, "tokens": tokens}


def _added(known: int, place: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.bincount(place, weights=t, minlength=known).astype(np.int64)


STATE = "chunk long, words binary, u binary, w binary, n binary, t binary, one_u binary, one_w binary, count binary, kept array<binary>, pieces array<struct<shard:long,keys:binary,a:binary,b:binary,c:binary>>"


def _seated(row: dict, known, u, w, n, t, ones, count, bits: int, kept: list[bytes]) -> tuple:
    sums = [ones[0] + _added(len(known), u, t), ones[1] + _added(len(known), w, t), count]
    pieces = [dict(zip(("shard", "keys", "a", "b", "c"), p, strict=True)) for p in _pieces(known, bits, sums)]
    return row["chunk"], row["words"], pack(u), pack(w), pack(n), pack(t), pack(ones[0]), pack(ones[1]), pack(count), kept, pieces


def fit_and_score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, keep: int = KEEP, theta: float = THETA, chunk_bytes: int = CHUNK_BYTES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, learning from those where ``held`` is false.

    Words are what blanks separate, A-Z lower-cased, and one end of each text; null and empty texts have the end alone. Words are told apart by 64-bit hashes. The model
    has a restaurant for each previous word and the unigram restaurant as the parent of all. Seating starts with one table for each word of a restaurant;
    a sweep draws every restaurant's seating anew, word by word, given the others' tables as the last sweep left them, and then the
    parent's, whose customers these tables are. Probabilities are averaged over the last ``keep`` sweeps (3 at most). Discounts come from how many words have one
    and two customers; the strength is a parameter. Rows that repeat are texts of their own; other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= keep <= min(3, sweeps):
        raise ValueError(f"keep must be from 1 to 3 and no more than sweeps: {keep}, {sweeps}")
    spark = docs.sparkSession
    base = f"lm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{scratch(spark, base)}'")
    # so many that a task has few of the chunks, whose rows are large
    n_buckets = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def bucketed(df: DataFrame, name: str, move: bool = False) -> DataFrame:
        # chunks stay where they are: only answers are shuffled, once, to their buckets
        df = df.repartition(n_buckets, "chunk") if move else df
        # a dictionary of a chunk's arrays, which never repeat, would only be hashed and given up
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").bucketBy(n_buckets, "chunk").saveAsTable(f"{base}.{name}")
        return spark.table(f"{base}.{name}")

    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    try:
        chunks = bucketed(encode(docs, doc_id, text, held, chunk_bytes), "chunks")
        # from here on a row is a whole chunk: one at a time goes to Python
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        return _fitted(docs, chunks, bucketed, base, doc_id, sweeps, keep, theta, shard_tokens)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def _fitted(docs: DataFrame, chunks: DataFrame, bucketed: Callable[..., DataFrame], base: str, doc_id: str, sweeps: int, keep: int, theta: float, shard_tokens: int) -> DataFrame:
    """The scores of the chunks' documents; all that was gathered on the way is dropped with the database."""
    spark = docs.sparkSession
    total = chunks.agg(F.sum(F.octet_length("tokens") / 4)).first()[0] or 0
    bits = max(0, min(40, int(np.ceil(np.log2(max(1.0, total / shard_tokens))))))

    def ask(row: dict) -> Iterator[tuple]:
        keys, own = _trained(row)
        return ((p[0], row["chunk"], *p[1:]) for p in _pieces(keys, bits, [own]))

    counted = bucketed(_exchange(_each(chunks, ask, PIECE), _owned), "pairs", move=True)
    d2 = _discount(*_sums(counted)[:2])

    def seat(row: dict) -> Iterator[tuple]:
        x = _pairs(row)
        got = _answers(row.pop("pairs"), "a")
        owned, n = got % 2 == 1, got // 2
        known, count = x["words"], np.bincount(x["tokens"][x["train"]], minlength=len(x["words"]))
        single, more = owned & (n == 1), owned & (n > 1)
        ones = [np.bincount(x[k][single], minlength=len(known)) for k in "uw"]
        row["words"] = pack_keys(known)
        yield _seated(row, known, x["u"][more], x["w"][more], n[more], np.ones(int(more.sum()), np.int64), ones, count, bits, [])

    def totals(state: DataFrame, sweep: int, g: dict | None) -> tuple[DataFrame, dict]:
        pieces = state.select("chunk", F.explode("pieces").alias("p")).select("p.shard", "chunk", "p.keys", "p.a", "p.b", "p.c")
        answers = bucketed(_exchange(pieces, _restaurant(sweep, g or {})), f"words_{sweep}", move=True)
        return answers, _state(_sums(answers), d2, theta, g)

    def sweep_of(sweep: int, g: dict, last: bool):
        def run(row: dict) -> Iterator[tuple]:
            known, u, w, n, t = unpack_keys(row["words"]), unpack(row["u"]), unpack(row["w"]), unpack(row["n"]), unpack(row["t"])
            tables, customers, parent_t = (_answers(row["found"], c) for c in "abd")
            p = base_probability(customers, parent_t, g)[w]
            rng = np.random.default_rng([sweep, row["chunk"]])
            t = reseat(n, (g["theta"] + d2 * (tables[u] - t)) * p, d2 * p, d2, rng)
            kept = row["kept"] + [pack(t)] if last else []
            yield _seated(row, known, u, w, n, t, [unpack(row["one_u"]), unpack(row["one_w"])], unpack(row["count"]), bits, kept)

        return run

    state = bucketed(_each(chunks.join(_by_chunk(counted, "pairs"), "chunk"), seat, STATE), "state_0")
    answers, g = totals(state, 0, None)
    samples = []
    for k in range(1, sweeps + 1):
        moved = _each(state.join(_by_chunk(answers, "found"), "chunk").drop("pieces"), sweep_of(k, g, k > sweeps - keep), STATE)
        state = bucketed(moved, f"state_{k}")
        spark.sql(f"DROP TABLE {base}.state_{k - 1}")
        if k <= sweeps - keep + 1:
            spark.sql(f"DROP TABLE {base}.words_{k - 1}")
        answers, g = totals(state, k, g)
        if k > sweeps - keep:
            samples.append((answers, g))

    def tell(row: dict) -> Iterator[tuple]:
        # owners tell their pairs' tables, all others ask for them
        keys, got, own = _pair_keys(row), _answers(row.pop("pairs"), "a"), row.pop("own")
        some = np.flatnonzero(got > 3)
        seated, values = np.flatnonzero(got[some] & 1), []
        for t in own["kept"]:
            values.append(np.zeros(len(some), np.int64))
            values[-1][seated] = unpack(t)
        return ((p[0], row["chunk"], *p[1:]) for p in _pieces(keys[some], bits, values))

    seatings = state.select("chunk", F.struct("kept").alias("own"))
    known_pairs = chunks.join(_by_chunk(counted, "pairs"), "chunk")
    told = _exchange(_each(known_pairs.join(seatings, "chunk"), tell, PIECE), lambda shard, at, chunk, keys, columns, sums: ([s[at] for s in sums], []))
    told = bucketed(told, "tables", move=True)
    models = [m for _, m in samples]

    def score(row: dict) -> Iterator[tuple]:
        x, n = _pairs(row), _answers(row.pop("pairs"), "a") // 2
        told = row.pop("tables")
        count = _answers(row["words_0"], "c")
        p = np.zeros(len(n))
        for i, g in enumerate(models):
            t = (n > 0).astype(np.int64)
            t[n > 1] = _answers(told, "abc"[i])
            found = row.pop(f"words_{i}")
            tables, customers, parent_t = (_answers(found, c) for c in "abd")
            del found
            parent = base_probability(customers, parent_t, g)
            p += predictive(n, t, count[x["u"]], tables[x["u"]], parent[x["w"]], g)
        n_docs, g = len(x["sizes"]), models[-1]
        doc = np.repeat(np.arange(n_docs), x["sizes"] + 1)
        add = lambda v: np.bincount(doc, weights=v, minlength=n_docs)
        value = add(np.log10(p / len(models))[x["at"]])
        # logarithms of the different words, which are far fewer
        plain = add(np.log10((count + 0.5) / (g["tokens"] + 0.5 * (g["words"] + 1)))[x["tokens"]])
        return zip(row["ids"], row["held"], (x["sizes"] + 1).tolist(), add((count > 0)[x["tokens"]]).astype(int).tolist(), [g["tokens"]] * n_docs, plain.tolist(), value.tolist(), strict=True)

    rows = known_pairs.join(_by_chunk(told, "tables"), "chunk", "left")
    for i, (found, _) in enumerate(samples):
        rows = rows.join(_by_chunk(found, f"words_{i}"), "chunk")
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    out = _each(rows, score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    # what was gathered goes, the scores stay
    out = saved(out, "lm-scores")
    spark.sql(f"DROP DATABASE {base} CASCADE")
    return out


def op11_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return fit_and_score(docs, fold == 1)

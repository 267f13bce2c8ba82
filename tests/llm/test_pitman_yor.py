"""The Pitman-Yor model against a customer-by-customer sampler, seatings against enumeration, plain columns against brute force."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import TESTDATA
from pyspark.sql import functions as F

from quantloom.llm import pitman_yor, seating

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = "\n"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def plain_columns(rows):
    held = {i: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    c = Counter(t for i, (_, text) in enumerate(rows) if not held[i] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for i, (d, text) in enumerate(rows):
        ts = tokens(text)
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        out.append((d, held[i], len(ts), sum(c[t] > 0 for t in ts), n, round(base, 6)))
    return sorted(out, key=str)


def fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


def columns(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=str)


def gibbs(train, texts, theta, d, sweeps, seed=0):
    """log10 probabilities of texts under seatings in which every customer sits at a table of its own restaurant."""
    rng = random.Random(seed)
    low, top = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    words = {w for t in train for w in t}
    c_u, t_u = Counter(), Counter()
    n = [0, 0]  # customers and tables of the parent

    def p1(w):
        own = sum(top[w]) - d[0] * len(top[w]) if w in top else 0
        return own / (theta + n[0]) + (theta + d[0] * n[1]) / (theta + n[0]) / (len(words) + 1)

    def sit(tables, opens, discount):
        x = rng.random() * (opens + sum(tables) - discount * len(tables))
        for i, size in enumerate(tables):
            x -= size - discount
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        x = rng.randrange(sum(tables))
        for i, size in enumerate(tables):
            x -= size
            if x < 0:
                tables[i] -= 1
                if not tables[i]:
                    tables.pop(i)
                    return True
                return False

    def add(u, w):
        new = sit(low[u][w], (theta + d[1] * t_u[u]) * p1(w), d[1])
        c_u[u] += 1
        if new:
            t_u[u] += 1
            n[1] += sit(top[w], (theta + d[0] * n[1]) / (len(words) + 1), d[0])
            n[0] += 1

    def take(u, w):
        c_u[u] -= 1
        if leave(low[u][w]):
            t_u[u] -= 1
            n[0] -= 1
            n[1] -= leave(top[w])

    def p(u, w):
        if not c_u[u]:
            return p1(w)
        tables = low[u][w] if w in low[u] else []
        return (sum(tables) - d[1] * len(tables)) / (theta + c_u[u]) + (theta + d[1] * t_u[u]) / (theta + c_u[u]) * p1(w)

    pairs = [(u, w) for t in train for u, w in zip([END, *t], t, strict=False)]
    asked = [[(u, w) for u, w in zip([END, *t], t, strict=False)] for t in texts]
    for x in pairs:
        add(*x)
    total, kept = defaultdict(float), 0
    for sweep in range(sweeps):
        for x in pairs:
            take(*x)
            add(*x)
        if sweep >= sweeps // 4:
            kept += 1
            for x in {x for t in asked for x in t}:
                total[x] += p(*x)
    return [sum(math.log10(total[x] / kept) for x in t) for t in asked]


def test_plain_columns(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["A", "b", "É", "x,y", "the", "\x0b", f"r{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 50)))) for i in range(80)]
    rows += [(None, "the end"), (3, None), (4, ""), (5, "w" * 70_000), (6, "the " * 30_000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, words string").repartition(3)
    for sizes in ({}, {"chunk_bytes": 300, "shard_tokens": 40}):
        got = pitman_yor.fit_and_score(docs, fold(), **sizes)
        assert columns(got) == plain_columns(rows)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got.collect())


def test_scores_equal_a_sampler_of_single_customers(spark):
    rng = random.Random(7)
    stems = [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(4000)]
    rows = [(i, " ".join(stems[i * 16 : i * 16 + 8 + i % 9])) for i in range(150)] + [(200 + i, "w1 w2 w3 new " + stems[i]) for i in range(10)]
    held = {i: zlib.crc32(str(d).encode()) % 5 == 1 for i, (d, _) in enumerate(rows)}
    train = [tokens(t) for i, (_, t) in enumerate(rows) if not held[i]]
    pairs = Counter((u, w) for t in train for u, w in zip([END, *t], t, strict=False))
    contexts = Counter(w for _, w in pairs)
    share = lambda c: min(0.95, max(0.05, (a := sum(x == 1 for x in c.values())) / (a + 2 * sum(x == 2 for x in c.values()))))
    want = gibbs(train, [tokens(t) for _, t in rows], 1.0, (share(contexts), share(pairs)), 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in pitman_yor.fit_and_score(df, fold(), sweeps=5, keep=3, chunk_bytes=800, shard_tokens=100).collect()}
    n = sum(len(tokens(t)) for _, t in rows)
    assert abs(sum(got.values()) - sum(want)) / n < 0.01
    assert max(abs(got[d] - w) / len(tokens(t)) for (d, t), w in zip(rows, want, strict=True)) < 0.06


def test_all_words_of_a_restaurant_and_the_unknown_one_share_its_mass():
    g = {"theta": 1.0, "d1": 0.6, "d2": 0.7, "customers": 9, "tables": 5, "words": 4}
    parent = seating.base_probability(np.array([4, 3, 2, 0, 0]), np.array([2, 2, 1, 0, 0]), g)
    assert abs(parent.sum() - 1) < 1e-12
    c, t = np.array([7, 0, 2, 0, 0]), np.array([3, 0, 1, 0, 0])
    assert abs(seating.predictive(c, t, np.array([9]), np.array([4]), parent, g).sum() - 1) < 1e-12


@pytest.mark.parametrize("c", [2, 3, 5, 8])
def test_seatings_are_drawn_as_enumerated(c):
    a, b, d = 0.35, 0.06, 0.75
    # weights of t tables after i customers, all arrivals added up
    weight = {1: 1.0}
    for i in range(1, c):
        step = defaultdict(float)
        for t, x in weight.items():
            step[t] += x * (i - d * t)
            step[t + 1] += x * (a + b * t)
        weight = step
    drawn = seating.reseat(np.full(20_000, c), np.full(20_000, a), np.full(20_000, b), d, np.random.default_rng(3), draws=120)
    for t, x in weight.items():
        assert abs((drawn == t).mean() - x / sum(weight.values())) < 0.015


def test_two_customers_take_one_draw():
    rng, plain = np.random.default_rng(7), np.random.default_rng(7)
    seating.reseat(np.full(1000, 2), np.full(1000, 0.3), np.full(1000, 0.1), 0.7, rng)
    plain.random(1000)
    assert rng.bit_generator.state == plain.bit_generator.state


def test_keys_alone_are_those_of_the_pairs():
    texts = [(1, False, b"a b a b c"), (2, True, b"b c d"), (3, False, None)]
    row = dict(zip(("ids", "held", "sizes", "words", "tokens"), pitman_yor._chunk(texts), strict=True))
    known = seating.unpack_keys(row["words"])
    assert (np.diff(known.astype(object)) > 0).all() and np.frombuffer(row["tokens"], np.int32).max() == len(known) - 1
    assert (pitman_yor._pair_keys(dict(row)) == pitman_yor._pairs(dict(row))["keys"]).all()


def test_a_chunk_is_encoded_in_little_memory():
    rng = random.Random(4)
    texts = [(i, False, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)).encode()) for i in range(1600)]
    pitman_yor._chunk(texts[:1])
    tracemalloc.start()
    _, _, sizes, _, tokens = pitman_yor._chunk(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(np.frombuffer(sizes, np.int32)) == {400} and len(tokens) == 4 * 401 * 1600 and peak < 40e6


def test_training_counts_are_found_by_sorting():
    texts = [(1, False, b"a b a b c"), (2, True, b"b c d a b"), (3, False, None), (4, True, b"a b"), (5, False, b"c a b")]
    row = dict(zip(("ids", "held", "sizes", "words", "tokens"), pitman_yor._chunk(texts), strict=True))
    x = pitman_yor._pairs(dict(row))
    keys, own = pitman_yor._trained(dict(row))
    assert (keys == x["keys"]).all() and own.tolist() == np.bincount(x["at"][x["train"]], minlength=len(keys)).tolist()
    for held in (True, False):
        keys, own = pitman_yor._trained(dict(row) | {"held": [held] * len(texts)})
        assert (keys == x["keys"]).all() and own.sum() == (0 if held else len(x["tokens"]))


def test_keys_that_differ_in_low_bits_only_are_told_apart():
    rng = np.random.default_rng(11)
    near = (np.uint64(7) << np.uint64(40)) + rng.integers(0, 50, 3000).astype(np.uint64)
    for keys in (near, mixed := pitman_yor.mix64(near), np.concatenate([near, mixed]), near[:1], near[:0]):
        different, at, first = pitman_yor._different(keys)
        want, inverse = np.unique(keys, return_inverse=True)
        assert (different == want).all() and (at == inverse).all() and (keys[first] == want).all()


def test_seating_many_dishes_takes_little_memory():
    c = np.full(200_000, 3)
    c[:5] = 400
    a, b, rng = np.full(len(c), 0.3), np.full(len(c), 0.1), np.random.default_rng(2)
    tracemalloc.start()
    t = seating.reseat(c, a, b, 0.7, rng)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((t >= 1) & (t <= c)).all() and peak < 20e6


@pytest.mark.parametrize(("c", "a", "d"), [(40, 0.35, 0.75), (60, 1e-9, 0.95), (60, 1e6, 0.95)])
def test_mean_tables_of_many_customers(c, a, d):
    # of t tables after i customers: all arrivals added up, scaled so as to stay within a double
    b, weight = a / 10 if a < 1 else d, np.zeros(c + 2)
    weight[1], tables = 1.0, np.arange(c + 2)
    for i in range(1, c):
        step = weight * np.maximum(i - d * tables, 0)
        step[1:] += (weight * (a + b * tables))[:-1]
        weight = step / step.max()
    drawn = seating.reseat(np.full(9000, c), np.full(9000, a), np.full(9000, b), d, np.random.default_rng(3), draws=120)
    want = (weight * tables).sum() / weight.sum()
    assert abs(drawn.mean() - want) < 0.02 * want


def test_a_state_keeps_places_in_the_bytes_they_need():
    known, n = np.arange(1, 200, dtype=np.uint64), np.full(100, 2)
    u = w = np.arange(100, dtype=np.int32)
    zero = np.zeros(len(known), np.int64)
    row = pitman_yor._seated({"chunk": 1, "words": b""}, known, u, w, n, n, [zero, zero], zero, 0, [])
    assert len(row[2]) == len(row[3]) == 1 + len(u) and (seating.unpack(row[2]) == u).all()


def test_a_chunk_with_the_least_lot_owns_a_pair():
    at, chunk = np.array([0, 1, 0, 2, 1, 0], np.int32), np.array([5, 5, 6, 6, 7, 7])
    keys, trained = np.array([11, 12, 11, 13, 12, 11], np.uint64), np.array([1, 0, 2, 0, 3, 1])
    (got,), _ = pitman_yor._owned(0, at, chunk, keys, [trained], [np.array([4, 3, 0])])
    assert (got // 2).tolist() == [4, 3, 4, 0, 3, 4] and [int(sum(got[at == k] % 2)) for k in range(3)] == [1, 1, 0] and got[4] % 2 == 1


def test_many_customers_take_few_steps():
    t = seating.reseat(np.array([10**9, 1]), np.array([3.0, 3.0]), np.array([0.0, 0.0]), 0.0001, np.random.default_rng(5))
    assert 20 < t[0] < 120 and t[1] == 1


def test_arrays_come_back():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (seating.unpack_keys(seating.pack_keys(keys)) == keys).all()
    for x in ([], [0], [0, 255, 256], [1 << 40, 3]):
        assert seating.unpack(seating.pack(np.array(x, np.int64))).tolist() == x


def test_all_documents_of_a_table(spark):
    got = pitman_yor.op11_pitman_yor(spark, TESTDATA)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()]
    assert columns(got) == plain_columns(rows)
    held = [r for r in got.collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_no_documents_and_none_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.fit_and_score(docs, fold()).count() == 0
    alone = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = pitman_yor.fit_and_score(alone, F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 2

"""Exact deduplication, mixing, personal data and line templates."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from helpers import cells, oracle
from pyspark.sql import functions as F

from quantloom.llm import exact_dedup, line_templates, mixing, pii

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_equals_its_oracle(docs):
    got = exact_dedup.resolve(docs)
    assert no_python(got)
    assert cells(got.toPandas()) == cells(oracle(exact_dedup.OP4_SQL, documents=docs.toPandas()))


def test_the_directory_splits_overfull_buckets_only(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    keys = [r[0] & (1 << 64) - 1 for r in rows.select(F.xxhash64("text")).collect()]
    # the second table is crowded at one end, so that one bucket is split far beyond the first step
    crowded = keys[:2000] + [k >> 20 for k in keys[2000:]]
    for ks, deepest in ((keys, 8), (crowded, 31)):
        signed = [(k - (1 << 64) if k >> 63 else k,) for k in ks]
        found = exact_dedup.directory(spark.createDataFrame(signed, f"{exact_dedup.HASH} long"), capacity=100)
        buckets = sorted((r["first"] & (1 << 64) - 1, r["depth"]) for r in found.collect())
        held = lambda first, depth: sum(first <= k < first + (1 << 64 - depth) for k in ks)
        assert sum(held(*x) for x in buckets) == len(ks) and all(held(*x) <= 100 for x in buckets)
        for first, depth in buckets:
            assert not depth or held(first >> (65 - depth) << (65 - depth), depth - 1) > 100
        assert max(d for _, d in buckets) <= deepest
        owned = exact_dedup.owned(spark.createDataFrame(signed, f"{exact_dedup.HASH} long"), found).collect()
        assert all(r[1] is not None and (r[1] & (1 << 64) - 1, dict(buckets)[r[1] & (1 << 64) - 1]) in buckets for r in owned)
    small = exact_dedup.resolve(rows, capacity=50)
    assert small.count() == 4000 and small.where("kept").count() == 4000


def test_texts_whose_keys_collide_stay_apart(spark, docs):
    more = docs.unionByName(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("T"), F.col("id") % 90).alias("text"), F.lit("s").alias("source")))
    want = cells(oracle(exact_dedup.OP4_SQL, documents=more.toPandas()))
    # keys of three bits: chains of many texts
    assert cells(exact_dedup.resolve(more, capacity=2, bits=3).toPandas()) == want
    kept = [r["doc_id"] for r in exact_dedup.resolve(more).where("kept").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in exact_dedup.keep_one(more, capacity=2, bits=3).collect())


def test_one_of_repeated_rows_stays(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")], "doc_id long, text string")
    got = exact_dedup.resolve(rows)
    assert got.count() == 7 and got.where("kept").count() == 3
    kept = exact_dedup.keep_one(rows).collect()
    assert sorted((r["doc_id"] or -1, r["text"].lower()) for r in kept) == [(-1, "b"), (1, "a"), (2, "c")]


def test_stages_keep_the_columns(docs, empty):
    odd = docs.withColumns({"hash": F.lit(1), "size": F.lit("s"), "target": F.lit(2), "n_words": F.lit(3), "bucket": F.lit(None).cast("string")})
    assert exact_dedup.keep_one(odd).columns == odd.columns
    mixed = mixing.mix(odd, mixing.token_count(F.col("text")))
    assert mixed.columns == [c for c in odd.columns if c not in ("size", "target")] + ["size", "source_size", "target", "taken"] and mixed.count() == 16
    for f in (exact_dedup.resolve, exact_dedup.keep_one, pii.find_pii, line_templates.drop_recurring, lambda d: mixing.mix(d, mixing.token_count(F.col("text")))):
        assert f(empty).count() == 0


def test_mixing_equals_its_oracle(spark, docs):
    more = docs.unionByName(spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.repeat(F.lit("a b "), (F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 9).alias("source")))
    got = mixing.mix(more.select("doc_id", "source", "text"), mixing.token_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")
    assert no_python(got)
    want = oracle(mixing.OP3_SQL, documents=more.toPandas())
    assert cells(got.toPandas()) == cells(want)
    by = got.toPandas()
    assert (by.taken <= 2 * by["size"]).all()
    named = by.merge(more.select("doc_id", "source").toPandas(), on="doc_id")
    for _, s in named.groupby("source", dropna=False):
        assert s.target.iloc[0] - 1 < s.taken.sum() <= s.target.iloc[0]
    unnamed = mixing.mix(spark.createDataFrame([(None, "s", "a b c")] * 5 + [(None, "s", f"x{i} y") for i in range(5)], "doc_id long, source string, text string"), mixing.token_count(F.col("text")))
    assert unnamed.agg(F.sum("taken")).first()[0] == 37 and unnamed.count() == 10


@pytest.mark.parametrize(("digits", "sorted_rows"), [(1, 1), (3, 40), (4, 1 << 16)])
def test_mixing_finds_the_same_cut_however_ranges_are_cut(spark, docs, digits, sorted_rows):
    one_id = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("a b "), (F.col("id") % 5).cast("int")).alias("text"), F.lit("hot").alias("source"))
    more = docs.select("doc_id", "text", "source").unionByName(one_id).unionByName(spark.range(200).select((F.col("id") + 100).alias("doc_id"), F.lit("x y z").alias("text"), F.lit("s").alias("source")))
    narrow = more.select("doc_id", "source", mixing.token_count(F.col("text")).alias("words"))
    got = mixing.mix(narrow, F.col("words"), digits=digits, sorted_rows=sorted_rows).select("doc_id", "size", "source_size", "target", "taken")
    assert cells(got.toPandas()) == cells(oracle(mixing.OP3_SQL, documents=more.toPandas()))


def test_mixing_moves_no_text(spark):
    # own columns of the names that the mix uses inside
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.lit("a b c").alias("text"), F.lit(1).alias("lo"), F.lit(2).alias("before"), F.lit(3).alias("open"))
    mixed = mixing.mix(docs, mixing.token_count(F.col("text")), weights=(1,), share=0.5)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan
    assert mixed.agg(F.sum("taken")).first()[0] == 450 and mixed.columns[:6] == docs.columns


def test_targets_fill_to_the_budget_and_stop_at_two_epochs(spark):
    sizes = spark.createDataFrame([("0a", 1000), ("0b", 10), ("0c", 0), ("0d", 500), ("1", 3)], f"{mixing.SOURCE} string, source_size long")
    t = {r[mixing.SOURCE]: r["target"] for r in mixing.targets(sizes).collect()}
    assert sum(t.values()) == pytest.approx(1.5 * 1513) and t["0b"] == 20 and t["0c"] == 0 and t["1"] == 6
    free = {k: t[k] / w for k, w in (("0a", 5), ("0d", 5)) if t[k] < 2 * {"0a": 1000, "0d": 500}[k]}
    assert len(free) == 1 and max(t["0a"], t["0d"]) <= 2000
    alone = spark.createDataFrame([("0a", 10)], f"{mixing.SOURCE} string, source_size long")
    assert mixing.targets(alone).first()["target"] == 15.0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text) if fits(k, m.group())]


ODD = [
    "a@b.c@d.e x_y@z.co.uk a@b.c_x@y.z é😀 é@x.com +1 (555) 555-1234 99",
    "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3 99999999999999999999.1.1.1",
    "4111 1111-1111 1111 4111111111111112 4111111111111111 4111  1111 1111 1111",
    "+1234567 +123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 ++49 30 1234567",
    "1" * 3000, "a" * 20000 + "@", "1.2.3.4 " * 500, "a@b.co," * 300, "+" * 100, "@@@ . @a.b",
]


def test_rows_of_one_id_and_size_are_cut_alike_in_reruns(spark):
    rows = [(7, f"{w} two three", "a") for w in ("x", "y", "z", "u", "v")] * 3
    taken = []
    for parts in (1, 3, 5):
        df = spark.createDataFrame(rows[parts:] + rows[:parts], "doc_id long, text string, source string").repartition(parts)
        mixed = mixing.mix(df, mixing.token_count(F.col("text")), weights=(1,), share=0.7)
        taken.append(sorted((r["text"], r["taken"]) for r in mixed.collect()))
    assert taken[0] == taken[1] == taken[2] and {0, 3} <= {t for _, t in taken[0]}


def test_base_spans_equal_plain_regular_expressions(spark, texts):
    rows = [(i, t) for i, t in enumerate([t for _, t, _ in texts] + ODD)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert no_python(got)
    for r in got.collect():
        text = rows[r["doc_id"]][1] or ""
        assert [(x["kind"], x["start"], x["end"]) for x in r["found"] if x["base"]] == plain_spans(text), r["doc_id"]
        assert all(0 <= x["start"] < x["end"] <= len(text) for x in r["found"])


def test_the_classifier_adds_announced_forms_and_leaves_numbers(spark):
    good = [(i, f"please mail joe{i}@mail.com or call +1 (555) 555-{1000 + i} today") for i in range(200)]
    new = [(1000, "my email: joe [at] mail [dot] com"), (1001, "please call (555) 555-1234"), (1002, "her ssn 123-45-6789"), (1003, "version 1234567890123 of 300.1.1.1")]
    got = {r["doc_id"]: [x["kind"] for x in r["found"]] for r in pii.find_pii(spark.createDataFrame(good + new, "doc_id long, text string")).collect()}
    assert got[1000] == ["email"] and got[1001] == ["phone"] and got[1002] == ["id"] and got[1003] == []
    assert all(got[i] == ["email", "phone"] for i in range(200))


def test_reliabilities_find_the_noisy_voter():
    patterns = [(0, (1, 1, 1, 1), 90), (0, (-1, -1, 0, 1), 100), (0, (1, -1, 1, -1), 10), (0, (-1, 1, 0, -1), 12)]
    p, w = pii.reliabilities(patterns)
    assert p[0] > 0.9 and p[1] < 0.1 and p[2] > 0.5 > p[3]
    assert pii.fit_classifier([(k, v, 3, c) for k, v, c in patterns], p, w)[2] > 0
    # of spans with the same votes, the shape that goes with better votes scores higher
    shaped = [(0, (1, 1, 1, 1), 3, 900), (0, (-1, -1, 0, 1), 0, 900), (0, (0, 0, 0, 1), 3, 50), (0, (0, 0, 0, 1), 0, 50)]
    at = len(pii.VOTERS) * len(pii.VOTES) + len(pii.KINDS)
    assert pii.learn(shaped)[at + 3] > pii.learn(shaped)[at]


def test_the_query_gives_the_base_digest(spark, texts, tmp_path):

    rows = [(i, t) for i, t in enumerate([t for _, t, _ in texts] + ODD)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = {k: i for i, (k, _) in enumerate(BASE)}
    for r in pii.op1_weak_pii(spark, str(tmp_path)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        base = sorted(plain_spans(text), key=lambda x: (order[x[0]], x[1]))
        assert [r[f"n_{k}"] for k in order] == [sum(x[0] == k for x in base) for k in order]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_spans"] and {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)


def test_announced_keys_are_secrets(spark):
    token = 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here, mail joe@mail.com'
    rows = [(i, token.replace("04db", f"{i:04x}")) for i in range(30)] + [(99, "averyveryverylongwordwithoutdigits" * 3 + " a-hyphenated-name-of-2-words-and-more")]
    got = {r["doc_id"]: r["found"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == [] and all([rows[i][1][x["start"] : x["end"]] for x in got[i] if x["kind"] == "secret"] == [rows[i][1].split('"')[1]] for i in range(30))


def test_a_long_text_full_of_addresses_is_quick(spark):
    began = time.time()
    got = pii.find_pii(spark.createDataFrame([(1, "mail joe@mail.com or call 10.0.0.1, " * 40_000)], "doc_id long, text string")).select(F.size("found").alias("n")).first()["n"]
    assert got == 80_000 and time.time() - began < 60


def recurring_by_hand(rows, min_docs=4):
    """doc_id's text and number of dropped lines for rows (doc_id, text) of different doc_ids: the tree, one line after the other."""
    var, lead = "<*>", 4
    mask = lambda line: re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", var, line, flags=re.ASCII)
    docs, leaves = Counter(), defaultdict(set)
    for _, text in rows:
        for line in {mask(x) for x in (text or "").split("\n")} - {""}:
            docs[line] += 1
            leaves[len(line.split(" ")), tuple(line.split(" ")[:lead])].add(line)
    gone = set()
    for (n, _), lines in leaves.items():
        words = {x: x.split(" ") for x in lines}
        groups = defaultdict(list)
        if n > lead and len(lines) > 1:
            often, different = Counter(), Counter()
            for x, ws in words.items():
                for spot in enumerate(ws):
                    often[spot] += docs[x]
                    different[spot] += 1
            for x, ws in words.items():
                groups[None].append(x)
                sets = defaultdict(set)
                for at, w in enumerate(ws):
                    if at >= lead and w != var and different[at, w] > 1:
                        sets[often[at, w]].add((at, w))
                if sets:
                    groups[frozenset(max(sets.items(), key=lambda s: (len(s[1]), s[0]))[1])].append(x)
        for members in groups.values():
            fixed = []
            for at in range(n):
                votes = Counter()
                for x in members:
                    votes[words[x][at]] += docs[x]
                count, token = max((c, t) for t, c in votes.items())
                fixed.append(token if count >= 0.6 * sum(votes.values()) else var)
            follow = []
            for x in members:
                same = [w for w, f in zip(words[x][lead:], fixed[lead:]) if w == f]
                if len(same) >= 0.6 * (n - lead) and any(w != var for w in same):
                    follow.append(x)
            if sum(docs[x] for x in follow) >= min_docs:
                gone |= set(follow)
    for line, count in docs.items():
        chars = len(line.replace(var, "").replace(" ", ""))
        if line.count(" ") + 1 >= 5:
            need = min_docs
        else:
            need = max(min_docs, math.ceil(80 / chars)) if chars else math.inf
        if count >= need:
            gone.add(line)
    first, out = {}, {}
    for i, text in sorted(rows):
        for x in (text or "").split("\n"):
            first.setdefault(x, i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if mask(x) not in gone and (len(x) < 80 or first[x] == i)]
        out[i] = ("\n".join(kept) if len(kept) < len(lines) else text, len(lines) - len(kept))
    return out


def test_templates_equal_the_tree_by_hand(spark):
    rng = random.Random(9)
    words = ["the", "user", "log", "in", "out", "file", "of", "job", "end", "on", "a", "7", "x9", "<*>", "", "all", "été", "now"]
    heads = ["the user log in", "a file of job", "end on the user"]
    rows = []
    for i in range(300):
        lines = [f"{rng.choice(heads)} {' '.join(rng.choice(words[: rng.choice([2, 6, 18])]) for _ in range(rng.randrange(1, 7)))}" for _ in range(rng.randrange(6))]
        lines += [rng.choice(["all rights reserved", "été", "", "12 7", " ".join(rng.choices(words, k=3)), f"line {rng.randrange(40)} " + "that is long enough to be kept once only " * 2])]
        rows.append((i, "\n".join(lines) if i % 29 else None))
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == recurring_by_hand(rows) and sum(n for _, n in got.values()) > 200


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
def test_op9_equals_the_tree_by_hand(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, hashlib.sha256((t or "").encode()).hexdigest()) for i, (t, n) in recurring_by_hand(rows).items()}
    got = {r["doc_id"]: (r["n_dropped"], r["kept_sha256"]) for r in line_templates.op9_log_templates(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(n for n, _ in got.values())


def test_a_text_of_many_recurring_lines_is_quick(spark):
    text = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} stands in every text" for i in range(17_000))
    began = time.time()
    got = line_templates.drop_recurring(spark.createDataFrame([(i, text + f"\nown{'x' * i}") for i in range(4)], "doc_id long, text string")).collect()
    assert [r["n_dropped"] for r in got] == [17_000] * 4 and time.time() - began < 60


def test_a_long_text_is_digested_once_and_not_for_each_line(spark):
    text = "\n".join(f"{'abcdefghij'[i % 10]} own words of line {i} of one text" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    line_templates.keyed_lines(docs.limit(0), "doc_id", "text").count()
    began = time.time()
    assert line_templates.keyed_lines(docs, "doc_id", "text").count() == 40_001 and time.time() - began < 30


def test_long_lines_are_told_apart_by_their_digits(spark):
    tail = " " + " ".join(f"{c * 3}on" for c in "abcdefghijklmnopqrst")
    rows = [(1, "job 1" + tail + "\nuno"), (2, "job 2" + tail), (3, "job 1" + tail), (4, "a 7\n" + tail), (5, tail + "\nb")]
    got = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: rows[1][1], 3: "", 4: rows[3][1], 5: "b"}


def test_line_templates_keep_columns_of_clashing_names(spark):
    rows = [(i, f"worker {i} finished job {i * 7} in {i} seconds flat\nown {'x' * i}", i, "k", "l", 0, "raw") for i in range(5)]
    got = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string, at long, key string, leaf string, n_lines int, raw string"))
    assert got.columns == ["doc_id", "text", "at", "key", "leaf", "raw", "n_lines", "n_dropped"]
    assert sorted((r["at"], r["key"], r["raw"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == [(i, "k", "raw", 2, 1) for i in range(5)]


def test_rows_without_ids_or_with_one_id_are_rows_of_their_own(spark):
    said = [f"worker {i} finished job {i * 7} in {i} seconds flat" for i in range(6)]
    long = " ".join(f"{c * 3}on" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(None, said[0] + "\nuno"), (None, "dos\n" + said[1]), (7, said[2] + "\ntres"), (7, "cuatro\nx\n" + said[3]), (7, said[2] + "\ntres"), (None, long), (8, long), (9, long)]
    got = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted([(0, "uno", 2, 1), (0, "dos", 2, 1), (7, "tres", 2, 1), (7, "cuatro\nx", 3, 1), (7, "tres", 2, 1), (0, "", 1, 1), (8, long, 1, 0), (9, "", 1, 1)])


def test_lines_of_recurring_templates_go(spark):
    log = [(i, f"worker {i} finished job {i * 7} in {i} seconds flat\nthis line of document number {'abcdefghij'[i]} stays as it is {'abcdefghij'[i]}{'abcdefghij'[i]}\nshort") for i in range(8)]
    ads = [(20 + i, f"please read our new terms today {'amber blue coral dark'.split()[i]} edition or leave\nunique words come here number {'one two six ten'.split()[i]} only") for i in range(4)]
    rest = [(30, None), (31, ""), (None, "worker 9 finished job 9 in 9 seconds flat"), (32, "worker 1 finished job 2 in 3 seconds flat")]
    got = line_templates.drop_recurring(spark.createDataFrame(log + ads + rest, "doc_id long, text string"))
    assert no_python(got)
    by = {r["doc_id"]: r for r in got.collect()}
    for i in range(8):
        assert by[i]["n_dropped"] >= 1 and "worker" not in by[i]["text"] and by[i]["text"].endswith("short")
    for i in range(4):
        assert "please read our" not in by[20 + i]["text"] and by[20 + i]["n_lines"] == 2
    assert by[30]["text"] is None and by[31]["text"] == "" and by[None]["n_dropped"] == 1 and by[32]["text"] == ""


def test_unrelated_lines_stay_even_in_one_leaf(spark):
    rows = [(i, f"the same four words {chr(97 + i) * 3} {chr(98 + i) * 2} {chr(99 + i) * 4} {chr(100 + i)} {chr(101 + i) * 5} {chr(102 + i) * 6} {chr(103 + i) * 7}") for i in range(8)]
    assert line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 0


def test_short_and_long_lines_that_recur_go(spark):
    own = "abcdefghijklmnopqrstuvwxyz"
    seal, script = "All rights reserved.", "这是一行没有空格的文字请勿转载本站内容谢谢"
    few = [(i, f"{seal}\n{script}\nshort\nLes.\n\n7\n{own[i] * 9}") for i in range(5)]
    many = [(100 + i, f"Les.\n\n7\n{own[i] * 7}") for i in range(20)]
    long = " ".join(f"{c * 3}on" for c in own)
    pair = [(200, long + "\nx"), (201, long + "\ny"), (None, long), (202, long + " 1"), (203, long + " 2")]
    by = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(few + many + pair, "doc_id long, text string")).collect()}
    for i in range(5):
        assert by[i]["text"] == f"short\n\n7\n{own[i] * 9}" and by[i]["n_dropped"] == 3
    assert all(by[100 + i]["text"] == f"\n7\n{own[i] * 7}" for i in range(20))
    # long lines stay once, and lines that differ in their numbers are no repeats
    assert [by[i]["text"] for i in (200, 201, None, 202, 203)] == [long + "\nx", "y", "", long + " 1", long + " 2"]


def test_a_leaf_holds_several_templates(spark):
    names = [f"{a}{b}x" for a in "abcdefgh" for b in "klmnop"]
    first = [f"the user has now logged in from {n} over the web" for n in names[:9]]
    second = [f"the user has now moved its files {n} away by mail" for n in names[9:16]]
    # prose of the same length and opening, far more than either template
    prose = ["the user has now " + " ".join(f"{n}{k}".translate(str.maketrans("0123456", "qrstuvw")) for k in range(7)) for n in names]
    assert len({len(x.split()) for x in first + second + prose}) == 1
    # five tokens of which the leading four agree are no template
    short = [f"what we saw was {n}" for n in names[:6]]
    rows = list(enumerate(first + second + prose + short))
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = len(first + second)
    assert [got[i] for i in range(n)] == [1] * n and [got[i] for i in range(n, len(rows))] == [0] * (len(rows) - n)

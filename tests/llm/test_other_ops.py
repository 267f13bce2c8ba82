"""Licenses, near-duplicates, decontamination, archives, quality and chat."""

import itertools
import random
import re

import numpy as np
import pytest
from helpers import cells, oracle
from pyspark.sql import functions as F

from quantloom.llm import chat, components, decontaminate, licenses, near_dedup, quality, warc
from quantloom.llm.arrays import counted, jaccard, shingle_set, shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_shingles(text):
    w = plain_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


# licenses


def plain_base(text):
    w, out = plain_words(text), []
    for label, p in licenses.PHRASES.items():
        p = p.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_base_phrases_equal_a_plain_search(spark, texts):
    odd = ["the mit license the MIT-License", "cc by nc by nc cc_by/nc", "apache license version 2.0 apache license version 3", "the the mit license " * 50, "mit", "under the apache license,\nversion 2"]
    rows = list(enumerate([t for _, t, _ in texts] + odd))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        n, places = plain_base(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_base_columns_are_those_of_the_contract(spark, tmp_path):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    draw, parts = random.Random(3), [*{w for p in phrases for w in p.split()}, *phrases, "the MIT License", "Under THE", "\u212a", "m\u0130t", "2.0", "x"]
    texts = ["the mit license", "See the MIT License.", "under the MIT-License", "under\x00the_mit\nlicense", "under the mit license\u00e9", "under the under the mit license", None, "", "cc by nc by nc cc_by/nc"]
    texts += ["".join(draw.choice(parts) + draw.choice([" ", "-", "\n", "\x00", ", ", "\x7f"]) for _ in range(draw.randrange(40))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op2_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = plain_words(t)
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want, repr(t)


def test_notices_are_found_by_their_rare_words(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "All rights reserved.": "reserved",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "We read a public license in general and the gnu ran away": "",
        "permission was hereby granted": "",
    }
    rows = [(i, "some words come first " * 9 + t + " and some after") for i, t in enumerate(cases)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


# near-duplicates


def test_standard_notices_have_their_label(spark):
    head = "/* This program is free software{} you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation{} {}version {} of the License"
    later = ", or\n * (at your option) any later version.\n */ int main"
    notices = {
        head.format(":", "", ",", "either ", 3) + later: "gpl-3",
        head.format(";", "", ";", "either ", 2) + later: "gpl-2",
        head.format(";", "", ";", "", 2) + ".": "gpl-2",
        head.format(":", "Lesser ", ",", "either ", 3) + later: "lgpl",
        head.format(":", "Affero ", ",", "either ", 3) + later: "agpl-3",
        "SPDX: Apache License 2.0": "apache-2",
        "either version 3 of the license, as published by the foundation": "",
    }
    rows = [(i, t) for i, t in enumerate(notices)] + [(i, f"plain text number {i}") for i in range(100, 140)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(notices))] == list(notices.values())


def labelled(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, f"plain text number {i} of no license at all") for i in range(40)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))]


def test_a_phrase_within_anothers_says_nothing(spark):
    cases = {
        "Licensed under the Creative Commons Attribution 4.0 International License.": "cc-by",
        "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
        "Licensed under the Creative Commons Attribution Non-Commercial 4.0 International License.": "cc-by-nc",
        "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
        "Licensed under the Creative Commons Attribution-NoDerivs 4.0 International License.": "cc-by-nd",
        "Text: licensed under CC BY 4.0": "cc-by",
        "Text: licensed under CC BY-SA 4.0": "cc-by-sa",
        # both, at different places
        "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. " + "pictures come otherwise " * 9 + "Licensed under the Creative Commons Attribution 4.0 International License.": "cc-by,cc-by-sa",
    }
    assert labelled(spark, cases) == list(cases.values())


def test_each_identifier_gives_its_label_alone(spark):
    texts = [f"// SPDX-License-Identifier: {i.replace(' ', '-')}\nint main() {{}}" for i in licenses.SPDX.values()]
    texts += ["# SPDX-License-Identifier: GPL-3.0-only", "# SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: BSD-3-Clause", "# SPDX-License-Identifier: CC-BY-NC-4.0", "# SPDX-License-Identifier: none"]
    assert labelled(spark, texts) == [*licenses.SPDX, "gpl-3", "apache-2", "bsd", "cc-by-nc", ""]


def test_each_wording_gives_its_label_alone(spark):
    texts = [" ".join(w.decode() for w in ws) for _, ws in licenses._WORDINGS]
    assert labelled(spark, texts) == [label for label, _ in licenses._WORDINGS]


def test_rare_words_must_stand_in_their_places(spark):
    index = licenses.Index([1.0] * len(licenses._VOCABULARY))
    scan = lambda t: licenses.scan_words(t.encode())
    labels = lambda t: set(index.labels(*scan(t)[3:]))
    assert labels("licensed under the eclipse x public license. made available under the terms of the Eclipse Public License, version 2.0") == {"epl"}
    # one rare word alone, however heavy, names no wording
    assert index.starts({licenses._VOCABULARY[b"eclipse"]: [5]}) in ({}, {t: [] for t in index.starts({licenses._VOCABULARY[b"eclipse"]: [5]})})
    many = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files " * 20_000)
    assert labels(many) == {"mit"}


def test_words_and_shingles_equal_plain_ones(texts):
    for t in [x for _, x, _ in texts]:
        b = (t or "").encode()
        doc, h, _, _ = words([b])
        assert len(h) == len(plain_words(t)) and len(set(h.tolist())) == len(set(plain_words(t)))
        assert len(shingle_set(b)) == len(plain_shingles(t))
    many = [(x or "").encode() for _, x, _ in texts]
    doc, h, _, _ = words(many)
    d, s, c = counted(*shingles(doc, h))
    for i, t in enumerate(many):
        assert sorted(s[d == i].tolist()) == shingle_set(t).tolist()


def test_sketches_estimate_the_probability_jaccard():
    rng = np.random.default_rng(0)
    items = rng.integers(1, 2**62, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    wa[:40], wb[-40:] = 0, 0
    a, b = wa > 0, wb > 0
    doc = np.r_[np.zeros(a.sum(), int), np.ones(b.sum(), int)]
    sk = near_dedup.prob_minhash(doc, np.r_[items[a], items[b]], np.r_[wa[a], wb[b]], 2, 2048)
    both = np.flatnonzero(a & b)
    exact = sum(1 / np.maximum(wa / wa[i], wb / wb[i]).sum() for i in both)
    assert (sk[0] == sk[1]).mean() == pytest.approx(exact, abs=0.05)
    one = near_dedup.prob_minhash(np.array([0, 1]), items[[0, 0]], np.array([1.0, 5.0]), 2, 64)
    assert (one == items[0]).all()
    with pytest.raises(ValueError):
        near_dedup.prob_minhash(np.array([0]), items[:1], np.ones(1), 1, 4096)


def plain_classes(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if a and b and len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in sets}


def test_classes_equal_all_pairs(spark, texts):
    rng = random.Random(4)
    rows = [(i, t) for i, t, _ in texts]
    vocabulary = [f"v{i}" for i in range(400)]
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 200]))]
        for k in range(12):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((1000 + g * 50 + k, " ".join(w)))
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = plain_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    size = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r["class_size"] == size[r["class_id"]] for r in got)


def test_pairs_with_repeated_lines_are_linked(spark):
    rng, rows = random.Random(5), []
    for k in range(24):
        said = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        footer = [f"f{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(2 * k, " ".join(said)), (2 * k + 1, " ".join(said + footer * 30))]
        a, b = plain_shingles(rows[-2][1]), plain_shingles(rows[-1][1])
        assert len(a & b) / len(a | b) >= 0.8
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_dedup_edges(spark, docs, empty):
    assert near_dedup.classes(empty).count() == 0 and near_dedup.keep_one(empty).columns == empty.columns
    odd = docs.withColumns({"node": F.lit(1), "bucket": F.lit("b"), "n": F.lit(0), "id": F.lit(None).cast("string")})
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 16 - 5  # 2, 3, 6 and 7 are like 1, and 13 is like 12
    repeated = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert near_dedup.classes(repeated).count() == 4


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


# decontamination

ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"), (2, "one two three"), (3, None), (4, ""), (5, "é one"), (6, "the quick brown fox jumps over the lazy dog and runs away into town"), (None, "no name for this one"), (None, "runs away from the big bad wolf into the deep dark forest of the north"), (7, "x")]


def test_decontamination_equals_its_oracle(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    more = docs.unionByName(spark.createDataFrame([(50, "One, TWO three one two three? " * 3 + "x " * 400, None), (51, "É one é-ONE", None)], docs.schema))
    want = cells(oracle(decontaminate.OP6_SQL, documents=more.toPandas(), benchmark=bench.toPandas().astype({"item_id": "Int64"})))
    assert cells(decontaminate.with_hits(more, bench).select(*names).toPandas()) == want
    assert cells(decontaminate.with_hits(more, bench, block_bytes=60).select(*names).toPandas()) == want
    assert decontaminate.with_hits(empty, bench).count() == 0
    assert decontaminate.with_hits(more, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_spans_lie_on_the_original(spark):
    text = "Say: ONE,\n two  THREE! and é😀ONE"
    bench = decontaminate.Benchmark([("2", b"one two three"), ("9", "é😀one".encode())])
    n, lo, hi, k, of, starts, ends = decontaminate.scan_text(text.encode(), bench)
    assert n == 6 and k == 2 and [text[a:b] for a, b in zip(starts, ends)] == ["ONE,\n two  THREE", "é😀ONE"] and sorted(of) == ["2", "9"]
    found = decontaminate.with_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, "one two three")], "item_id long, text string")).first()
    assert [text[x["start"] : x["end"]] for x in found["hit_spans"]] == ["ONE,\n two  THREE"]


@pytest.mark.parametrize("wide", [False, True])
def test_runs_equal_all_windows(monkeypatch, wide):
    if wide:
        monkeypatch.setattr(decontaminate, "ONE_CHARACTER", 2)
    rng = random.Random(2)
    for window in (1, 2, 5, 13):
        items = [(str(i), [rng.choice("abc") for _ in range(rng.randint(0, 40))]) for i in range(12)]
        bench = decontaminate.Benchmark([(i, " ".join(ws).encode()) for i, ws in items], window)
        for _ in range(30):
            ws = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5 and len(items[0][1]) > 5:
                ws[3:3] = rng.choice(items)[1]
            hit, of = set(), set()
            for i, item in items:
                size = min(window, len(item))
                parts = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if item else set()
                for k in range(len(ws) - size + 1):
                    if size and tuple(ws[k : k + size]) in parts:
                        hit |= set(range(k, k + size))
                        of.add(i)
            n, lo, hi, k, found, _, _ = decontaminate.scan_text(" ".join(ws).encode(), bench)
            assert n == len(ws) and {x for a, b in zip(lo, hi) for x in range(a, b)} == hit and found == sorted(of)


def test_a_word_in_many_items_and_a_long_text_stay_cheap():
    bench = decontaminate.Benchmark([(str(i), b"the") for i in range(50)] + [("long", b"the cat sat on the mat and then the cat ran off to the hills again")])
    n, lo, hi, k, of, _, _ = decontaminate.scan_text(b"the cat " * 300_000, bench)
    assert n == 600_000 and len(lo) == 300_000 and k == 50


# archives


def pages(spark):
    body = "<p>" + "x" * 200
    rows = [(i, f"http://e.x/{i}", body if i % 3 == 0 else f"<p>{i} é😀\r\n\r\nWARC/1.1" * 9) for i in range(40)]
    rows += [(100, None, None), (101, "http://e.x/ü\n x", ""), (102, "", "tiny"), (103, "", "tiny"), (-5, "u", body)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)


def test_round_trip_equals_its_oracle(spark, tmp_path):
    p = pages(spark)
    manifest = warc.write_warc(p, f"file://{tmp_path}/a", roll_bytes=2000)
    back = warc.read_warc(spark, f"file://{tmp_path}/a")
    got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").toPandas()
    assert cells(got.astype({"refers_to": "Int64"})) == cells(oracle(warc.OP7_SQL, pages=p.toPandas()))
    html = {r["page_id"]: r["html"] or "" for r in p.collect()}
    assert all(r["html"] == html[r["page_id"]] for r in back.where("record_type = 'response'").collect())
    assert manifest.count() > 3 and manifest.agg(F.sum("n_records")).first()[0] == 45


def test_the_same_pages_give_the_same_files(spark, tmp_path):
    a, b = (sorted((r["name"], r["sha256"], r["first_page"]) for r in warc.write_warc(p, f"file://{tmp_path}/{i}", roll_bytes=3000).collect()) for i, p in enumerate((pages(spark), pages(spark).repartition(2).orderBy("url"))))
    assert a == b
    files = sorted(x.name for x in (tmp_path / "0").iterdir() if x.suffix == ".gz")
    assert files == [x[0] for x in a]


def test_far_and_repeated_ids_leave_ranges_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 8192)
    far = [(-(2**63), "u", "first " * 40), (2**63 - 1, "u", "last " * 40), (2**40, "u", "tiny")]
    near = [(i, "u", f"<p>{i % 90} " * 50) for i in range(300)]
    same = [(77, "u", f"<b>{i % 150} " * 50) for i in range(200)]
    p = spark.createDataFrame(far + near + same, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(p, f"file://{tmp_path}/a").toPandas().sort_values("grp")
    back = warc.read_warc(spark, f"file://{tmp_path}/a")
    assert cells(back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").toPandas().astype({"refers_to": "Int64"})) == cells(oracle(warc.OP7_SQL, pages=p.toPandas()))
    assert manifest.n_records.sum() == 503 and manifest.groupby("grp").n_records.sum().max() < 40
    assert all(a <= b for a, b in zip(manifest.last_page, manifest.first_page[1:]))
    again = warc.write_warc(p.repartition(7), f"file://{tmp_path}/b").toPandas()
    assert sorted(again.sha256) == sorted(manifest.sha256)


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    warc.write_warc(pages(spark).limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    warc.write_warc(pages(spark), f"file://{tmp_path}/f")
    one = next((tmp_path / "f").glob("*.gz"))
    one.with_name("part-99999999-000000.warc.gz").write_bytes(one.read_bytes())
    assert warc.read_warc(spark, f"file://{tmp_path}/f").count() == 45
    # a whole archive with another's content
    first = sorted((tmp_path / "f").glob("part-0*.gz"))[0]
    warc.write_warc(pages(spark).where("page_id < 20"), f"file://{tmp_path}/h")
    other = sorted((tmp_path / "h").glob("part-0*.gz"))[0]
    first.write_bytes(other.read_bytes())
    (tmp_path / "f" / f".{first.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="manifest"):
        warc.read_warc(spark, f"file://{tmp_path}/f").collect()
    unnamed = spark.createDataFrame([(None, "u", f"page {i} " * 40) for i in range(60)] + [(5, "u", "page 5 " * 40)], "page_id long, url string, html string")
    warc.write_warc(unnamed, f"file://{tmp_path}/i")
    assert warc.read_warc(spark, f"file://{tmp_path}/i").where("record_type = 'response'").count() == 61
    repeated = spark.createDataFrame([(1, "u", "y" * 200)] * 3 + [(None, "u", "y" * 200), (2, "u", "y" * 200)], "page_id long, url string, html string")
    warc.write_warc(repeated, f"file://{tmp_path}/g")
    assert sorted((r["page_id"] or -1, r["record_type"]) for r in warc.read_warc(spark, f"file://{tmp_path}/g").collect()) == [(-1, "response"), (1, "response"), (1, "response"), (1, "response"), (2, "revisit")]


def test_what_the_manifest_lists_must_be_there(spark, tmp_path):
    extra = pages(spark).withColumns({"name": F.lit("x"), "grp": F.lit(1), "digest": F.lit("y")})
    warc.write_warc(extra, f"file://{tmp_path}/a", roll_bytes=2000)
    assert warc.read_warc(spark, f"file://{tmp_path}/a").count() == 45
    files = sorted((tmp_path / "a").glob("part-0*.gz"))
    kept = files[1].read_bytes()
    files[1].unlink()
    # whatever columns are asked for
    for ask in (lambda df: df.select("page_id").collect(), lambda df: df.count(), lambda df: df.where("record_type = 'revisit'").collect()):
        with pytest.raises(Exception, match=f"a file of the manifest is missing: {files[1].name}"):
            ask(warc.read_warc(spark, f"file://{tmp_path}/a"))
    files[1].write_bytes(kept)
    assert warc.read_warc(spark, f"file://{tmp_path}/a").count() == 45
    listed = spark.read.parquet(f"{tmp_path}/a/_manifest").toPandas()
    listed.loc[0, "n_records"] += 1
    spark.createDataFrame(listed, warc.MANIFEST).write.mode("overwrite").parquet(f"{tmp_path}/a/_manifest")
    with pytest.raises(Exception, match="number of records"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()


# quality


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    for i in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(3, 15))) + "." for _ in range(rng.randint(1, 8))]
        good = rng.random() < 0.7
        if not good:
            lines = [rng.choice([x.upper().replace(" ", "!! "), " ".join([x.split()[0]] * 9), x.replace(" ", "### ")]) for x in lines]
        yield i, "\n".join(lines), int(good)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(0, 1, 7), rng.normal(0, 1, (2, 2))
    at = np.array([[0, 4], [1, 5], [2, 6], [3, -1]])
    p, pairs = quality.marginals(emit, trans, at, gradient=True)
    want, want_pairs = np.zeros(7), np.zeros((2, 2))
    for chain in ([0, 1, 2, 3], [4, 5, 6]):
        states = list(itertools.product((0, 1), repeat=len(chain)))
        score = np.exp([sum(emit[i] * s for i, s in zip(chain, y)) + sum(trans[a, b] for a, b in itertools.pairwise(y)) for y in states])
        score /= score.sum()
        for y, q in zip(states, score):
            for i, s in zip(chain, y):
                want[i] += q * s
            for a, b in itertools.pairwise(y):
                want_pairs[a, b] += q
    np.testing.assert_allclose(p, want, rtol=1e-9)
    np.testing.assert_allclose(pairs, want_pairs, rtol=1e-9)


def test_held_out_accuracy_and_edges(spark, empty):
    rows = list(corpus(600))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "x"), (9003, "long line " * 20_000), (9004, "\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.with_score(docs.withColumn("score", F.lit("x")), labels).collect()}
    held = [(i, q) for i, _, q in rows if got[i]["held_out"]]
    assert 80 < len(held) < 160
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == 605
    assert got[9001]["score"] == got[9002]["score"]
    none = quality.with_score(docs.limit(3), labels.limit(0)).collect()
    assert [r["score"] for r in none] == [0.5] * 3 and quality.with_score(empty, labels).count() == 0


def test_labels_of_other_documents_change_nothing(spark, caplog):
    rows = list(corpus(150, 4))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(rows[0][0], rows[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    others = spark.range(10_000, 60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    score = lambda l: sorted((r["doc_id"], r["score"]) for r in quality.with_score(docs, l).collect())
    assert score(labels.unionByName(others)) == score(labels)
    assert quality.train(docs, labels.unionByName(others), n=40)[0].tolist() == quality.train(docs, labels, n=40)[0].tolist()
    assert {s for _, s in score(others)} == {0.5} and "no labelled document" in caplog.text


def test_one_text_of_many_lines_pads_no_other():
    import tracemalloc

    texts = [b"\n" * 200_000] + [b"a short text."] * 3000
    rng = np.random.default_rng(1)
    model = (rng.normal(0, 1, quality.WIDTH), rng.normal(0, 1, (2, 2)))
    tracemalloc.start()
    assert len(quality.score_texts(texts, *model)) == 3001
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_scores_do_not_depend_on_company():
    texts = [t.encode() for _, t, _ in corpus(40, 3)]
    rng = np.random.default_rng(1)
    model = (rng.normal(0, 1, quality.WIDTH), rng.normal(0, 1, (2, 2)))
    together = quality.score_texts(texts, *model)
    np.testing.assert_allclose(together, np.concatenate([quality.score_texts([t], *model) for t in texts]), rtol=1e-9)


# chat


def talk(n, seed=0):
    rng = random.Random(seed)
    for c in range(n):
        turns = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 5)
        for t, role in enumerate(turns):
            k = {"system": 25, "user": 30, "assistant": 150}[role]
            yield c, t, role, ("" if role != "user" or rng.random() < 0.5 else "User: ") + " ".join(rng.choice(("so", "it", "goes", "on")) for _ in range(rng.randint(k // 2, k))) + ("?" if role == "user" and rng.random() < 0.7 else ".")


def test_held_out_roles(spark):
    turns = spark.createDataFrame(list(talk(150)), "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.recover_roles(turns).where("held_out").toPandas()
    assert len(got) > 100 and (got.role == got.role_found).mean() > 0.97
    assert got.rendered.str.match(r"^<\|(system|user|assistant)\|>\n").all() and not got.rendered.str.contains("User:").any()


def test_paths_equal_all_paths():
    rng = np.random.default_rng(0)
    start, trans, emit = rng.normal(0, 1, chat.STATES), rng.normal(0, 1, (chat.STATES, chat.STATES)), rng.normal(0, 1, (chat.STATES, chat.SIGNS))
    chains = [rng.integers(0, chat.SIGNS, n) for n in (1, 5, 3, 4, 1, 5)]

    def score(x, y, before):
        return (start if before < 0 else trans[before])[y[0]] + sum(emit[a, b] for a, b in zip(y, x)) + sum(trans[a, b] for a, b in itertools.pairwise(y))

    for before, end in (([-1] * 6, [-1] * 6), ([2, -1, 0, 1, 5, 3], [3, 0, -1, 5, 2, 1])):
        got = chat.best_paths(chains, before, end, start, trans, emit)
        for x, y, b, e in zip(chains, got, before, end):
            every = [p for p in itertools.product(range(chat.STATES), repeat=len(x)) if e < 0 or p[-1] == e]
            assert tuple(y) == max(every, key=lambda p: score(x, p, b))
    tables = chat.piece_scores(chains, [True, False] * 3, start, trans, emit)
    for x, m, first in zip(chains, tables, [True, False] * 3):
        for b in range(chat.STATES):
            for e in range(chat.STATES):
                every = [score(x, (*p, e), -1 if first else b) for p in itertools.product(range(chat.STATES), repeat=len(x) - 1)]
                assert m[b, e] == pytest.approx(max(every))


def test_pieces_give_the_path_of_one_run(spark, monkeypatch):
    rng = np.random.default_rng(0)
    model = (rng.normal(0, 1, chat.STATES), rng.normal(0, 1, (chat.STATES, chat.STATES)), rng.normal(0, 1, (chat.STATES, chat.SIGNS)))
    model[2][1::2, chat.SIGNS // 2 :] = chat._NEVER
    rows = list(talk(5)) + [(77, t, "user", f"{'q ' * (t % 40)}?\n{'x' * (t % 9)}") for t in range(60)] + [(78, 0, "user", f"x{i}") for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "train", lambda _: model)

    def found():
        return sorted((r["conv_id"], r["turn"], r["text"], r["role_found"], r["rendered"]) for r in chat.recover_roles(turns).collect())

    whole = found()
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert found() == whole


def test_raw_transcripts_are_cut_into_turns(spark):
    raw = "System: be brief\nUser: what is Q-learning?\nAI-based tools help me.\nAssistant: it learns values\n\nfrom rewards.\nUser: thanks"
    other = "**Human:** hi\n[Assistant] hello there\nAnswer to that: none of these\n## User\nA-levels are hard"
    rows = list(talk(60)) + [(9001, 0, None, raw), (9002, 0, None, other)]
    got = {r["conv_id"]: r for r in chat.recover_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id > 9000").collect()}
    turn = lambda role, body: f"<|{role}|>\n{body}\n<|end|>\n"
    assert got[9001]["rendered"] == turn("system", "be brief") + turn("user", "what is Q-learning?\nAI-based tools help me.") + turn("assistant", "it learns values\n\nfrom rewards.") + turn("user", "thanks")
    assert got[9002]["rendered"] == turn("user", "hi") + turn("assistant", "hello there\nAnswer to that: none of these") + turn("user", "A-levels are hard")
    assert (got[9001]["n_turns"], got[9001]["role_found"]) == (4, "system")


def test_only_markers_are_taken_away():
    for line in ("AI-based tools help.", "Q-learning is one.", "System-wide", "user:pass", "A question", "Model-free: no", "me", "human beings"):
        assert chat.marker(line) == 0 and chat.render(line, [4]) == f"<|assistant|>\n{line}\n<|end|>\n"
    assert chat.render("User: hi", [4]) == "<|assistant|>\nUser: hi\n<|end|>\n" and chat.render("Bot: hi", [4]) == "<|assistant|>\nhi\n<|end|>\n"


def test_chat_edges(spark):
    rows = [(1, 0, "USER", None), (1, 1, "robot", ""), (None, None, None, "x"), (None, 0, "user", "y"), (2, 3, "assistant", "long " * 50_000), (2, 3, "assistant", "long\n" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"sign": F.lit(1), "rendered": F.lit("r")})
    got = chat.recover_roles(turns)
    assert got.count() == 6 and got.where("role_found IS NULL OR rendered IS NULL").count() == 0 and "sign" in got.columns
    assert chat.recover_roles(turns.limit(0)).count() == 0

"""License scans by a positional index of rare licence words."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD_BYTES, saved

#: Base phrases: their places are always found, whatever the method adds.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def _published(version: int) -> list[str]:
    """The licence and its version as the usual notices of source files have them."""
    return [f"gnu general public license as published by the free software foundation {either}version {version} of the license" for either in ("either ", "")]


def _commons(*conditions: str) -> list[str]:
    return [f"creative commons attribution {c}" for c in conditions]


def _commons_notices(*conditions: str) -> list[str]:
    return [f"licensed under the {c} 4 0 international license" for c in _commons(*conditions)]


#: The begin of each label's SPDX identifier, as words.
SPDX = {
    "mit": "mit", "apache-2": "apache 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl": "lgpl", "agpl-3": "agpl 3 0", "bsd": "bsd", "mpl-2": "mpl 2 0", "isc": "isc",
    "cc-by": "cc by", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "cc-by-nd": "cc by nd", "cc0": "cc0 1 0", "unlicense": "unlicense", "epl": "epl", "eupl": "eupl",
    "boost": "bsl 1 0", "zlib": "zlib", "artistic-2": "artistic 2 0", "ofl": "ofl", "cddl": "cddl", "ms-pl": "ms pl",
}

#: Notices by label. Each has the phrases of which one must stand in it word by word, and its usual wordings.
TEMPLATES = {
    "mit": (["mit license", "permission is hereby granted free of charge"], ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"]),
    "apache-2": (["apache license version 2", "apache license 2 0"], ["apache license 2 0", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"]),
    "gpl-2": (["gnu general public license version 2", *_published(2)], [*_published(2), "licensed under the gnu general public license version 2", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"]),
    "gpl-3": (["gnu general public license version 3", *_published(3)], [*_published(3), "licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation"]),
    "lgpl": (["gnu lesser general public license"], ["licensed under the gnu lesser general public license"]),
    "agpl-3": (["gnu affero general public license"], ["licensed under the gnu affero general public license version 3"]),
    "bsd": (["bsd license", "redistribution and use in source and binary forms"], ["released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"]),
    "mpl-2": (["mozilla public license"], ["subject to the terms of the mozilla public license version 2 0"]),
    "isc": (["isc license", "permission to use copy modify and or distribute this software"], ["released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    "cc-by": (["creative commons attribution", "cc by 4 0", "cc by 3 0", "cc by 2 0"], ["licensed under the creative commons attribution 4 0 international license", "licensed under cc by 4 0", "licensed under cc by 3 0", "licensed under cc by 2 0"]),
    "cc-by-nc": (["cc by nc", *_commons("noncommercial", "non commercial")], ["licensed under cc by nc 4 0", *_commons_notices("noncommercial", "non commercial")]),
    "cc-by-sa": (["cc by sa", *_commons("sharealike", "share alike")], ["licensed under cc by sa 4 0", *_commons_notices("sharealike", "share alike")]),
    "cc0": (["cc0 1 0", "dedicated to the public domain"], ["this work is dedicated to the public domain under cc0 1 0 universal"]),
    "cc-by-nd": (["cc by nd", *_commons("noderivatives", "no derivatives", "noderivs", "no derivs")], ["licensed under cc by nd 4 0", *_commons_notices("noderivatives", "no derivatives", "noderivs", "no derivs")]),
    "unlicense": (["free and unencumbered software"], ["this is free and unencumbered software released into the public domain"]),
    "epl": (["eclipse public license"], ["made available under the terms of the eclipse public license version 2 0"]),
    "eupl": (["european union public licence"], ["licensed under the european union public licence version 1 2"]),
    "boost": (["boost software license"], ["distributed under the boost software license version 1 0"]),
    "zlib": (["zlib license", "altered source versions must be plainly marked"], ["released under the zlib license", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"]),
    "artistic-2": (["artistic license 2 0"], ["licensed under the artistic license 2 0"]),
    "ofl": (["sil open font license"], ["this font software is licensed under the sil open font license version 1 1"]),
    "cddl": (["common development and distribution license"], ["subject to the terms of the common development and distribution license"]),
    "ms-pl": (["microsoft public license"], ["licensed under the microsoft public license"]),
    "openrail": (["openrail license", "responsible ai license"], ["licensed under the openrail license", "subject to the terms of the responsible ai license"]),
    "reserved": (["all rights reserved"], ["all rights reserved"]),
}
for _label, _id in SPDX.items():
    for _part in TEMPLATES[_label]:
        _part.append(f"spdx license identifier {_id}")
#: Words too common to be looked up; they count for phrases alone.
COMMON = frozenset("a all and any are as by can either for from in is it of on or other that the this to with without you your may not be use file free person copy forms following met fee purpose".split())
#: Rarest words of a wording that the index has postings of.
RARE = 4
#: Share of a wording's weight that must stand where it belongs, give or take DRIFT words.
COVER, DRIFT = 0.6, 3

_WORDINGS = [(label, [w.encode() for w in text.split()]) for label, (_, texts) in TEMPLATES.items() for text in texts]
_VOCABULARY = {w: i for i, w in enumerate(sorted({w for _, ws in _WORDINGS for w in ws if w.decode() not in COMMON} | {w.encode() for p in [*PHRASES.values(), *(p for keys, _ in TEMPLATES.values() for p in keys)] for w in p.split() if w not in COMMON}))}


def _split(phrase: str) -> list[bytes]:
    return [w.encode() for w in phrase.split()]


_BASE = [(label, _split(p)) for label, p in PHRASES.items()]
#: label, phrase and the place in it of a word of the vocabulary
_KEYS = [(label, _split(p)) for label, (keys, _) in TEMPLATES.items() for p in keys]


def _by_anchor(phrases: list[tuple[str, list[bytes]]]) -> dict[bytes, list[tuple[int, str, list[bytes], int]]]:
    found: dict = {}
    for k, (label, p) in enumerate(phrases):
        at = min((i for i, w in enumerate(p) if w in _VOCABULARY), key=lambda i: (p[i] in (b"license", b"version", b"public", b"under"), i), default=0)
        found.setdefault(p[at], []).append((k, label, p, at))
    return found


_BASE_AT, _KEY_AT = _by_anchor(_BASE), _by_anchor(_KEYS)


def _inside() -> dict[int, list[tuple[int, int]]]:
    """Of each key phrase the longer ones of other labels that hold it, and where."""
    found: dict[int, list[tuple[int, int]]] = {}
    for k, (label, p) in enumerate(_KEYS):
        for long, (other, q) in enumerate(_KEYS):
            if other != label and len(q) > len(p):
                found.setdefault(k, []).extend((long, i) for i in range(len(q) - len(p) + 1) if q[i : i + len(p)] == p)
    return {k: x for k, x in found.items() if x}


_INSIDE = _inside()


def _places(text_words: list[bytes], hits: list[int], anchors: dict) -> list[tuple[int, int]]:
    """(phrase, start) of all places where a phrase's words stand consecutively."""
    out = []
    for i in hits:
        for k, _, p, at in anchors.get(text_words[i], ()):
            if i >= at and text_words[i - at : i - at + len(p)] == p:
                out.append((k, i - at))
    return out


def scan_words(text: bytes) -> tuple:
    """n_words, base phrases (which, start), key phrases (which, start), licence words (place, which) of one text."""
    text_words = text.translate(WORD_BYTES).split()
    asked = _VOCABULARY
    phrase_hits = [i for i, w in enumerate(text_words) if w in asked or w in _BASE_AT or w in _KEY_AT]
    base, keys = _places(text_words, phrase_hits, _BASE_AT), _places(text_words, phrase_hits, _KEY_AT)
    at = [i for i in phrase_hits if text_words[i] in asked]
    return len(text_words), [k for k, _ in base], [s for _, s in base], [k for k, _ in keys], [s for _, s in keys], at, [asked[text_words[i]] for i in at]


def _scanner():
    @F.pandas_udf("n_words long, base array<int>, base_at array<int>, key array<int>, key_at array<int>, place array<int>, word array<int>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scan_words(t or b"") for t in texts], columns=["n_words", "base", "base_at", "key", "key_at", "place", "word"])

    return scan


class Index:
    """Postings (wording, place) of the rarest words of each wording, and all words' weights (inverse document frequencies)."""

    def __init__(self, idf: list[float]):
        self.idf = idf
        self.weights, self.places, self.postings, self.rare = [], [], {}, []
        for t, (_, ws) in enumerate(_WORDINGS):
            places = [(i, _VOCABULARY[w]) for i, w in enumerate(ws) if w in _VOCABULARY]
            self.places.append(places)
            self.weights.append(sum(idf[v] for _, v in places))
            rare = sorted(places, key=lambda x: (-idf[x[1]], x[0]))[:RARE]
            self.rare.append(rare)
            for i, v in rare:
                self.postings.setdefault(v, []).append((t, i))

    def starts(self, stands: dict[int, list[int]]) -> dict[int, list[int]]:
        """Wordings that the text could hold, and where they would start.

        The text's words are looked up by falling weight. The first that a wording has a posting of gives the starts; these
        are intersected with the postings of the wording's other rare words by their relative places, give or take DRIFT words: of
        several rare words, one more must stand where it belongs.
        """
        found: dict[int, list[int]] = {}
        for v in sorted(stands, key=lambda v: (-self.idf[v], v)):
            for t, i in self.postings.get(v, ()):
                others = [(j, u) for j, u in self.rare[t] if (j, u) != (i, v)]
                # what a word of more weight has given already
                before = [u for j, u in others if (-self.idf[u], u, j) < (-self.idf[v], v, i) and u in stands]
                if len(before) > 1:
                    continue
                at = found.setdefault(t, [])
                at += [p - i for p in stands[v] if not others or any(_near(stands.get(u), p - i + j) for j, u in others)]
        return found

    def labels(self, key: list[int], key_at: list[int], place: list[int], word: list[int]) -> dict[str, float]:
        """Labels whose wording stands in the text and holds a key phrase, with the share of the wording that was found."""
        stands: dict[int, list[int]] = {}
        for p, v in zip(place, word, strict=True):
            stands.setdefault(v, []).append(p)
        phrases: dict[str, list[int]] = {}
        stand = set(zip(key, key_at, strict=True))
        for s, k in sorted(zip(key_at, key, strict=True)):
            # a phrase that is a part of another label's where it stands says nothing of its own
            if any((long, s - i) in stand for long, i in _INSIDE.get(k, ())):
                continue
            phrases.setdefault(_KEYS[k][0], []).append(s)
        found: dict[str, float] = {}
        for t, starts in self.starts(stands).items():
            label, ws = _WORDINGS[t]
            for start in set(starts) if label in phrases else ():
                if found.get(label, 0.0) >= 1.0:
                    break
                if not _between(phrases[label], start - DRIFT, start + len(ws) + DRIFT):
                    continue
                got = sum(self.idf[v] for i, v in self.places[t] if _near(stands.get(v), start + i))
                if got >= COVER * self.weights[t]:
                    found[label] = max(found.get(label, 0.0), min(1.0, got / self.weights[t]))
        return found


def _between(places: list[int] | None, lo: int, hi: int) -> bool:
    """Whether one of the sorted places lies from lo to hi."""
    if not places:
        return False
    i = bisect.bisect_left(places, lo)
    return i < len(places) and places[i] <= hi


def _near(places: list[int] | None, at: int) -> bool:
    return _between(places, at - DRIFT, at + DRIFT)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with n_words, n_base, first_word, last_word, base_labels, labels, score and label_scores.

    Texts are lower-cased (A-Z) and taken word by word, whole; null counts as empty. One pass over the texts keeps
    the places of licence words, which few texts have. Document frequencies over all texts make the
    index: of each wording the rarest words. Its postings name the wordings and starts that a text could hold; of these
    the ones count that hold a mandatory phrase word by word and enough of the wording in place. A base phrase
    has the score 1, a text without labels 0. Texts of any length are taken whole, rows that repeat each. Columns of the result's
    names are replaced, others stay. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "label_scores")]
    rows = saved(docs.select(*keep, _scanner()(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__scan")), "license-words")
    # one row for each word of the templates' vocabulary at most
    seen = rows.select(F.explode(F.array_distinct("__scan.word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    total, df = rows.count(), {r["word"]: r["n"] for r in seen}
    index = Index([1 + math.log((total + 1) / (df.get(v, 0) + 1)) for v in range(len(_VOCABULARY))])

    @F.pandas_udf("map<string,double>")
    def label(key: pd.Series, key_at: pd.Series, place: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([index.labels(list(a), list(b), list(c), list(d)) if len(a) else {} for a, b, c, d in zip(key, key_at, place, word, strict=True)])

    some = F.size("__scan.key") > 0
    found = rows.where(some).withColumn("label_scores", label("__scan.key", "__scan.key_at", "__scan.place", "__scan.word"))
    found = found.unionByName(rows.where(~some).withColumn("label_scores", F.expr("cast(map() as map<string,double>)")))
    names = F.array(*(F.lit(x) for x in PHRASES))
    base = F.array_sort(F.array_distinct(F.transform("__scan.base", lambda i: F.element_at(names, i + 1))))
    both = F.array_sort(F.array_distinct(F.concat(base, F.map_keys("label_scores"))))
    score = F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.map_values("label_scores")), F.lit(0.0)))
    return found.select(
        *keep,
        F.col("__scan.n_words").alias("n_words"),
        F.size("__scan.base").cast("long").alias("n_base"),
        F.array_min("__scan.base_at").cast("long").alias("first_word"),
        F.array_max("__scan.base_at").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        score.alias("score"),
        "label_scores",
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("label_scores")

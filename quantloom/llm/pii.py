"""Personal data by weak supervision (DataFrame functions only on the rows)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = 4

# Patterns that also match the runs a base match could start in, so that matching is linear in any text; what is no candidate is
# left out afterwards. Possessive quantifiers keep Java's matcher from recursing.
_EMAIL = r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+"
_IP = r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL_PHONE = r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
_SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}+){1,8}+"

_SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+"

#: Gazetteers: top-level domains, country calling codes, issuers' leading digits, how access keys of large services begin.
DOMAINS = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|ai|co|app|dev|cloud|online|shop|site|tech|xyz|"
    "at|au|be|bg|br|ca|ch|cl|cn|cz|de|dk|ee|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|in|ir|is|it|jp|ke|kr|lt|lu|lv|mx|my|ng|nl|no|nz|"
    "pe|ph|pk|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tw|ua|uk|us|uy|ve|vn|za"
)
KEYS = r"(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ)"
CALLING = r"\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"(4|5[1-5]|2[2-7]|3[47]|6011|65)"
#: Words that announce each kind, looked for in the characters before a candidate.
CONTEXT = {"email": "e-?mail|contact|write|mail", "ip": r"\bip\b|address|server|host", "card": "card|visa|mastercard|amex|credit|payment", "phone": "phone|call|tel|fax|mobile|dial", "id": "ssn|social|security|passport|id", "secret": "token|secret|password|passwd|api.?key|access.?key|private.?key|credential"}
CONTEXT_CHARS = 32
#: Values of a span's shape, which the classifier sees beside the votes: 2 for four or more different characters, 1 for 14 or more in all.
SHAPES = 4
VOTERS = ("format", "gazetteer", "context", "border")
VOTES = (-1, 0, 1)
#: Voters whose 0 is no opinion. A context that announces nothing is one.
ABSTAIN = ("format", "gazetteer")
#: What is believed of voters before any count: a failed check is a strong sign, so is an announcing word.
PRIOR = {("format", 1, 1): 20.0, ("format", 0, -1): 20.0, ("context", 1, 1): 10.0, ("context", 0, 0): 10.0}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_ip(m: Column) -> Column:
    def small(x):
        x = F.regexp_replace(x, "^0+", "")
        return F.when(F.length(x) <= 3, F.concat(F.lit("0"), x).cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, r"\."), small)


def _is_card(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(False)


def _is_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def _unchecked(m: Column) -> Column:
    return F.lit(0)


def _random(m: Column) -> Column:
    """Keys are drawn from many different characters, digits among them."""
    different, digits = F.size(F.array_distinct(F.split(m, ""))), F.length(_digits(m))
    return _vote((different >= 10) & (digits >= 4) & ~m.contains("/"), (different < 8) | (digits < 2))


def _located(text: Column, pattern: str, kind: str, candidate: Callable[[Column], Column], base: Callable[[Column], Column], gazetteer: Callable[[Column], Column], form: Callable[[Column], Column] | None = None) -> Column:
    """All candidates of a pattern, in order: kind, start, end (code points), base, each voter's vote and the shape.

    A text is the pieces between the matches and the matches in turn, so one pass over both has all offsets. Spark copies a list to
    append to it, so the pass goes in blocks of about the root of their number, each with a list of its own.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    number = F.lit(KINDS.index(kind))

    def found(start, m, before):
        ok = F.coalesce(base(m), F.lit(False))
        varied = F.size(F.array_distinct(F.split(m, ""))) >= 4
        return F.struct(
            number.alias("kind"),
            start.alias("start"),
            (start + F.length(m)).alias("end"),
            ok.alias("base"),
            (form(m) if form else _vote(ok, ~ok)).alias("format"),
            gazetteer(m).alias("gazetteer"),
            _vote(F.lower(before).rlike(CONTEXT[kind])).alias("context"),
            _vote(~before.rlike("[A-Za-z0-9_]$"), before.rlike("[A-Za-z0-9_]$")).alias("border"),
            (varied.cast("int") * 2 + (F.length(m) >= 14).cast("int")).alias("shape"),
        )

    none, far = F.array().cast(CANDIDATES), F.lit(CONTEXT_CHARS)

    def step(acc, x):
        start, before = acc["at"] + F.length(x["gap"]), F.right(F.concat(acc["tail"], x["gap"]), far)
        out = F.when(candidate(x["m"]), F.concat(acc["out"], F.array(found(start, x["m"], before)))).otherwise(acc["out"])
        on = F.struct((start + F.length(x["m"])).alias("at"), F.right(F.concat(before, x["m"]), far).alias("tail"), out.alias("out"))
        return F.when(x["m"].isNull(), acc).otherwise(on)

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), inner["tail"].alias("tail"), F.concat(acc["out"], inner["out"]).alias("out"))

    def blocks(all_pieces):
        size = F.ceil(F.sqrt(F.size(all_pieces).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.slice(all_pieces, k * size + 1, size))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out"))
    return F.aggregate(F.flatten(F.transform(F.array(pieces), blocks)), zero, block, lambda acc: acc["out"])


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,format:int,gazetteer:int,context:int,border:int,shape:int>>"


def candidates(text: Column) -> Column:
    """Candidates of a text: base matches, matches that fail their check, and looser forms outside these."""
    none, yes, no = F.array().cast(CANDIDATES), lambda m: F.lit(True), lambda m: F.lit(False)
    digit = text.rlike("[0-9]")
    strict = [
        F.when(text.contains("@"), _located(text, _EMAIL, "email", lambda m: m.contains("@"), yes, lambda m: _vote(F.lower(m).rlike(rf"\.({DOMAINS})$")))).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _located(text, _IP, "ip", lambda m: m.contains("."), _is_ip, lambda m: _vote(F.lit(False), m.rlike(r"^0")))).otherwise(none),
        F.when(digit, _located(text, _CARD, "card", lambda m: F.length(_digits(m)).between(12, 20), _is_card, lambda m: _vote(m.rlike("^" + ISSUERS), ~m.rlike("^" + ISSUERS)))).otherwise(none),
        F.when(text.contains("+"), _located(text, _PHONE, "phone", lambda m: F.length(_digits(m)) >= 7, _is_phone, lambda m: _vote(m.rlike("^" + CALLING)))).otherwise(none),
    ]
    loose = [
        F.when(text.contains("at]") | text.contains("at)"), _located(text, _SPELT_EMAIL, "email", yes, no, lambda m: _vote(F.lower(m).rlike(rf"({DOMAINS})$")), _unchecked)).otherwise(none),
        F.when(digit, _located(text, _LOCAL_PHONE, "phone", yes, no, lambda m: _vote(F.lit(False)), _unchecked)).otherwise(none),
        F.when(digit, _located(text, _SECRET, "secret", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), no, lambda m: _vote(m.rlike("^" + KEYS)), _random)).otherwise(none),
        F.when(digit, _located(text, _ID, "id", yes, no, lambda m: _vote(~m.rlike("^(000|666|9)"), m.rlike("^(000|666|9)")), _unchecked)).otherwise(none),
    ]
    return F.concat(*strict, *loose)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _said(votes: tuple[int, ...]) -> list[tuple[int, int]]:
    """(voter, vote) of the voters with an opinion."""
    return [(j, v) for j, v in enumerate(votes) if v or VOTERS[j] not in ABSTAIN]


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[float]]:
    """Expectation-maximisation over vote patterns (kind, votes, count): P(real) of each pattern, and the log-odds that each voter's votes and each kind add.

    Starts from the votes' sum less one. There are at most len(KINDS) * 3 ** len(VOTERS) patterns, whatever the corpus.
    """
    p = [_sigmoid(sum(votes) - 1.0) for _, votes, _ in patterns]
    table: dict = {}
    for _ in range(rounds):
        prior = {}
        for k in range(len(KINDS)):
            n = sum(c for kind, _, c in patterns if kind == k)
            prior[k] = (sum(q * c for q, (kind, _, c) in zip(p, patterns, strict=True) if kind == k) + 10) / (n + 20)
        for j in range(len(VOTERS)):
            for real in (0, 1):
                weight = {v: PRIOR.get((VOTERS[j], real, v), 0.5) for v in VOTES}
                for q, (_, votes, c) in zip(p, patterns, strict=True):
                    if (j, votes[j]) in _said(votes):
                        weight[votes[j]] += c * (q if real else 1 - q)
                total = sum(weight.values())
                table[j, real] = {v: w / total for v, w in weight.items()}
        p = []
        for kind, votes, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[j, 1][v] / table[j, 0][v]) for j, v in _said(votes))
            p.append(_sigmoid(odds))
    w = [0.0 if v == 0 and VOTERS[j] in ABSTAIN else math.log(table[j, 1][v] / table[j, 0][v]) for j in range(len(VOTERS)) for v in VOTES]
    return p, w + [math.log(prior[k] / (1 - prior[k])) for k in range(len(KINDS))]


def fit_classifier(patterns: list[tuple[int, tuple[int, ...], int, int]], p: list[float], start: list[float], steps: int = 200, rate: float = 0.5, l2: float = 1e-2) -> list[float]:
    """The span classifier: logistic regression from votes, kind and shape to the estimated P(real).

    patterns: kind, votes, shape, count. A weight for each (voter, vote), then for each kind, then for each kind's shape. Voters overlap, so the
    weights are fitted together; rare votes stay near the log-odds they start from. Shapes, which nobody votes on, start from their own log-odds
    among a kind's spans: they tell spans apart where votes alone do not.
    """
    kinds, shapes = len(VOTERS) * len(VOTES), len(VOTERS) * len(VOTES) + len(KINDS)

    def features(kind: int, votes: tuple[int, ...], shape: int) -> list[int]:
        return [j * len(VOTES) + VOTES.index(v) for j, v in _said(votes)] + [kinds + kind, shapes + kind * SHAPES + shape]

    rows = [(features(kind, votes, shape), q, math.sqrt(c)) for (kind, votes, shape, c), q in zip(patterns, p, strict=True)]
    n = sum(c for *_, c in rows)
    for k in range(len(KINDS)):
        real, not_ = ([10 + sum((q if good else 1 - q) * c for q, (kind, _, shape, c) in zip(p, patterns, strict=True) if (kind, shape) == (k, x)) for x in range(SHAPES)] for good in (True, False))
        start = start + [math.log(a / sum(real)) - math.log(b / sum(not_)) for a, b in zip(real, not_, strict=True)]
    w = list(start)
    for _ in range(steps):
        g = [l2 * (s - x) for s, x in zip(start, w, strict=True)]
        for at, q, c in rows:
            gap = (q - _sigmoid(sum(w[i] for i in at))) * c / n
            for i in at:
                g[i] += gap
        w = [x + rate * len(VOTERS) * d for x, d in zip(w, g, strict=True)]
    return w


def learn(patterns: list[tuple[int, tuple[int, ...], int, int]]) -> list[float]:
    """The classifier's weights from all candidates' (kind, votes, shape, count)."""
    if not patterns:
        return [0.0] * (len(VOTERS) * len(VOTES) + len(KINDS) * (1 + SHAPES))
    merged: dict[tuple[int, tuple[int, ...]], int] = {}
    for kind, votes, _, c in patterns:
        merged[kind, votes] = merged.get((kind, votes), 0) + c
    p, start = reliabilities([(kind, votes, c) for (kind, votes), c in merged.items()])
    of = dict(zip(merged, p, strict=True))
    return fit_classifier(patterns, [of[kind, votes] for kind, votes, _, _ in patterns], start)


def _score(x: Column, w: list[float]) -> Column:
    kinds, shapes = len(VOTERS) * len(VOTES), len(VOTERS) * len(VOTES) + len(KINDS)
    total = F.element_at(F.array(*(F.lit(v) for v in w[kinds:shapes])), x["kind"] + 1) + F.element_at(F.array(*(F.lit(v) for v in w[shapes:])), x["kind"] * SHAPES + x["shape"] + 1)
    for j, name in enumerate(VOTERS):
        total = total + F.element_at(F.array(*(F.lit(v) for v in w[j * len(VOTES) : (j + 1) * len(VOTES)])), x[name] + 2)
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs (without the text) with found: all spans (kind, start, end, base, score), by kind, then start.

    Null counts as the empty text, which has no spans; texts of any length are searched whole. Base spans always stay; any other
    candidate stays that the classifier gives ``threshold`` or more and that overlaps no base span. The candidates, few beside the texts, are
    kept in the shared folder, so texts are read once. Voters' reliabilities come from all candidates of all texts. Rows that repeat are
    searched each. A column named found is replaced, others stay. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in (text, "found")]
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = saved(rows.select(*keep, candidates(F.col("__text")).alias("__found")), "pii-candidates")
    each = rows.select(F.explode("__found").alias("x")).groupBy("x.kind", *(f"x.{v}" for v in VOTERS), "x.shape").agg(F.count("*").alias("n"))
    # at most len(KINDS) * 3 ** len(VOTERS) * SHAPES rows
    w = learn([(r["kind"], tuple(r[v] for v in VOTERS), r["shape"], r["n"]) for r in each.orderBy("kind", *VOTERS, "shape").collect()])
    base = F.filter("__found", lambda x: x["base"])
    clash = lambda x: F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.filter("__found", lambda x: ~x["base"] & (_score(x, w) >= threshold) & ~clash(x))
    both = rows.withColumn("__base", base).withColumn("__all", F.when(F.size("__found") == 0, F.array().cast(CANDIDATES)).otherwise(F.array_sort(F.concat("__base", extra))))
    out = F.transform("__all", lambda x: F.struct(F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), _score(x, w).alias("score")))
    return both.select(*keep, out.alias("found"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_weak_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["base"])
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))

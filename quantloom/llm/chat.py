"""Chat transcripts: speakers by a hidden Markov model over lines, then canonical turns."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import saved

ROLES = ("system", "user", "assistant")
#: States: each role, opening a turn or going on with it.
STATES = 2 * len(ROLES)
#: Rows of a conversation that one step takes together.
CHUNK = 256
#: Speaker markers that a line may open with, by the role they name.
NAMES = {"system": r"system|instructions?", "user": r"user|human|customer|question|q|me", "assistant": r"assistant|ai|bot|agent|answer|a|model"}
_FORMS = r"\s*(?:<\|(?:{0})\|>|\[(?:{0})\]\s*:?|\*\*(?:{0})\s*:?\*\*\s*:?|\#+\s*(?:{0})\s*:?\s*$|(?:{0})\s*[:>])(?:\s+|$)"
_MARKERS = {role: re.compile(_FORMS.format(names), re.I) for role, names in NAMES.items()}
_ANY = re.compile(_FORMS.format("|".join(NAMES.values())), re.I)
#: A line's sign: opens a row, marker, length (powers of two), a question, a closing full stop, blank.
LENGTH_STEPS = 8
FLAGS = 8
LOOKS = LENGTH_STEPS * FLAGS
SIGNS = 2 * (len(ROLES) + 1) * LOOKS
SMOOTH = 0.5
#: Lines that are believed of before any count: an opening line has its own role's marker, none, another's; any other line has none, one.
OPENING, GOING_ON = (5.0, 10.0, 0.001), (50.0, 0.001)
#: How likely a line without marker opens a turn inside a row.
UNMARKED = 1e-3
FOLDS = 5
_NEVER = -1e9


def marker(line: str) -> int:
    """0 without a marker, else 1 plus the number of the role that it names."""
    return next((k for k, r in enumerate(ROLES, 1) if _MARKERS[r].match(line)), 0) if _ANY.match(line) else 0


def signs_of(text: str) -> list[int]:
    """The sign of each line of a row."""
    out = []
    for i, line in enumerate(text.split("\n")):
        bare = line.strip()
        x = (i == 0) * (len(ROLES) + 1) + (marker(line) if bare else 0)
        x = x * LENGTH_STEPS + min(LENGTH_STEPS - 1, max(0, len(bare).bit_length() - 2))
        out.append(x * FLAGS + ("?" in bare) * 4 + (bare[-1:] in (".", "!")) * 2 + (not bare))
    return out


def observed(turns: DataFrame) -> DataFrame:
    """turns with __conv, __piece and __place (its position), __role (0, 1, 2, null where unknown) and __signs (one for each line).

    A piece is up to CHUNK rows: those of a span of turn numbers, cut further where numbers repeat. Equal turn
    numbers are in order of text and role.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    conv = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    known = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.lower("role")).cast("int") - 1
    body = F.coalesce(F.col("text"), F.lit(""))

    @F.pandas_udf("array<short>")
    def signs(texts: pd.Series) -> pd.Series:
        return pd.Series([signs_of(t) for t in texts])

    t = turns.withColumns({"__conv": conv, "__chunk": F.floor(turn / CHUNK).cast("long"), "__role": F.when(known >= 0, known), "__signs": signs(body)})
    w = Window.partitionBy("__conv", "__chunk").orderBy(F.col("turn").cast("long"), body, "role")
    t = t.withColumn("__place", (F.row_number().over(w) - 1).cast("long"))
    return t.withColumn("__piece", F.col("__chunk") * (1 << 32) + F.floor(F.col("__place") / CHUNK).cast("long")).drop("__chunk")


def _log_table(counts: np.ndarray) -> np.ndarray:
    p = counts + SMOOTH
    return np.log(p / p.sum(axis=-1, keepdims=True))


def emissions(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities (states x signs) from counts of the same shape: of a line's marker and of its look.

    The first line of a row opens a turn for certain.
    """
    n = len(ROLES) + 1
    by = counts.reshape(STATES, 2, n, LOOKS)
    look, mark = _log_table(by.sum(axis=(1, 2))), by.sum(axis=(1, 3))
    for s in range(STATES):
        own, none, other = (OPENING if s % 2 == 0 else (GOING_ON[1], *GOING_ON))
        prior = np.full(n, other)
        prior[0], prior[s // 2 + 1] = none, own
        mark[s] += prior
    mark = np.log(mark / mark.sum(axis=1, keepdims=True))
    out = np.zeros((STATES, 2, n, LOOKS)) + look[:, None, None, :] + mark[:, None, :, None]
    out[1::2, 1] = _NEVER
    out[0::2, 0, 0] += np.log(UNMARKED)
    return out.reshape(STATES, SIGNS)


def train(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission log-probabilities from all rows of known roles outside the held-out fold.

    A row of a known role is one turn. Counts of at most so many groups as there are pairs of states, or states and
    signs, reach the driver.
    """
    start, trans, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SIGNS))
    last = F.when(F.col("__role").isNotNull(), 2 * F.col("__role") + (F.size("__signs") > 1).cast("int"))
    seen = rows.where(~held_out(F.col("conv_id"))).select("__conv", "__piece", "__place", "__role", "__signs", last.alias("__last"))
    for r in seen.where("__role IS NOT NULL").select("__role", F.posexplode("__signs").alias("at", "sign")).groupBy("__role", (F.col("at") > 0).cast("int").alias("on"), "sign").agg(F.count("*").alias("n")).collect():
        emit[2 * r["__role"] + r["on"], r["sign"]] += r["n"]
    more = F.size("__signs").cast("long")
    for r in seen.where("__role IS NOT NULL").groupBy("__role").agg(F.sum((more > 1).cast("long")).alias("first"), F.sum(F.greatest(more - 2, F.lit(0))).alias("rest")).collect():
        k = 2 * r["__role"]
        trans[k, k + 1] += r["first"]
        trans[k + 1, k + 1] += r["rest"]
    w = Window.partitionBy("__conv", "__piece").orderBy("__place")
    inner = seen.select("__role", F.lag("__last").over(w).alias("last"))
    ends = seen.groupBy("__conv", "__piece").agg(F.min(F.struct("__place", "__role")).alias("a"), F.max(F.struct("__place", "__last")).alias("z"))
    w = Window.partitionBy("__conv").orderBy("__piece")
    outer = saved(ends.select(F.col("a.__role").alias("__role"), F.lag("z.__last").over(w).alias("last"), (F.row_number().over(w) == 1).alias("first")), "chat-ends")
    for r in inner.unionByName(outer.select("__role", "last")).where("__role IS NOT NULL AND last IS NOT NULL").groupBy("last", "__role").agg(F.count("*").alias("n")).collect():
        trans[r["last"], 2 * r["__role"]] += r["n"]
    for r in outer.where("first AND __role IS NOT NULL").groupBy("__role").agg(F.count("*").alias("n")).collect():
        start[2 * r["__role"]] = r["n"]
    trans = _log_table(trans)
    for s in range(STATES):
        # a turn goes on in its own role
        trans[s, [k for k in range(1, STATES, 2) if k // 2 != s // 2]] = _NEVER
    return _log_table(start), trans, emissions(emit)


def held_out(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _side_by_side(lengths: np.ndarray, cells: int = 1 << 18) -> list[np.ndarray]:
    """Chains in groups of about equal length, by falling length."""
    order, out, lo = np.argsort(-lengths, kind="stable"), [], 0
    while lo < len(order):
        hi = min(len(order), lo + max(1, cells // int(lengths[order[lo]])))
        out.append(order[lo:hi])
        lo = hi
    return out


def _table(chains: Sequence[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (steps x chains of the group) and how many chains each step still has."""
    size = np.array([len(chains[i]) for i in group])
    x = np.zeros((size[0], len(group)), np.int64)
    for j, i in enumerate(group):
        x[: size[j], j] = chains[i]
    return x, (size[None, :] > np.arange(size[0])[:, None]).sum(axis=1)


def piece_scores(chains: Sequence[np.ndarray], opens: Sequence[bool], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> list[np.ndarray]:
    """Of each piece the best scores (state before it x state at its end), all side by side; a conversation's first piece has equal rows."""
    out: list = [None] * len(chains)
    for group in _side_by_side(np.array([len(c) for c in chains])):
        x, live = _table(chains, group)
        first = np.where(np.array([opens[i] for i in group])[:, None, None], start[None, None, :], trans[None])
        best = first + emit.T[x[0]][:, None, :]
        for t in range(1, len(x)):
            c = live[t]
            best[:c] = (best[:c, :, :, None] + trans).max(axis=2) + emit.T[x[t, :c]][:, None, :]
        for j, i in enumerate(group):
            out[i] = best[j]
    return out


def best_paths(chains: Sequence[np.ndarray], before: Sequence[int], end: Sequence[int], start: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> list[np.ndarray]:
    """The most likely states of each chain, all side by side, given the state before it (-1: none) and its last state (-1: the best)."""
    out: list = [None] * len(chains)
    for group in _side_by_side(np.array([len(c) for c in chains])):
        x, live = _table(chains, group)
        b = np.array([before[i] for i in group])
        best = np.where(b[:, None] < 0, start, trans[b]) + emit.T[x[0]]
        back = np.zeros((len(x), len(group), STATES), np.int8)
        for t in range(1, len(x)):
            c = live[t]
            both = best[:c, :, None] + trans
            back[t, :c] = both.argmax(axis=1)
            best[:c] = both.max(axis=1) + emit.T[x[t, :c]]
        e = np.array([end[i] for i in group])
        state = np.where(e < 0, best.argmax(axis=1), e)
        path = np.zeros(x.shape, np.int64)
        for t in range(len(x) - 1, -1, -1):
            c = live[t]
            path[t, :c] = state[:c]
            state[:c] = back[t, np.arange(c), state[:c]]
        for j, i in enumerate(group):
            out[i] = path[: len(chains[i]), j]
    return out


def _between(pieces: DataFrame) -> DataFrame:
    """For each piece of conversations of several the state before it (-1 for the first) and its last state, on the best path.

    A group is a conversation's score matrices, one for CHUNK rows. The path is traced back once, so that pieces meet
    in the same state even where several paths are equally good.
    """

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__piece")
        m = np.stack(group["scores"].to_list()).reshape(-1, STATES, STATES)
        best = [m[0].max(axis=0)]
        for one in m[1:]:
            best.append(((best[-1] - best[-1].max())[:, None] + one).max(axis=0))
        end = [int(best[-1].argmax())]
        for i in range(len(m) - 1, 0, -1):
            end.append(int(((best[i - 1] - best[i - 1].max()) + m[i][:, end[-1]]).argmax()))
        end = end[::-1]
        return pd.DataFrame({"__conv": group["__conv"], "__piece": group["__piece"], "before": [-1, *end[:-1]], "end": end})

    return pieces.select("__conv", "__piece", "scores").groupBy("__conv").applyInPandas(along, "__conv string, __piece long, before int, end int")


def turns_of(text: str, states: Sequence[int]) -> list[tuple[str, str]]:
    """(role, text) of the turns of a row: without the marker of the role found and outer blanks."""
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(text.split("\n"), states, strict=True):
        role = ROLES[s // 2]
        if s % 2 == 0:
            out.append((role, [line[m.end() :] if (m := _MARKERS[role].match(line)) else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(lines).strip()) for role, lines in out]


def render(text: str, states: Sequence[int]) -> str:
    """The canonical form of a row's turns."""
    return "".join(f"<|{role}|>\n{body}\n<|end|>\n" for role, body in turns_of(text, states))


def recover_roles(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with held_out, role_found, n_turns and rendered; columns of those names are replaced.

    A row is a turn, or a stretch of a raw transcript with several (such a row has no role). Its first line opens a turn; other lines may, as their
    marker and look suggest. The model is learnt from the rows of known roles (any case) outside the held-out conversations; without any, only
    what is believed beforehand counts. The most likely speakers of a whole conversation's lines are found in pieces of up to CHUNK rows;
    conversations of several give the best scores from state to state for each piece, these are put in order, then each piece is traced
    back. role_found is the speaker of the row's first turn, rendered has all its turns.
    Null texts are empty; a null conv_id is a conversation of its own, null turns come first, rows that repeat count each. Long texts are
    taken whole, line by line. Other columns, of any name, stay. An empty table gives no rows.
    """
    turns = turns.drop("held_out", "role_found", "n_turns", "rendered")
    rows = saved(observed(turns), "chat-turns")
    start, trans, emit = train(rows)
    # few bytes and much work: a fixed number of tasks, which Spark doesn't merge
    tasks = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = rows.groupBy("__conv", "__piece").agg(F.array_sort(F.collect_list(F.struct("__place", "__signs"))).alias("seen"))
    spans = rows.groupBy("__conv").agg(F.min("__piece").alias("__first"), F.max("__piece").alias("__last"))
    pieces = listed.join(spans, "__conv").select("__conv", "__piece", (F.col("__piece") == F.col("__first")).alias("opens"), (F.col("__first") == F.col("__last")).alias("alone"), F.transform("seen", lambda x: x["__place"]).alias("places"), F.transform("seen", lambda x: x["__signs"]).alias("signs"))
    pieces = saved(pieces.repartition(tasks, "__conv", "__piece"), "chat-pieces")

    @F.pandas_udf("array<double>")
    def scores(signs: pd.Series, opens: pd.Series) -> pd.Series:
        found = piece_scores([np.concatenate(list(s)) for s in signs], list(opens), start, trans, emit)
        return pd.Series([m.ravel() for m in found])

    @F.pandas_udf("array<array<int>>")
    def path(signs: pd.Series, before: pd.Series, end: pd.Series) -> pd.Series:
        found = best_paths([np.concatenate(list(s)) for s in signs], list(before), list(end), start, trans, emit)
        return pd.Series([[x.tolist() for x in np.split(p, np.cumsum([len(x) for x in s])[:-1])] for p, s in zip(found, signs, strict=True)])

    @F.pandas_udf("string")
    def shown(texts: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([render(t, s) for t, s in zip(texts, states, strict=True)], dtype=object)

    several = pieces.where("NOT alone").repartition(tasks, "__conv", "__piece").withColumn("scores", scores("signs", "opens"))
    at = saved(_between(several), "chat-between")
    one = pieces.where("alone").withColumns({"before": F.lit(-1), "end": F.lit(-1)})
    both = one.unionByName(pieces.where("NOT alone").join(at, ["__conv", "__piece"]))
    traced = both.repartition(tasks, "__conv", "__piece").select("__conv", "__piece", F.explode(F.arrays_zip("places", path("signs", "before", "end").alias("path"))).alias("x"))
    found = rows.join(traced.select("__conv", "__piece", F.col("x.places").alias("__place"), F.col("x.path").alias("__states")), ["__conv", "__piece", "__place"])
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), F.floor(F.col("__states")[0] / 2).cast("int") + 1)
    n_turns = F.size(F.filter("__states", lambda s: s % 2 == 0)).cast("long")
    found = found.withColumns({"held_out": held_out(F.col("conv_id")), "role_found": role, "n_turns": n_turns, "rendered": shown(F.coalesce("text", F.lit("")), "__states")})
    return found.select(*turns.columns, "held_out", "role_found", "n_turns", "rendered")


def op10_chat_roles(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = recover_roles(turns)
    return found.select("conv_id", "turn", "role", "held_out", "role_found", "n_turns", F.length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))

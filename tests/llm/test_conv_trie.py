"""The trie of conversation prefixes against its oracle and a plain trie."""

import hashlib
import math
import random
import zlib

from helpers import TESTDATA, cells, oracle

from quantloom.llm import conv_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, pos int"


def plain(rows):
    """The nodes by dictionaries of paths."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len("".join(" " if ch in " \t\n\v\f\r" else ch for ch in t).split(" ")) - sum(not x for x in "".join(" " if ch in " \t\n\v\f\r" else ch for ch in t).split(" "))
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(path))))
        out.append((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids(path)), sum(not kids(p) for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def nodes(spark, rows, widths=conv_trie.WIDTHS):
    turns = conv_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    return conv_trie.prefix_trie(turns.select("conv_id").distinct(), conv_trie.rebuild(turns), widths)


def test_nodes_equal_a_plain_trie(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 60), 400, -7]:
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c  d\te"]), "k", 1) for t in range(rng.randint(1, 6))]
    rows += [(5, 2, "user", "a", "k", 1)] * 2 + [(None, 1, "user", "lost", "k", 1), (7, 99, "user", "w " * 5000, "k", 1)]
    rows += [(40, t, "user", str(t), "k", 1) for t in range(30)]  # one long conversation: several blocks
    want = plain(rows)
    assert found(nodes(spark, rows)) == want
    assert found(nodes(spark, rows, (2, 3))) == want


def test_nodes_equal_the_oracle(spark):
    path = f"{TESTDATA}/conversations.parquet"
    got = conv_trie.op13_prefix_trie(spark, TESTDATA).toPandas()
    assert cells(got) == cells(oracle(conv_trie.OP13_SQL, conversations=path))


def test_one_group_of_copies_and_conversations_without_turns(spark):
    # conversation 21 has no own turn after its first h, and its family's first conversation (20) does not exist
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(c, 1, "user", "only", "k", 1)] + [(1000 + 20 * i, t, "user", f"same {t}", "k", 1) for i in range(300) for t in range(3)]
    got = found(nodes(spark, rows))
    assert got == plain(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 301 and root[7] == hashlib.sha256(str(c).encode()).hexdigest()


def test_no_conversations(spark):
    assert nodes(spark, []).count() == 0
    assert nodes(spark, [(None, 1, "user", "x", "k", 1)]).count() == 0

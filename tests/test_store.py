"""Documents, records and price tables on a shared file system."""

import json
import threading

import pytest
from helpers import date

from quantloom.sources.config import Strategy, config_hash
from quantloom.sources.prices import CachedSource, FunctionSource, cache_key
from quantloom.sources.records import SharedRecords, matches
from quantloom.sources.store import Conflict, Store

ONE, OTHER = Strategy(universe=("A",)), Strategy(universe=("A",), vol_window=61)


@pytest.fixture(params=["", "file://"])
def root(request, tmp_path):
    return f"{request.param}{tmp_path}/shared"


def at_once(*calls):
    """What each call gave or raised, all begun together."""
    found, gate = [None] * len(calls), threading.Barrier(len(calls))

    def run(i):
        gate.wait()
        try:
            found[i] = calls[i]()
        except Exception as e:  # noqa: BLE001
            found[i] = e

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(calls))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return found


def test_documents(spark, root):
    s = Store(spark, root)
    assert s.read("a/b") is None and s.names("a") == [] and s.latest("a") == (0, None)
    s.create("a/b", "tëxt\n")
    assert s.read("a/b") == "tëxt\n" and s.names("a") == ["b"]
    with pytest.raises(Conflict):
        s.create("a/b", "other")
    assert s.put("doc", "one", 0) == 1 and s.put("doc", "two", 1) == 2 and s.latest("doc") == (2, "two")
    with pytest.raises(Conflict, match="version 2"):
        s.put("doc", "three", 1)
    assert s.update("doc", lambda t: t + "!") == "two!" and s.latest("doc") == (3, "two!")
    assert s.update("doc", lambda t: t) == "two!" and s.versions("doc") == [1, 2, 3]


def test_one_of_many_writers_wins(spark, root):
    for round_ in range(4):
        found = at_once(*(lambda i=i: Store(spark, root).create(f"x{round_}", f"writer {i}") for i in range(6)))
        won = [i for i, x in enumerate(found) if x is None]
        assert len(won) == 1 and all(isinstance(x, Conflict) for i, x in enumerate(found) if i not in won)
        assert Store(spark, root).read(f"x{round_}") == f"writer {won[0]}"
    assert not [n for n in Store(spark, root).names() if n.startswith(".")]


def test_no_update_is_lost(spark, root):
    found = at_once(*(lambda: [Store(spark, root).update("n", lambda t: str(int(t or 0) + 1)) for _ in range(3)] for _ in range(3)))
    assert not [x for x in found if isinstance(x, Exception)] and Store(spark, root).latest("n")[1] == "9"


def test_a_claim_that_stays_is_named(spark, root, monkeypatch):
    monkeypatch.setattr("quantloom.sources.store.TRIES", 2)
    s = Store(spark, root)
    s.create(".claim-doc-gone", "")
    with pytest.raises(Conflict, match="claim-doc-gone"):
        s.create("doc", "x")


def test_decisions(spark, root):
    r = SharedRecords(Store(spark, root))
    assert r.decision() is None
    r.freeze(ONE, "2024-01-31", 5)
    r.freeze(ONE, "2024-01-31", 6)
    assert r.decision().n_trials_spent == 6 and matches(r.decision(), ONE)
    with pytest.raises(FileExistsError, match="another strategy"):
        r.freeze(OTHER, "2024-01-31", 5)
    r.freeze(OTHER, "2024-02-29", 5, overwrite=True)
    assert matches(SharedRecords(Store(spark, root)).decision(), OTHER)
    with pytest.raises(ValueError):
        r.freeze(OTHER, "31.1.2024", 5)


def test_of_two_strategies_frozen_at_once_one_fails(spark, root):
    for i in range(4):
        found = at_once(*(lambda c=c: SharedRecords(Store(spark, root)).freeze(c, "2024-01-31", 5, name=f"d{i}") for c in (ONE, OTHER)))
        failed = [x for x in found if isinstance(x, FileExistsError)]
        assert len(failed) == 1
        made = next(x for x in found if x not in failed)
        assert SharedRecords(Store(spark, root)).decision(f"d{i}").config_hash == made.config_hash in (config_hash(ONE), config_hash(OTHER))


def test_states(spark, root):
    r = SharedRecords(Store(spark, root))
    assert r.last_state() is None and not r.has_run("2024-01-31")
    with pytest.raises(ValueError):
        r.save_state({"x": 1})
    r.save_state({"asof": "2024-02-29", "x": float("nan")})
    r.save_state({"asof": "2024-01-31", "d": date("2024-01-31")})
    assert r.last_state() == {"asof": "2024-02-29", "x": None} and r.state("2024-01-31")["d"] == "2024-01-31" and r.has_run("2024-01-31")
    r.save_state({"asof": "2024-02-29", "x": 2})
    assert r.last_state()["x"] == 2 and r.store.versions("states/2024-02-29") == [1, 2]
    version, _ = r.store.latest("latest")
    r.store.put("latest", "{broken", version)
    assert r.last_state()["x"] == 2


def test_cached_prices_by_path_and_uri(spark, root):
    calls = []

    def read(tickers, start, end):
        calls.append(tickers)
        return spark.createDataFrame([(date("2020-01-02"), t, 1.0 + len(calls)) for t in tickers if t != "NONE"], "dt date, asset string, px double")

    a, b = (CachedSource(spark, FunctionSource(spark, read), root) for _ in range(2))
    ask = ("2020-01-01", "2020-01-31")
    first = sorted(map(tuple, a.prices(["A", "B"], *ask).collect()))
    assert sorted(map(tuple, b.prices(["B", "A"], *ask).collect())) == first and len(calls) == 1
    for _ in range(2):
        assert a.prices(["NONE"], *ask).count() == 0
    assert len(calls) == 3
    # a table that is not what its document says counts as missing and is written anew
    path = f"{root}/prices-{cache_key(['A', 'B'], *ask)}"
    table = json.loads(Store(spark, path).latest("current")[1])["table"]
    spark.createDataFrame([(date("2020-01-03"), "A", 9.0)], "dt date, asset string, px double").write.mode("append").parquet(f"{path}/{table}")
    assert {r["px"] for r in a.prices(["A", "B"], *ask).collect()} == {5.0} and len(calls) == 4
    assert Store(spark, path).versions("current") == [1, 2]


def test_a_reader_while_a_table_is_written(spark, root):
    """A second writer that comes late and a reader in between see whole tables only."""
    inside, go = threading.Event(), threading.Event()

    class Slow(CachedSource):
        def _keep(self, path, found):
            inside.set()
            go.wait(60)
            return super()._keep(path, found)

    def source(px):
        return FunctionSource(spark, lambda t, *_: spark.createDataFrame([(date("2020-01-02"), x, px) for x in t], "dt date, asset string, px double"))

    ask = (["A"], "2020-01-01", "2020-01-31")
    slow, got = Slow(spark, source(1.0), root), []
    t = threading.Thread(target=lambda: got.extend(slow.prices(*ask).collect()))
    t.start()
    assert inside.wait(60)
    quick = CachedSource(spark, source(2.0), root)
    assert quick._read(f"{root}/prices-{cache_key(*ask)}") is None  # nothing half-written
    assert quick.prices(*ask).first()["px"] == 2.0
    go.set()
    t.join()
    assert got[0]["px"] in (1.0, 2.0) and CachedSource(spark, source(3.0), root).prices(*ask).first()["px"] in (1.0, 2.0)

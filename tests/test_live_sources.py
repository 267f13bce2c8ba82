import json

import pytest
from helpers import date
from pyspark.sql import functions as F

from quantloom.functions.scalar import impact_cost, linear_cost
from quantloom.plans import live
from quantloom.sources.config import ConfigError, Strategy, config_hash, from_mapping, load
from quantloom.sources.prices import CachedSource, FunctionSource, SyntheticSource, business_days, cache_key, date_window, long_prices, positions_from_json, select_source
from quantloom.sources.records import LocalBroker, freeze_decision, has_run, last_state, load_decision, matches, plain, save_state, send_alert, write_report
from quantloom.streaming.incremental import append_table, event_stream, once_per_period, panel_stream, run_available


def target(spark, **w):
    return spark.createDataFrame(list(w.items()) or [("", 0.0)], "symbol string, target_w double").where("symbol <> ''")


def held(spark, **q):
    return spark.createDataFrame([(k, float(v), float(v) * 10) for k, v in q.items()] or [("", 0.0, 0.0)], "symbol string, qty double, market_value double").where("symbol <> ''")


def at(spark, **p):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in p.items()], "symbol string, px double")


def plan(*a, **k):
    return {r["symbol"]: r for r in live.plan_orders(*a, **k).collect()}


def test_orders(spark):
    o = plan(target(spark, AAA=0.5, BBB=-0.25), held(spark), at(spark, AAA=100, BBB=50), 10_000)
    assert (o["AAA"]["side"], o["AAA"]["qty"], o["BBB"]["side"], o["BBB"]["qty"]) == ("buy", 50, "sell", 50)
    assert not plan(target(spark, AAA=0.01), held(spark), at(spark, AAA=100), 10_000, min_notional=200)
    o = plan(target(spark, AAA=0.0), held(spark, AAA=10), at(spark, AAA=100), 10_000)["AAA"]
    assert (o["side"], o["qty"], o["reason"], o["current_weight"]) == ("sell", 10, "close", 0.1)
    assert plan(target(spark), held(spark, AAA=5), at(spark, AAA=100), 10_000)["AAA"]["reason"] == "close"
    assert plan(target(spark, AAA=0.0333), held(spark), at(spark, AAA=100), 10_000)["AAA"]["qty"] == 3
    assert plan(target(spark, AAA=0.0333), held(spark), at(spark, AAA=100), 10_000, fractional=True)["AAA"]["qty"] == pytest.approx(3.33)
    assert not plan(target(spark, AAA=0.005, BBB=0.5), held(spark), at(spark, AAA=100, BBB=None), 10_000)
    with pytest.raises(Exception, match="gross"):
        plan(target(spark, AAA=3.0), held(spark), at(spark, AAA=100), 10_000, max_gross=2.0)


def test_plan_summary_and_left_out(spark):
    t = target(spark, AAA=0.5, BBB=-0.25, CCC=0.001)
    orders = live.plan_orders(t, held(spark), at(spark, AAA=100, BBB=50, CCC=70), 10_000)
    s = live.plan_summary(orders, t, 2.0).first()
    assert (s["n_orders"], s["buy_notional"], s["sell_notional"]) == (2, 5000, 2500) and s["est_cost"] == pytest.approx(1.5)
    assert [r["symbol"] for r in live.without_order(t, orders).collect()] == ["CCC"]


def test_reconcile(spark):
    flat = live.reconcile_summary(live.reconcile(target(spark, SPY=0.3, TLT=0.3, GLD=0.1), held(spark), at(spark, SPY=500), 10_000)).first()
    assert flat["l1"] == pytest.approx(0.7) and flat["flat"] and flat["anomaly"]
    ok = live.reconcile_summary(live.reconcile(target(spark, SPY=0.3, TLT=0.3), held(spark, SPY=63, TLT=300), at(spark, SPY=500, TLT=90), 100_000)).first()
    assert ok["l1"] == pytest.approx(0.045) and not ok["anomaly"]
    rogue = live.reconcile(target(spark, SPY=0.3), held(spark, SPY=6, XYZ=400), at(spark, SPY=500), 10_000)
    assert {r["symbol"]: r["current_weight"] for r in rogue.collect()}["XYZ"] == pytest.approx(0.4)


def test_gates():
    assert [live.data_gate("real", False, True), live.data_gate("real", True, True), live.data_gate("synthetic", False, False)] == ["ok", "refuse", "warn"]
    assert [live.drift_gate(None, "a", True), live.drift_gate("a", "a", True), live.drift_gate("b", "a", True), live.drift_gate("b", "a", False)] == ["ok", "ok", "refuse", "warn"]
    assert live.submits(None, "2024-01") and not live.submits("2024-01", "2024-01") and live.submits("2024-01", "2024-01", force=True)
    assert live.escalates(True, True, False, True) and not live.escalates(False, True, True, True)


def test_costs(spark):
    df = spark.createDataFrame([(0.5, 0.2, 100.0), (-0.5, 0.2, 0.0), (0.5, 0.2, None)], "d double, s double, adv double")
    got = df.select(linear_cost(F.col("d"), 10.0).alias("l"), impact_cost(F.col("d"), F.col("s"), F.col("adv"), 0.1).alias("i")).collect()
    assert [r["l"] for r in got] == pytest.approx([0.0005] * 3) and got[0]["i"] == pytest.approx(0.1 * 0.2 * (0.5 / 100) ** 0.5) and got[1]["i"] == got[2]["i"] == 0
    with pytest.raises(ValueError):
        impact_cost(F.col("d"), F.col("s"), F.col("adv"), -1)
    with pytest.raises(ValueError):
        linear_cost(F.col("d"), -1.0)


VALUES = {f: (list(v) if isinstance(v, tuple) else v) for f, v in Strategy(universe=("A", "B")).__dict__.items()}


def test_config(tmp_path):
    assert from_mapping(VALUES) == Strategy(universe=("A", "B"))
    for bad in ({"x": 1}, {"vol_window": True}, {"lookbacks": [1.5]}, {"direction": "up"}, {"universe": ["A", "A"]}, {"train_test_ratio": 1.0}, {"cost_bps_per_side": -1}):
        with pytest.raises(ConfigError):
            from_mapping(VALUES | bad)
    with pytest.raises(ConfigError, match="missing"):
        from_mapping({k: v for k, v in VALUES.items() if k != "vol_window"})
    (tmp_path / "c.json").write_text(json.dumps(VALUES))
    assert load(tmp_path / "c.json").universe == ("A", "B")
    with pytest.raises(ConfigError):
        load(tmp_path / "none.json")
    assert config_hash(from_mapping(VALUES)) != config_hash(from_mapping(VALUES | {"vol_window": 61}))


def test_synthetic_prices_do_not_depend_on_company(spark):
    src = SyntheticSource(spark, 42)
    one = src.prices(["A"], "2020-01-01", "2020-02-01").orderBy("dt").toPandas()
    two = src.prices(["B", "A"], "2020-01-01", "2020-02-01").where("asset = 'A'").orderBy("dt").toPandas()
    assert (one.px == two.px).all() and one.px.iloc[0] == 100.0 and len(one) == 23
    assert src.prices(["A"], "2020-01-04", "2020-01-05").count() == 0 and business_days(spark, "2020-02-01", "2020-01-01").count() == 0


def test_cache(spark, tmp_path):
    calls = []

    def read(tickers, start, end):
        calls.append(tickers)
        return [] if False else spark.createDataFrame([(date("2020-01-02"), t, 1.0) for t in tickers if t != "NONE"], "dt date, asset string, px double")

    src = CachedSource(spark, FunctionSource(spark, read), str(tmp_path))
    assert src.prices(["A", "B"], "2020-01-01", "2020-01-31").count() == 2
    assert src.prices(["B", "A"], "2020-01-01", "2020-01-31").count() == 2 and len(calls) == 1
    for _ in range(2):
        assert src.prices(["NONE"], "2020-01-01", "2020-01-31").count() == 0
    assert len(calls) == 3 and cache_key(["A", "B"], "x", "y") == cache_key(["B", "A"], "x", "y") != cache_key(["A"], "x", "y")
    (tmp_path / f"prices-{cache_key(['C'], 'a', 'b')}").write_text("broken")
    assert src._read(str(tmp_path / f"prices-{cache_key(['C'], 'a', 'b')}")) is None


def test_source_selection_falls_back(spark):
    cfg = Strategy(universe=("A",), lookbacks=(5,), vol_window=5)
    synthetic = SyntheticSource(spark)

    def fails(*_):
        raise OSError("no network")

    assert select_source(FunctionSource(spark, fails), synthetic, cfg, "2020-01-01", "2020-03-01")[1] == "synthetic"
    assert select_source(synthetic, synthetic, cfg, "2020-01-01", "2020-03-01")[1] == "real"
    assert date_window(4, "2024-02-29") == ("2020-02-29", "2024-02-29") and date_window(1, "2024-02-29")[0] == "2023-02-28"


def test_wide_payload(spark):
    w = spark.createDataFrame([("2020-01-01", 1.0, float("nan")), ("2020-01-05", 2.0, 3.0)], "dt string, A double, B double")
    assert sorted((str(r["dt"]), r["asset"], r["px"]) for r in long_prices(w, ["A", "B", "C"], "2020-01-02").fillna(-1).collect()) == [("2020-01-01", "A", 1.0), ("2020-01-01", "B", -1.0)]


def test_records(tmp_path):
    cfg, other = from_mapping(VALUES), from_mapping(VALUES | {"vol_window": 61})
    p = tmp_path / "d.json"
    freeze_decision(cfg, p, "2024-01-31", 5)
    assert matches(load_decision(p), cfg) and not matches(load_decision(p), other)
    with pytest.raises(FileExistsError):
        freeze_decision(other, p, "2024-01-31", 5)
    freeze_decision(other, p, "2024-01-31", 5, overwrite=True)
    with pytest.raises(ValueError):
        freeze_decision(cfg, tmp_path / "e.json", "31.1.2024", 5)
    assert last_state(tmp_path / "s") is None
    save_state(tmp_path / "s", {"asof": "2024-01-31", "x": float("nan")})
    save_state(tmp_path / "s", {"asof": "2024-02-01", "d": date("2024-02-01")})
    assert last_state(tmp_path / "s")["d"] == "2024-02-01" and has_run(tmp_path / "s", "2024-01-31") and not has_run(tmp_path / "s", "2024-03-01")
    (tmp_path / "s/latest.json").write_text("{")
    assert last_state(tmp_path / "s")["asof"] == "2024-02-01"
    assert plain({1: (tmp_path, float("inf"))}) == {"1": [str(tmp_path), None]}
    made = write_report({"equity": [1.0, None, 2.0]}, {"sharpe": 1.0, "pnl": {}}, tmp_path / "r", "a <b>")
    assert all(x.exists() for x in made.values()) and "&lt;b&gt;" in made["metrics_html"].read_text()


def test_alerts_never_raise_and_the_local_broker_accepts(spark):
    def boom(*_):
        raise OSError

    assert not send_alert("x", "http://localhost", post=boom) and send_alert("x", "http://localhost", post=lambda *_: None) and not send_alert("x")
    b = LocalBroker(1000.0)
    assert b.submit([{"symbol": "A"}])[0]["status"] == "accepted_simulated" and b.recent_orders(1) and b.is_open()
    assert positions_from_json(spark, '{"A": 2}').first()["qty"] == 2.0
    with pytest.raises(ValueError):
        positions_from_json(spark, "[1]")


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "A", 1.0), ("2024-01-01 00:50:00", "A", 3.0), ("2024-01-01 09:00:00", "A", 5.0), ("2024-02-01 09:00:00", "B", 7.0)]
    df = spark.createDataFrame(rows, "t string, asset string, v double").select(F.to_timestamp("t").alias("ts"), "asset", "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = event_stream(spark, f"{tmp_path}/in", df.schema)
    run_available(panel_stream(stream, "ts", "asset", "v"), f"{tmp_path}/c1", append_table(f"{tmp_path}/out"))
    first = spark.read.parquet(f"{tmp_path}/out").where("ts < '2024-01-01 01:00:00'").first()
    assert first["px"] == 2.0 and first["n"] == 2
    run_available(once_per_period(stream, "ts", "monthly"), f"{tmp_path}/c2", append_table(f"{tmp_path}/once"))
    assert spark.read.parquet(f"{tmp_path}/once").groupBy("period_key").count().where("count > 1").count() == 0
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2


def test_a_book_before_all_bars_is_an_error(spark):
    from quantloom.plans.live import target_book

    w = spark.sql("SELECT date '2020-01-02' AS dt, 'A' AS asset, 0.5D AS target_w")
    assert [tuple(r) for r in target_book(w, "2020-01-02").collect()] == [("A", 0.5)]
    for rows in (w, w.limit(0)):
        with pytest.raises(Exception, match="no bar at or before"):
            target_book(rows, "2020-01-01").collect()


def test_configurations_name_a_universe_and_a_seed(tmp_path):
    from dataclasses import asdict

    good = {**asdict(Strategy(universe=("A",))), "universe": ["A"]}
    assert from_mapping(good).universe == ("A",)
    for bad in ({"universe": []}, {"universe": ["A", " "]}, {"seed": -1}):
        with pytest.raises(ConfigError):
            from_mapping({**good, **bad})
    (tmp_path / "a.json").write_text("{")
    with pytest.raises(ConfigError):
        load(tmp_path / "a.json")

"""Live runs as one plan: from prices as of each run's date to orders, reconciliation, gates and alerts, all of them relations.

A run is a row: asof (a date, each once), equity, live (else a dry run), force, source (real or synthetic) and config_hash. Runs of many dates are planned together;
what an earlier run submitted is known to later ones by a window over the runs of its period, not by a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import period_key
from quantloom.operators.asof import asof_join, every_days
from quantloom.plans.live import TOLERANCE, books_as_of, plan_orders, prices_as_of, reconcile, reconcile_summary
from quantloom.sources.config import Strategy
from quantloom.sources.scratch import kept

RUN = "asof date, equity double, live boolean, force boolean, source string, config_hash string"
SUBMITTED = "asof date, symbol string, target_w double"
#: An alert's exit codes: a refused run is an error, a book off its submitted targets has a code of its own.
REFUSED, ESCALATED = 1, 2


@dataclass(frozen=True)
class LiveRuns:
    """runs: a row for each run with its period, what it does (action) and its exit_code. The other tables have asof as the key of their run."""

    runs: DataFrame
    targets: DataFrame
    orders: DataFrame
    book: DataFrame
    gates: DataFrame
    alerts: DataFrame


@dataclass(frozen=True)
class Limits:
    max_stale_days: int = 7
    allow_synthetic: bool = False
    tolerance: float = TOLERANCE
    min_notional: float = 0.0
    fractional: bool = False


def data_gate_rows(runs: DataFrame, bars: DataFrame, limits: Limits) -> DataFrame:
    """(asof, gate, severity, reason) of each run's data: a synthetic source, no bar, or a stale one. Severity is ok, warn (dry run) or refuse (live)."""
    rows = runs.join(bars, "asof", "left").withColumn("age", F.datediff("asof", "bar_dt"))
    synthetic = F.when((F.col("source") != "real") & ~F.lit(limits.allow_synthetic), F.concat(F.lit("the source is "), F.coalesce("source", F.lit("unknown"))))
    stale = F.when(F.col("bar_dt").isNull(), F.lit("there is no bar")).when(F.col("age") > limits.max_stale_days, F.concat(F.lit("the last bar is "), F.col("age").cast("string"), F.lit(" days old")))
    return _gate(rows, "data", F.concat_ws("; ", synthetic, stale))


def drift_gate_rows(runs: DataFrame, recorded_hash: str | None) -> DataFrame:
    """The same for a configuration that isn't the recorded decision's; without a decision there is no gate to fail."""
    drifted = F.lit(recorded_hash).isNotNull() & ~F.col("config_hash").eqNullSafe(F.lit(recorded_hash))
    return _gate(runs, "drift", F.when(drifted, F.lit("the configuration is not the recorded one")).otherwise(""))


def _gate(rows: DataFrame, gate: str, reason) -> DataFrame:
    severity = F.when(reason == "", "ok").when(F.col("live"), "refuse").otherwise("warn")
    return rows.select("asof", F.lit(gate).alias("gate"), severity.alias("severity"), reason.alias("reason"))


def submitting_runs(runs: DataFrame, refused: DataFrame, earlier: DataFrame, cadence: str) -> DataFrame:
    """runs with period, refused, done (the period was submitted before) and submits.

    A live run that isn't refused submits unless its period was submitted: by an ``earlier`` one (submitted targets), or by any run before it in the period
    that could submit, since the first of these does. ``force`` submits again.
    """
    rows = runs.join(refused.select("asof", F.lit(True).alias("refused")).distinct(), "asof", "left").withColumns({"refused": F.coalesce("refused", F.lit(False)), "period": period_key(F.col("asof"), cadence)})
    known = earlier.select(period_key(F.col("asof"), cadence).alias("period")).distinct().withColumn("known", F.lit(True))
    could = F.coalesce("live", F.lit(False)) & ~F.col("refused")
    before = Window.partitionBy("period").orderBy("asof").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(known, "period", "left").withColumn("could", could)
    rows = rows.withColumn("done", F.coalesce("known", F.lit(False)) | F.coalesce(F.max("could").over(before), F.lit(False)))
    return rows.withColumn("submits", F.col("could") & (~F.col("done") | F.coalesce("force", F.lit(False)))).drop("known")


def references(runs: DataFrame, targets: DataFrame, earlier: DataFrame) -> DataFrame:
    """(asof, symbol, target_w, reference): what each run's held book is compared with.

    A run that skips its period is compared with the targets that were submitted last before it, any other one with its own: signals drift between
    two submissions, the held book shouldn't.
    """
    sent = earlier.select("asof").distinct().unionByName(runs.where("submits").select("asof")).select(F.col("asof").alias("sent")).distinct()
    skips = runs.where("could AND NOT submits").select("asof")
    at = asof_join(skips, sent, "asof", "sent", how="inner", exact=False, bucket=every_days(36_500))
    known = earlier.select("asof", "symbol", "target_w").unionByName(targets.join(runs.where("submits").select("asof"), "asof", "left_semi").select("asof", "symbol", "target_w")).withColumnRenamed("asof", "sent")
    carried = at.join(known, "sent").select("asof", "symbol", "target_w", F.lit("submitted").alias("reference"))
    own = targets.join(at.select("asof"), "asof", "left_anti").select("asof", "symbol", "target_w", F.lit("today").alias("reference"))
    return carried.unionByName(own)


def live_runs(weighted: DataFrame, runs: DataFrame, positions: DataFrame, earlier: DataFrame, cfg: Strategy, recorded_hash: str | None = None, limits: Limits = Limits()) -> LiveRuns:
    """Plan runs over a weighted panel (dt, bar, asset, px, target_w).

    positions: (asof, symbol, qty, market_value) as each run finds them. earlier: (asof, symbol, target_w) submitted before all runs. Each run's action is submit, skip, refuse or
    preview (a dry run). Its exit code is 1 if it was refused, 2 if it skipped and its book is off the submitted targets (or flat where it should be
    invested), else 0; both of the former are alerts.
    """
    # each step's rows are few and are used several times: they are written once
    weighted, runs = kept(weighted.select("dt", "bar", "asset", "px", "target_w"), "live-panel"), kept(runs, "live-runs")
    positions, earlier = kept(positions, "live-positions"), kept(earlier, "live-earlier")
    quotes = kept(prices_as_of(weighted.select("dt", "asset", "px"), runs), "live-quotes")
    bars = quotes.select("asof", "bar_dt").distinct()
    reached = runs.join(bars.where("bar_dt IS NOT NULL").select("asof"), "asof", "left_semi")
    targets = kept(books_as_of(weighted, reached).select("asof", "symbol", "target_w"), "live-targets")
    gates = data_gate_rows(runs, bars, limits).unionByName(drift_gate_rows(runs, recorded_hash))
    judged = kept(submitting_runs(runs, gates.where("severity = 'refuse'"), earlier, cfg.rebalance), "live-judged")
    px = quotes.select("asof", F.col("asset").alias("symbol"), "px")
    planned = plan_orders(targets, positions, px, runs, limits.min_notional, limits.fractional, cfg.max_gross_leverage, ["asof"])
    ref = kept(references(judged, targets, earlier), "live-references")
    book = kept(reconcile(ref.drop("reference"), positions, px, runs, ["asof"]), "live-book")
    summary = reconcile_summary(book, limits.tolerance, ["asof"])
    state = judged.join(summary, "asof", "left").join(ref.select("asof", "reference").distinct(), "asof", "left")
    skipped = F.col("could") & ~F.col("submits")
    escalated = skipped & F.coalesce("anomaly", F.lit(False)) & ((F.col("reference") == "submitted") | F.coalesce("flat", F.lit(False)))
    action = F.when(F.col("submits"), "submit").when(F.col("refused") & F.col("live"), "refuse").when(skipped, "skip").otherwise("preview")
    state = state.withColumns({"action": action, "escalated": F.coalesce(escalated, F.lit(False))})
    state = state.withColumn("exit_code", F.when(F.col("action") == "refuse", REFUSED).when(F.col("escalated"), ESCALATED).otherwise(0))
    state = kept(state, "live-state")
    cadence = state.select("asof", F.lit("cadence").alias("gate"), F.when(F.col("action") == "skip", "skip").otherwise("ok").alias("severity"), F.when(F.col("action") == "skip", F.concat(F.lit("already submitted for "), F.col("period"))).otherwise("").alias("reason"))
    off = F.concat(F.lit("the book is off by "), F.format_number("l1", 3), F.lit(" (gross "), F.format_number("current_gross", 3), F.lit(" against "), F.format_number("target_gross", 3), F.lit(")"))
    held = state.select("asof", F.lit("reconcile").alias("gate"), F.when(F.col("escalated"), "escalate").when(F.col("anomaly"), "warn").otherwise("ok").alias("severity"), F.when(F.col("anomaly"), off).otherwise("").alias("reason"))
    gates = gates.unionByName(cadence).unionByName(held)
    why = gates.where("severity IN ('refuse', 'escalate')").groupBy("asof").agg(F.array_join(F.array_sort(F.collect_list(F.concat("gate", F.lit(": "), "reason"))), "; ").alias("text"))
    alerts = state.where("exit_code > 0").select("asof", "action", "exit_code").join(why, "asof")
    shown = state.select("asof", "period", "action", "reference", "l1", "current_gross", "target_gross", F.coalesce("anomaly", F.lit(False)).alias("anomaly"), "exit_code")
    return LiveRuns(shown, targets, planned, book, gates, alerts)


def submitted_by(planned: LiveRuns) -> DataFrame:
    """(asof, symbol, target_w) that the runs submit: what later runs take as ``earlier``."""
    return planned.targets.join(planned.runs.where("action = 'submit'").select("asof"), "asof", "left_semi")

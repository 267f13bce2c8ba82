"""Reports of a run, and the tables that runs carry on: submitted targets and recorded trials."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalar import period_key
from quantloom.operators.backtest import Backtest
from quantloom.operators.metrics import attribution, drawdowns, performance
from quantloom.operators.panel import exposures
from quantloom.operators.stats import distinct_trials
from quantloom.sources.records import bar_chart_svg, line_chart_svg, plain, write_metrics_csv, write_metrics_html


def run_series(run: Backtest, by: Sequence[str] = ()) -> DataFrame:
    """(by..., dt, bar, equity, drawdown_pct, gross, net): what a report draws of each bar."""
    curve = drawdowns(run.bars, by).select(*by, "dt", "bar", "equity", (F.col("drawdown") * 100).alias("drawdown_pct"))
    return curve.join(exposures(run.held, "w", by), [*by, "dt", "bar"])


def write_run_report(run: Backtest, periods_per_year: float, folder: str | Path, title: str) -> dict[str, Path]:
    """One run's metrics as CSV and HTML, its equity, drawdown and exposures as lines and its assets' contributions as bars.

    What reaches the driver is a row for each bar and one for each asset.
    """
    folder = Path(folder)
    metrics = plain(performance(run.bars, periods_per_year).first().asDict())
    series = run_series(run).orderBy("bar").toPandas()
    shares = attribution(run.bars, run.held).orderBy("asset").toPandas()
    out = {"metrics_csv": write_metrics_csv(metrics, folder / "metrics.csv"), "metrics_html": write_metrics_html(metrics, folder / "metrics.html", title)}
    for name in ("equity", "drawdown_pct", "gross", "net"):
        out[name] = line_chart_svg(series[name].tolist(), folder / f"{name}.svg", f"{title}: {name}")
    return out | {"contributions": bar_chart_svg(dict(zip(shares["asset"], shares["pnl"], strict=True)), folder / "contributions.svg", f"{title}: contributions")}


def submit_targets(target: DataFrame, asof: str, cadence: str, path: str) -> None:
    """Keep the targets (symbol, target_w) of asof's period in a table; the same period's earlier ones are replaced, others stay."""
    day = F.lit(asof).cast("date")
    rows = target.select("symbol", "target_w", day.alias("asof"), period_key(day, cadence).alias("period_key"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_key").parquet(path)


def last_submitted(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, target_w, asof, period_key) of the period that was submitted last."""
    kept = spark.read.schema("symbol string, target_w double, asof date, period_key string").parquet(path)
    return kept.join(F.broadcast(kept.agg(F.max("asof").alias("asof"))), "asof", "left_semi").select("symbol", "target_w", "asof", "period_key")


def record_trials(trials: DataFrame, path: str) -> None:
    """Add tried configurations to the table of trials; repeats are kept and counted once."""
    trials.write.mode("append").parquet(path)


def recorded_trials(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_trials and n_raw of the table of trials."""
    return distinct_trials(spark.read.parquet(path))

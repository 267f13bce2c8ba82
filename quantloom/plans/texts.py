"""Reports as text, from rows of the plans' tables: an unknown number is n/a, a table has its columns under each other."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from quantloom.plans.live import order_preview

WIDTH = 64


def number(x, digits: int = 4) -> str:
    """A number to so many digits; infinity as inf; n/a for null and NaN. Flags are yes or no, other values as they are."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "n/a"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, float):
        return ("inf" if x > 0 else "-inf") if math.isinf(x) else f"{x:,.{digits}f}"
    return f"{x:,}" if isinstance(x, int) else str(x)


def facts(pairs: Sequence[tuple[str, object]]) -> list[str]:
    """Names and values in two columns."""
    wide = max((len(k) for k, _ in pairs), default=0)
    return [f"{k:<{wide}}  {number(v)}" for k, v in pairs]


def table(rows: Sequence[Mapping], columns: Mapping[str, str], none: str = "none") -> list[str]:
    """Rows under their headings; texts to the left, numbers to the right."""
    if not rows:
        return [none]
    cells = [[number(r[c]) for c in columns] for r in rows]
    left = [all(r[c] is None or isinstance(r[c], str) for r in rows) for c in columns]
    wide = [max(len(h), *(len(x[i]) for x in cells)) for i, h in enumerate(columns.values())]
    line = lambda x: "  ".join(f"{v:<{w}}" if on_left else f"{v:>{w}}" for v, w, on_left in zip(x, wide, left, strict=True)).rstrip()
    return [line(list(columns.values())), *map(line, cells)]


def page(title: str, *parts: Sequence[str]) -> str:
    rule = "-" * WIDTH
    return "\n".join([title, "=" * WIDTH, *[x for i, p in enumerate(parts) for x in ([rule] if i else []) + list(p)]]) + "\n"


def verdict(keep: bool) -> str:
    return "retain" if keep else "reject"


def _stability(row: Mapping, windows: Sequence[Mapping]) -> list[str]:
    if not row["n_windows"]:
        return ["no window of the walk-forward fits: stability is unknown"]
    return [
        *table(windows, {"fold": "window", "sharpe": "Sharpe", "total_return": "return"}),
        *facts([("windows", row["n_windows"]), ("mean Sharpe", row["mean_sharpe"]), ("std of Sharpe", row["std_sharpe"]), ("share above 0", row["positive_fraction"]), ("dispersion", row["dispersion"]), ("stable", row["is_stable"])]),
    ]


_FIGURES = (("Sharpe", "sharpe"), ("CAGR", "cagr"), ("maximum drawdown", "max_drawdown"))


def final_text(row: Mapping, windows: Sequence[Mapping], n_trials: int, threshold: float) -> str:
    """The verdict on the locked test, from a row of ``final_verdict`` and those of ``window_metrics``."""
    return page(
        "Locked test",
        facts([("from", str(row["start"])), ("to", str(row["end"])), ("bars", row["n_periods"]), ("trials", n_trials)]),
        facts([*((k, row[c]) for k, c in _FIGURES), ("deflated Sharpe", row["dsr"]), ("needed", threshold)]),
        _stability(row, windows),
        [f"verdict: {verdict(row['retain'])}", "A verdict is advice: people decide, and the locked test is read once."],
    )


def holdout_text(row: Mapping, windows: Sequence[Mapping], n_trials: int, min_bars: int, threshold: float) -> str:
    """The verdict on a hold-out with one and with all trials, from a row of ``holdout_verdict``; short ones say what is missing."""
    size = facts([("bars", row["n_bars"]), ("needed", min_bars), ("sufficient", row["sufficient"])])
    if not row["sufficient"]:
        return page("Hold-out", size, [f"{max(0, min_bars - row['n_bars'])} more bars are needed before it is judged"])
    both = sorted({1, n_trials})
    short = ["fewer than two windows: the verdict rests on the deflated Sharpe ratio alone"] if row["n_windows"] < 2 else []
    return page(
        "Hold-out",
        size,
        facts([*((k, row[c]) for k, c in _FIGURES), *((f"deflated Sharpe, trials: {n}", row[f"dsr_{n}"]) for n in both), ("threshold", threshold)]),
        [*_stability(row, windows), *short],
        [f"verdict, trials: {n}: {verdict(row[f'retain_{n}'])}" for n in both],
    )


def reconcile_text(summary: Mapping, book: Sequence[Mapping], tolerance: float) -> str:
    """A held book against its reference, from a row of ``reconcile_summary`` and the rows of ``reconcile``."""
    why = ["the book is flat, though it should be invested"] if summary["flat"] else ["the book is further off than the tolerance"] if summary["off_target"] else []
    rows = sorted(book, key=lambda r: (-abs(r["deviation"]), r["symbol"]))
    return page(
        "Reconciliation: " + ("anomaly" if summary["anomaly"] else "in order"),
        [*facts([("distance", summary["l1"]), ("tolerance", tolerance), ("largest", summary["max_deviation"]), ("gross held", summary["current_gross"]), ("gross wanted", summary["target_gross"])]), *why],
        table(rows, {"symbol": "symbol", "target_weight": "wanted", "current_weight": "held", "deviation": "off by"}, "nothing is held or wanted"),
    )


def cost_text(rows: Sequence[Mapping]) -> str:
    """Cost levels in order, from the rows of ``cost_stress``; the base level is starred."""
    shown = [{**r, "level": f"{r['bps']:g}" + ("*" if r["is_base"] else "")} for r in sorted(rows, key=lambda r: r["bps"])]
    head = {"level": "bps a side", "cagr": "CAGR", "annual_vol": "volatility", "sharpe": "Sharpe", "max_drawdown": "drawdown", "total_cost": "cost", "final_equity": "equity"}
    return page("Costs", table(shown, head), ["* the base level"])


def run_text(metrics: Mapping, shares: Sequence[Mapping], title: str) -> str:
    """One backtest, from a row of ``performance`` and those of ``attribution``."""
    names = [k for k, v in metrics.items() if not isinstance(v, (Mapping, list, tuple, set))]
    rows = sorted(shares, key=lambda r: (-(r["pnl"] or 0.0), r["asset"]))
    return page(title, facts([(k, metrics[k]) for k in names]), table(rows, {"asset": "asset", "pnl": "contribution"}))


def preview_text(run: Mapping, orders: Sequence[Mapping], summary: Mapping) -> str:
    """What a run orders, or would: from a row of ``live_runs``, its orders and a row of ``plan_summary``."""
    said = {"submit": "orders are sent", "preview": "a dry run: nothing is sent", "skip": "nothing is sent: the period has its submission", "refuse": "nothing is sent: a gate refused the run"}
    return page(
        f"Orders as of {run['asof']}",
        [said[run["action"]]],
        order_preview(sorted(orders, key=lambda o: o["symbol"])).split("\n"),
        facts([("orders", summary["n_orders"]), ("bought", summary["buy_notional"]), ("sold", summary["sell_notional"]), ("cost, about", summary["est_cost"]), ("gross wanted", summary["target_gross"])]),
    )


def status_text(account: Mapping, positions: Sequence[Mapping]) -> str:
    """A broker's account and positions."""
    rows = sorted(positions, key=lambda p: p["symbol"])
    return page("Account", facts([(k.replace("_", " "), account[k]) for k in ("equity", "cash", "buying_power")]), table(rows, {"symbol": "symbol", "qty": "quantity", "market_value": "value"}, "no open position"))

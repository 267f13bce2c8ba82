"""Small documents beside the tables: decision records, run states, reports, alerts and the local broker."""

from __future__ import annotations

import csv
import html
import json
import math
import os
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import date, datetime, timezone
from pathlib import Path
from typing import Protocol, runtime_checkable

from quantloom.sources.config import Strategy, config_hash, fingerprint
from quantloom.sources.store import Store, as_json


def plain(x):
    """Anything as JSON values: numpy scalars, dates, paths and dataclasses become numbers and texts; NaN becomes null."""
    if is_dataclass(x) and not isinstance(x, type):
        return plain(asdict(x))
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if hasattr(x, "item") and not isinstance(x, (str, bytes)):
        x = x.item()
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


def _write(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    temporary.write_text(text)
    os.replace(temporary, path)
    return path


@dataclass(frozen=True)
class Decision:
    """A frozen strategy: what was decided, when, and how many trials went before."""

    config_fingerprint: dict
    config_hash: str
    decision_date: str
    n_trials_spent: int
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    notes: str = ""

    def __post_init__(self) -> None:
        date.fromisoformat(self.decision_date)
        if isinstance(self.n_trials_spent, bool) or self.n_trials_spent < 1:
            raise ValueError(f"n_trials_spent must be at least 1: {self.n_trials_spent}")


def decision_from(text: str, path) -> Decision:
    got = json.loads(text)
    if not isinstance(got, dict) or (missing := {"config_fingerprint", "config_hash", "decision_date", "n_trials_spent"} - {*got}):
        raise ValueError(f"no decision record: {path}" + (f" lacks {sorted(missing)}" if isinstance(got, dict) else ""))
    return Decision(**{k: got[k] for k in Decision.__dataclass_fields__ if k in got})


def load_decision(path: str | Path) -> Decision:
    return decision_from(Path(path).read_text(), path)


def freeze_decision(cfg: Strategy, path: str | Path, decision_date: str, n_trials: int, notes: str = "", overwrite: bool = False) -> Decision:
    """Write a decision; one of another strategy is only replaced with ``overwrite``."""
    path = Path(path)
    if path.exists() and not overwrite and load_decision(path).config_hash != config_hash(cfg):
        raise FileExistsError(f"{path} holds another strategy")
    made = Decision(fingerprint(cfg), config_hash(cfg), decision_date, n_trials, notes=notes)
    _write(path, json.dumps(plain(made), indent=2, sort_keys=True) + "\n")
    return made


def matches(decision: Decision, cfg: Strategy) -> bool:
    return decision.config_hash == config_hash(cfg)


def save_state(folder: str | Path, state: Mapping) -> Path:
    """Write a run's state under its date and as the latest."""
    if not state.get("asof"):
        raise ValueError("a state needs asof")
    text = json.dumps(plain(state), indent=2, sort_keys=True) + "\n"
    _write(Path(folder) / "latest.json", text)
    return _write(Path(folder) / f"live_state_{state['asof']}.json", text)


def last_state(folder: str | Path) -> dict | None:
    """The latest state, else the last by name that can be read, else None."""
    folder = Path(folder)
    for p in [folder / "latest.json", *sorted(folder.glob("live_state_*.json"), reverse=True)]:
        try:
            got = json.loads(p.read_text())
        except (OSError, ValueError):
            continue
        if isinstance(got, dict):
            return got
    return None


def has_run(folder: str | Path, asof: str) -> bool:
    return (Path(folder) / f"live_state_{asof}.json").exists()


class SharedRecords:
    """Decisions and run states in a store that all drivers share. Every change is a version of its own; of two writers at once one fails."""

    def __init__(self, store: Store):
        self.store = store

    def decision(self, name: str = "decision") -> Decision | None:
        """The decision in force, or None."""
        _, text = self.store.latest(name)
        return decision_from(text, self.store.uri(name)) if text is not None else None

    def freeze(self, cfg: Strategy, decision_date: str, n_trials: int, notes: str = "", overwrite: bool = False, name: str = "decision") -> Decision:
        """Write a decision; one of another strategy is only replaced with ``overwrite``. ``Conflict`` (a FileExistsError) if another writer was first."""
        version, text = self.store.latest(name)
        if text is not None and not overwrite and decision_from(text, self.store.uri(name)).config_hash != config_hash(cfg):
            raise FileExistsError(f"{self.store.uri(name)} holds another strategy")
        made = Decision(fingerprint(cfg), config_hash(cfg), decision_date, n_trials, notes=notes)
        self.store.put(name, as_json(plain(made)), version)
        return made

    def save_state(self, state: Mapping) -> None:
        """A run's state as the last version of its date's record, and of the latest. A later date than ``state``'s stays the latest."""
        if not state.get("asof"):
            raise ValueError("a state needs asof")
        mine = plain(state)
        self.store.update(f"states/{mine['asof']}", lambda _: as_json(mine))

        def later(text: str | None) -> str:
            known = _object(text)
            return text if known and str(known.get("asof", "")) > str(mine["asof"]) else as_json(mine)

        self.store.update("latest", later)

    def last_state(self) -> dict | None:
        """The latest state, else that of the last date that can be read, else None."""
        if (found := _object(self.store.latest("latest")[1])) is not None:
            return found
        return next((x for d in reversed(self.store.names("states")) if (x := self.state(d)) is not None), None)

    def state(self, asof: str) -> dict | None:
        return _object(self.store.latest(f"states/{asof}")[1])

    def has_run(self, asof: str) -> bool:
        return bool(self.store.versions(f"states/{asof}"))


def _object(text: str | None) -> dict | None:
    try:
        got = json.loads(text) if text else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def scalars(metrics: Mapping) -> dict:
    """Metrics without nested values."""
    return {k: v for k, v in metrics.items() if not isinstance(v, (Mapping, list, tuple, set))}


def write_metrics_csv(metrics: Mapping, path: str | Path) -> Path:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["metric", "value"])
        w.writerows(scalars(metrics).items())
    return path


def write_metrics_html(metrics: Mapping, path: str | Path, title: str) -> Path:
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in scalars(metrics).items())
    return _write(Path(path), f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{rows}</table>\n")


def line_chart_svg(points: Sequence[float], path: str | Path, title: str, width: int = 800, height: int = 300) -> Path:
    """One series as an SVG line; gaps are left out."""
    known = [(i, v) for i, v in enumerate(points) if v is not None and math.isfinite(v)]
    lo, hi = (min(v for _, v in known), max(v for _, v in known)) if known else (0.0, 1.0)
    span, steps = (hi - lo) or 1.0, max(1, len(points) - 1)
    line = " ".join(f"{i / steps * width:.1f},{height - (v - lo) / span * height:.1f}" for i, v in known)
    return _write(Path(path), f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height + 20}"><text x="4" y="{height + 15}">{html.escape(title)} {lo:.4g} to {hi:.4g}</text><polyline fill="none" stroke="black" points="{line}"/></svg>\n')


def bar_chart_svg(values: Mapping[str, float], path: str | Path, title: str, width: int = 800, height: int = 300) -> Path:
    """One bar for each name, from the zero line up or down; unknown values have none."""
    known = {k: v if v is not None and math.isfinite(v) else 0.0 for k, v in values.items()}
    hi, lo = max([0.0, *known.values()]), min([0.0, *known.values()])
    unit, step = height / ((hi - lo) or 1.0), width / max(1, len(known))
    bars = "".join(
        f'<rect x="{i * step:.1f}" y="{(hi - max(v, 0)) * unit:.1f}" width="{step * 0.8:.1f}" height="{abs(v) * unit:.1f}"><title>{html.escape(str(k))} {v:.4g}</title></rect>'
        f'<text x="{i * step:.1f}" y="{height + 12}">{html.escape(str(k))}</text>'
        for i, (k, v) in enumerate(known.items())
    )
    return _write(Path(path), f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height + 40}"><text x="4" y="{height + 35}">{html.escape(title)}</text>{bars}</svg>\n')


def write_report(series: Mapping[str, Sequence[float]], metrics: Mapping, folder: str | Path, title: str) -> dict[str, Path]:
    """Metrics as CSV and HTML, and one chart per series; what was written, by name."""
    folder = Path(folder)
    out = {"metrics_csv": write_metrics_csv(metrics, folder / "metrics.csv"), "metrics_html": write_metrics_html(metrics, folder / "metrics.html", title)}
    return out | {name: line_chart_svg(points, folder / f"{name}.svg", f"{title}: {name}") for name, points in series.items()}


def text_table(row: Mapping, title: str) -> str:
    width = max([len(str(k)) for k in row], default=0)
    show = lambda v: f"{v:,.4f}" if isinstance(v, float) else str(v)
    return "\n".join([title, "-" * len(title), *(f"{k:<{width}}  {show(v)}" for k, v in row.items())])


def send_alert(text: str, url: str | None = None, post: Callable | None = None) -> bool:
    """Post a text to a webhook; never raises. False without an address or where it fails."""
    url = url or first_set("ALERT_WEBHOOK_URL")
    if not url:
        return False
    body = json.dumps({"text": text, "content": text}).encode()
    try:
        if post is not None:
            post(url, body)
        else:
            request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
            urllib.request.urlopen(request, timeout=10).close()
    except Exception:  # an alert must never end a run
        return False
    return True


def first_set(*names: str) -> str | None:
    """The first environment variable that isn't empty."""
    return next((v for n in names if (v := os.environ.get(n))), None)


@runtime_checkable
class Broker(Protocol):
    """What planning asks of a broker."""

    def account(self) -> dict: ...
    def positions(self) -> list[dict]: ...
    def submit(self, orders: Sequence[Mapping]) -> list[dict]: ...
    def is_open(self) -> bool: ...
    def recent_orders(self, limit: int = 20) -> list[dict]: ...


class LocalBroker:
    """A broker in memory that accepts every order and trades none."""

    def __init__(self, equity: float, positions: Sequence[Mapping] = ()):
        self._equity, self._positions, self._orders = float(equity), [dict(p) for p in positions], []

    def account(self) -> dict:
        return {"equity": self._equity, "cash": self._equity, "buying_power": self._equity}

    def positions(self) -> list[dict]:
        return [dict(p) for p in self._positions]

    def submit(self, orders: Sequence[Mapping]) -> list[dict]:
        done = [dict(o) | {"status": "accepted_simulated"} for o in orders]
        self._orders += done
        return done

    def is_open(self) -> bool:
        return True

    def recent_orders(self, limit: int = 20) -> list[dict]:
        return self._orders[-limit:]

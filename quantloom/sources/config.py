"""Strategy configuration: strict reading of a flat mapping, and the fingerprint that pre-registration freezes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that can't be used."""


DIRECTIONS = ("long_short", "long_only")
CADENCES = ("daily", "weekly", "monthly")


@dataclass(frozen=True)
class Strategy:
    """All parameters of a strategy and of its validation."""

    initial_capital: float = 2000.0
    universe: tuple[str, ...] = ()
    direction: str = "long_only"
    rebalance: str = "monthly"
    lookbacks: tuple[int, ...] = (21, 63, 126, 252)
    vol_window: int = 60
    asset_vol_target: float = 0.10
    portfolio_vol_target: float = 0.10
    max_gross_leverage: float = 2.0
    kelly_fraction: float = 1.0
    cost_bps_per_side: float = 2.0
    cost_stress_levels: tuple[float, ...] = (5.0, 10.0)
    periods_per_year: int = 252
    train_test_ratio: float = 0.70
    wf_train_years: float = 5
    wf_test_years: float = 1
    wf_step_years: float = 1
    cv_embargo: float = 0.01
    seed: int = field(default=42)

    def __post_init__(self) -> None:
        positive = ("initial_capital", "vol_window", "asset_vol_target", "portfolio_vol_target", "max_gross_leverage", "kelly_fraction", "periods_per_year", "wf_train_years", "wf_test_years", "wf_step_years")
        for name in positive:
            if not getattr(self, name) > 0:
                raise ConfigError(f"{name} must be positive: {getattr(self, name)}")
        if self.direction not in DIRECTIONS:
            raise ConfigError(f"direction must be one of {DIRECTIONS}: {self.direction!r}")
        if self.rebalance not in CADENCES:
            raise ConfigError(f"rebalance must be one of {CADENCES}: {self.rebalance!r}")
        if not self.lookbacks or min(self.lookbacks) < 1:
            raise ConfigError(f"lookbacks must be positive: {self.lookbacks}")
        if len(set(self.universe)) != len(self.universe):
            raise ConfigError("universe repeats a ticker")
        if self.cost_bps_per_side < 0 or any(x < 0 for x in self.cost_stress_levels):
            raise ConfigError("costs must not be negative")
        if self.seed < 0:
            raise ConfigError(f"seed must not be negative: {self.seed}")
        if not 0 < self.train_test_ratio < 1:
            raise ConfigError(f"train_test_ratio must be between 0 and 1: {self.train_test_ratio}")
        if not 0 <= self.cv_embargo < 1:
            raise ConfigError(f"cv_embargo must be from 0 to below 1: {self.cv_embargo}")


def _integer(name: str, x) -> int:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x):
        raise ConfigError(f"{name} must be a whole number: {x!r}")
    return int(x)


def _number(name: str, x) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise ConfigError(f"{name} must be a number: {x!r}")
    return float(x)


def _text(name: str, x) -> str:
    if not isinstance(x, str) or not x.strip():
        raise ConfigError(f"{name} must be a text: {x!r}")
    return x


def _each(of):
    def read(name: str, x) -> tuple:
        if not isinstance(x, (list, tuple)):
            raise ConfigError(f"{name} must be a list: {x!r}")
        return tuple(of(name, y) for y in x)

    return read


_READERS = {
    "universe": _each(_text), "direction": _text, "rebalance": _text, "lookbacks": _each(_integer), "vol_window": _integer,
    "cost_stress_levels": _each(_number), "periods_per_year": _integer, "seed": _integer,
}


def from_mapping(values: Mapping) -> Strategy:
    """A strategy from a mapping: all keys but seed must be there, no others may, and types must fit."""
    if not isinstance(values, Mapping) or not values:
        raise ConfigError("a configuration must be a mapping that isn't empty")
    names = {f.name for f in fields(Strategy)}
    if unknown := sorted({*values} - names):
        raise ConfigError(f"unknown keys: {unknown}")
    if missing := sorted(names - {*values} - {"seed"}):
        raise ConfigError(f"missing keys: {missing}")
    if not values["universe"]:
        raise ConfigError("universe must not be empty")
    return Strategy(**{k: _READERS.get(k, _number)(k, v) for k, v in values.items()})


def load(path: str | Path) -> Strategy:
    """A strategy from a YAML or JSON file."""
    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no such file: {path}")
    text = path.read_text()
    if path.suffix == ".json":
        try:
            return from_mapping(json.loads(text))
        except json.JSONDecodeError as e:
            raise ConfigError(f"{path} is no JSON: {e}") from e
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML takes the yaml package; JSON works without") from e
    try:
        return from_mapping(yaml.safe_load(text))
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is no YAML: {e}") from e


#: What makes two runs the same strategy.
FINGERPRINT = ("universe", "direction", "rebalance", "lookbacks", "vol_window", "asset_vol_target", "portfolio_vol_target", "max_gross_leverage", "kelly_fraction", "cost_bps_per_side", "periods_per_year", "seed")


def fingerprint(cfg: Strategy) -> dict:
    values = asdict(cfg)
    return {k: list(values[k]) if isinstance(values[k], tuple) else values[k] for k in FINGERPRINT}


def canonical_json(values: Mapping) -> str:
    """Sorted keys, no blanks, ASCII."""
    return json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def config_hash(cfg: Strategy) -> str:
    return hashlib.sha256(canonical_json(fingerprint(cfg)).encode()).hexdigest()

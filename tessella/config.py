"""Settings, their defaults and checks. A limit is a positive whole number, or None where it is off."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.paths import checked_roots


# The limits that hold where settings name none.


@dataclass(frozen=True)
class Coupling:
    minimum_fan_out: int = 5
    minimum_contracts: int = 10
    minimum_fan_in: int = 5
    minimum_z: float = 2.0


@dataclass(frozen=True)
class Chronology:
    window: int = 500
    maximum_files: int = 20
    minimum_observations: int = 30
    minimum_shared: int = 5
    minimum_rate: float = 0.8
    minimum_lift: float = 2.0


@dataclass(frozen=True)
class Semantic:
    minimum_cluster: int = 8
    minimum_distance: float = 0.8
    cut: float = 0.25


@dataclass(frozen=True)
class Settings:
    surface_limit: int | None = 40
    file_limit: int | None = 12
    instruction_lines: int | None = 150
    source_gap: int | None = 4
    test_gap: int | None = None
    score_threshold: int = 4
    weights: dict = field(default_factory=lambda: {"error": 4, "smell": 2, "info": 1})
    exact_clone_nodes: int = 20
    near_clone_nodes: int = 15
    near_clone_anchors: int = 3
    near_clone_ratio: float = 0.9
    near_clone_methods: int = 3
    color_roots: tuple[str, ...] = ()
    color_files: int | None = None
    disabled: tuple[str, ...] = ()
    coupling: Coupling = Coupling()
    chronology: Chronology = Chronology()
    semantic: Semantic = Semantic()


def _check(name: str, value, default) -> object:
    if isinstance(default, (Coupling, Chronology, Semantic)):
        if not isinstance(value, dict):
            raise ValueError(f"{name} must be a section")
        return _section(type(default), value, name)
    if name in ("color_roots", "disabled"):
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise ValueError(f"{name} must be a list of texts")
        return tuple(checked_roots(value) if name == "color_roots" else value)
    if name == "weights":
        if not isinstance(value, dict) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 for x in value.values()):
            raise ValueError("weights must be numbers from 0")
        return {**default, **value}
    if value is False:
        if isinstance(default, float) or name == "score_threshold":
            raise ValueError(f"{name} can't be off")
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
        raise ValueError(f"{name} must be above 0")
    if not isinstance(default, float) and value != int(value):
        raise ValueError(f"{name} must be a whole number")
    return value


def _section(kind, values: dict, at: str):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"{at}: unknown {', '.join(sorted(unknown))}")
    default = kind()
    return kind(**{k: _check(k, v, getattr(default, k)) for k, v in values.items()})


def settings(values: dict | None = None) -> Settings:
    return _section(Settings, values or {}, "settings")


def load_settings(path: str | None) -> Settings:
    """Settings of a JSON file; defaults where there is none."""
    if path is None or not Path(path).exists():
        return Settings()
    return settings(json.loads(Path(path).read_text()))

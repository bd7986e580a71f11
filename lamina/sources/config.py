"""Settings from a TOML file; every section and key has a default, a missing file is all defaults."""

from __future__ import annotations

import os
import tomllib
import warnings
from dataclasses import dataclass, field, fields


@dataclass
class Storage:
    data_dir: str = "~/.lamina"
    max_size_gb: int = 10
    encryption: bool = False


@dataclass
class Embeddings:
    model: str = "stub"
    device: str = "auto"
    batch_size: int = 32


@dataclass
class Consolidation:
    hot_to_warm_days: int = 28
    warm_to_cold_days: int = 180
    schedule: str = "idle"


@dataclass
class Scopes:
    default: str = "personal"


@dataclass
class Budgets:
    default_recall_limit: int = 10
    auto_context_token_budget: int = 4000


@dataclass
class Checkpoints:
    session_interval_secs: int = 30
    session_interval_turns: int = 5
    snapshot_inserts: int = 1000


@dataclass
class Config:
    storage: Storage = field(default_factory=Storage)
    embeddings: Embeddings = field(default_factory=Embeddings)
    consolidation: Consolidation = field(default_factory=Consolidation)
    scopes: Scopes = field(default_factory=Scopes)
    budgets: Budgets = field(default_factory=Budgets)
    checkpoints: Checkpoints = field(default_factory=Checkpoints)


#: The least value of numbers; all others are whole numbers from 1 on.
LEAST = {"max_size_gb": 0, "hot_to_warm_days": 0, "warm_to_cold_days": 0, "auto_context_token_budget": 0}


def checked(section: str, key: str, default, value):
    """A value of the default's type and in its range."""
    where = f"[{section}] {key}"
    if type(value) is not type(default):
        raise ValueError(f"{where} must be of type {type(default).__name__}, not {type(value).__name__}")
    if isinstance(value, int) and not isinstance(value, bool) and value < (least := LEAST.get(key, 1)):
        raise ValueError(f"{where} must be at least {least}")
    if isinstance(value, str) and not value.strip():
        raise ValueError(f"{where} must not be blank")
    if key == "schedule" and value != "idle":
        warnings.warn(f"{where} = {value!r} is taken as 'idle'", stacklevel=3)
        return "idle"
    return value


def load(path: str) -> Config:
    """Settings of a file; sections and keys that aren't known are left alone, a known one of the wrong type or range is an error that names it."""
    config = Config()
    if not os.path.exists(path):
        return config
    with open(path, "rb") as f:
        given = tomllib.load(f)
    for section in fields(config):
        own, found = getattr(config, section.name), given.get(section.name, {})
        if not isinstance(found, dict):
            raise ValueError(f"[{section.name}] must be a section")
        for key, value in found.items():
            if any(key == k.name for k in fields(own)):
                setattr(own, key, checked(section.name, key, getattr(own, key), value))
    if config.consolidation.hot_to_warm_days > config.consolidation.warm_to_cold_days:
        raise ValueError("[consolidation] hot_to_warm_days must not be more than warm_to_cold_days")
    return config

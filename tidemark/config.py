"""Settings, from environment variables TIDEMARK_<SECTION>__<FIELD>."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from tidemark.errors import ConfigError

PREFIX = "TIDEMARK_"


@dataclass(frozen=True)
class Gate:
    tolerance: float = 0.005
    max_contaminated: float = 0.02
    min_coverage: float = 0.5
    quantile: float = 0.999


@dataclass(frozen=True)
class Train:
    vocab: int = 1024
    max_tokens: int = 64
    epochs: int = 20
    seed: int = 20260908


@dataclass(frozen=True)
class Settings:
    gate: Gate = field(default_factory=Gate)
    train: Train = field(default_factory=Train)


def load(environ: Mapping[str, str] | None = None) -> Settings:
    """Settings of the given mapping (the process environment if none); unknown names are refused."""
    environ = os.environ if environ is None else environ
    values: dict[str, dict[str, float | int]] = {"gate": {}, "train": {}}
    kinds = {"gate": {f.name: type(f.default) for f in fields(Gate)}, "train": {f.name: type(f.default) for f in fields(Train)}}
    for name, text in environ.items():
        if not name.startswith(PREFIX):
            continue
        section, _, key = name[len(PREFIX) :].lower().partition("__")
        kind = kinds.get(section, {}).get(key)
        if kind is None:
            raise ConfigError(f"unknown setting {name}", "known: " + ", ".join(f"{PREFIX}{s}__{k}".upper() for s in kinds for k in kinds[s]))
        try:
            values[section][key] = kind(text)
        except ValueError:
            raise ConfigError(f"{name} is not a {kind.__name__}: {text!r}", "give a number") from None
    got = Settings(Gate(**values["gate"]), Train(**values["train"]))
    g, t = got.gate, got.train
    if not (0 <= g.tolerance < 1 and 0 <= g.max_contaminated <= 1 and 0 <= g.min_coverage <= 1 and 0 < g.quantile < 1):
        raise ConfigError("a gate setting is out of range", "tolerance, max_contaminated and min_coverage lie in 0 to 1, quantile between 0 and 1")
    if not (300 <= t.vocab <= 100_000 and t.max_tokens > 0 and t.epochs > 0):
        raise ConfigError("a train setting is out of range", "vocab lies in 300 to 100000; max_tokens and epochs are positive")
    return got

"""A stored baseline: accuracy and macro F1 of each model, and what they were measured on."""

from __future__ import annotations

import json
from pathlib import Path

from tidemark.errors import BaselineError

VERSION = 1
METRICS = ("accuracy", "macro_f1")


def save(path: str | Path, metrics: list[dict], *, split_digest: str = "", note: str = "", recorded_at: str = "") -> dict:
    doc = {
        "tidemark_baseline": VERSION, "recorded_at": recorded_at, "note": note, "measured_on": split_digest,
        "metrics": {m["model"]: {k: m[k] for k in METRICS} for m in metrics},
    }
    Path(path).write_text(json.dumps(doc, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return doc


def load(path: str | Path) -> dict:
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
        version, found = doc["tidemark_baseline"], doc["metrics"]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise BaselineError(f"{path} is no baseline: {e}", "measure one with --update-baseline") from None
    if version > VERSION:
        raise BaselineError(f"{path} has version {version}; this engine reads {VERSION}", "use a newer engine")
    if not found:
        raise BaselineError(f"{path} has no metrics", "measure one with --update-baseline")
    return doc


def rows(metrics: dict[str, dict[str, float]]) -> list[tuple[str, str, float]]:
    return [(model, k, float(v)) for model, m in sorted(metrics.items()) for k, v in m.items() if k in METRICS]

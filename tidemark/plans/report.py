"""What one evaluation decided, and its renderings. A refused evaluation has no metrics in any of them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET


@dataclass(frozen=True)
class Evaluation:
    """Plain values only: rows of the small result tables as dictionaries."""

    contamination: dict
    refused: str | None = None
    metrics: list[dict] = field(default_factory=list)
    comparisons: list[str] = field(default_factory=list)
    most_confused: list[dict] = field(default_factory=list)
    noise_ceiling: float | None = None
    verdict: list[dict] | None = None
    notes: list[str] = field(default_factory=list)
    recorded_at: str = ""

    def __post_init__(self) -> None:
        if self.refused and (self.metrics or self.comparisons or self.most_confused or self.verdict):
            raise ValueError("a refused evaluation must not carry metrics")

    @property
    def trustworthy(self) -> bool:
        return self.refused is None

    @property
    def passed(self) -> bool:
        held = self.verdict is None or not any(v["change"] in ("regression", "removed") for v in self.verdict)
        return self.trustworthy and held

    @property
    def best(self) -> dict | None:
        return max(self.metrics, key=lambda m: (m["accuracy"], m["macro_f1"]), default=None)


def _rounded(x: object) -> object:
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dict):
        return {k: _rounded(v) for k, v in x.items()}
    return [_rounded(v) for v in x] if isinstance(x, list) else x


def as_document(e: Evaluation) -> dict:
    doc: dict = {"passed": e.passed, "refused": e.refused, "contamination": _rounded(e.contamination), "recorded_at": e.recorded_at, "notes": e.notes}
    if e.trustworthy:
        doc |= {"metrics": _rounded(e.metrics), "comparisons": e.comparisons, "most_confused": e.most_confused, "noise_ceiling": _rounded(e.noise_ceiling)}
        doc["verdict"] = None if e.verdict is None else _rounded(e.verdict)
    return doc


def render_json(e: Evaluation) -> str:
    return json.dumps(as_document(e), indent=2, ensure_ascii=False) + "\n"


def contamination_summary(row: dict) -> str:
    """A contamination report in a line, rates to four digits."""
    level = "calibrated" if row.get("calibrated") else "uncalibrated"
    return f"{row['hits']} of {row['evaluated']} checked records ({row['rate']:.4f}) at or above the {level} threshold {row['threshold']:.4f}; {row['coverage']:.4f} of {row['total']} could be checked"


def calibration_summary(row: dict) -> str:
    return f"threshold {row['threshold']:.6f} from {row['scored']} records ({row['not_checkable']} too short, {row['dropped']} dropped as shared); null rate {row['null_rate']:.4f}, at the default {row['null_rate_default']:.4f}"


def metrics_summary(row: dict) -> str:
    return f"{row['model']}: accuracy {row['accuracy']:.6f}, macro F1 {row['macro_f1']:.6f} over {row['records']} records"


def render_junit(e: Evaluation) -> str:
    """The cases contamination and regression. A refused evaluation has the first only; the second is skipped where nothing was compared."""
    suite = ET.Element("testsuite", name="evaluation")
    facts = ET.SubElement(suite, "properties")
    for name, value in sorted((_rounded(e.contamination) | {"recorded_at": e.recorded_at}).items()):
        ET.SubElement(facts, "property", name=name, value=str(value))
    first = ET.SubElement(suite, "testcase", classname="gate", name="contamination")
    tests, failures, skipped = 1, 0, 0
    if e.refused:
        ET.SubElement(first, "failure", message=e.refused)
        failures = 1
    else:
        second = ET.SubElement(suite, "testcase", classname="gate", name="regression")
        tests = 2
        if e.verdict is None:
            ET.SubElement(second, "skipped", message="there is no baseline")
            skipped = 1
        elif not e.passed:
            bad = ", ".join(f"{v['model']} {v['metric']}: {v['change']}" for v in e.verdict if v["change"] in ("regression", "removed"))
            ET.SubElement(second, "failure", message=bad)
            failures = 1
    for name, n in (("tests", tests), ("failures", failures), ("skipped", skipped)):
        suite.set(name, str(n))
    return ET.tostring(suite, encoding="unicode") + "\n"


def _table(rows: list[dict], columns: list[str]) -> list[str]:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows)]


def render_markdown(e: Evaluation) -> str:
    if e.refused:
        return f"# Evaluation: REFUSED\n\n{e.refused}\n\nNo metrics were computed.\n"
    lines = [f"# Evaluation: {'passed' if e.passed else 'FAILED'}", "", "## Contamination", "", *_table([e.contamination], list(e.contamination)), "", "## Models", ""]
    lines += _table(e.metrics, ["model", "records", "accuracy", "macro_f1", "mean_confidence", "top_decile_accuracy"])
    if e.noise_ceiling is not None:
        lines += ["", f"Wrong labels bound the accuracy at {e.noise_ceiling:.4f}."]
    if e.comparisons:
        lines += ["", "## Comparisons", "", *(f"- {c}" for c in e.comparisons)]
    if e.most_confused:
        lines += ["", "## Most confused", "", *_table(e.most_confused, ["target", "predicted", "n"])]
    if e.verdict is not None:
        lines += ["", "## Baseline", "", *_table(e.verdict, ["model", "metric", "before", "now", "change"])]
    if e.notes:
        lines += ["", "## Notes", "", *(f"- {n}" for n in e.notes)]
    return "\n".join(lines) + "\n"


def render_data_card(card: dict, labels: list[dict], curation: dict | None = None, metadata: dict | None = None) -> str:
    lines = ["# Data card", "", "## Provenance", "", *(f"- {k}: {v}" for k, v in sorted((metadata or {}).items())), "", "## Text", "", *_table([card], list(card))]
    lines += ["", "## Labels", "", *_table(labels, ["label", "records"])]
    if curation:
        lines += ["", "## Duplicates", "", *_table([curation], list(curation))]
    return "\n".join(lines) + "\n"

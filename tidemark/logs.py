"""Log lines on standard error, as JSON objects or for a console."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

from tidemark.errors import ConfigError

LEVELS = ("debug", "info", "warning", "error")
FORMS = ("console", "json")
NAME = "tidemark"


class _Lines(logging.Formatter):
    def __init__(self, form: str) -> None:
        super().__init__()
        self.form = form

    def format(self, record: logging.LogRecord) -> str:
        facts = getattr(record, "facts", {})
        at = datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds")
        if self.form == "json":
            return json.dumps({"at": at, "level": record.levelname.lower(), "event": record.getMessage(), **facts}, ensure_ascii=False, default=str)
        return " ".join([at, f"{record.levelname.lower():7}", record.getMessage(), *(f"{k}={v}" for k, v in facts.items())])


def configure(level: str = "warning", form: str = "console") -> logging.Logger:
    """The engine's logger, writing to standard error; what was configured before is replaced."""
    if level not in LEVELS or form not in FORMS:
        raise ConfigError(f"there is no log level {level!r} or form {form!r}", f"levels: {', '.join(LEVELS)}; forms: {', '.join(FORMS)}")
    logger = logging.getLogger(NAME)
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Lines(form))
    logger.handlers[:] = [handler]
    logger.propagate = False
    logger.setLevel(level.upper())
    return logger


def event(name: str, level: str = "info", **facts: object) -> None:
    """Log what happened, with facts by name."""
    logging.getLogger(NAME).log(getattr(logging, level.upper()), name, extra={"facts": facts})

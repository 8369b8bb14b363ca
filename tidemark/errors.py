"""Errors that a user can act upon: a message and a remedy."""

from __future__ import annotations

HELD, USAGE, REFUSED, NO_VERDICT = 0, 1, 2, 3


class EngineError(Exception):
    """Base of all errors that the command line reports without a traceback."""

    def __init__(self, message: str, remedy: str = "") -> None:
        super().__init__(message)
        self.message, self.remedy = message, remedy


class ConfigError(EngineError):
    """A setting is unknown or out of range."""


class CorpusError(EngineError):
    """A corpus cannot be read, or lacks what an operation needs."""


class SplitError(EngineError):
    """A split is impossible as asked."""


class ContaminationError(EngineError):
    """The contamination check fails or cannot be applied."""


class TokenizerError(EngineError):
    """A tokenizer cannot be trained, read or applied."""


class ModelError(EngineError):
    """A model cannot be trained, read or applied."""


class EvaluationError(EngineError):
    """Predictions cannot be scored."""


class BaselineError(EngineError):
    """A baseline cannot be read or compared."""

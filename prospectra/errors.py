"""Errors and warnings of the engine: all errors share one base, so that a caller can catch them together."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors."""


class ConfigError(EngineError, ValueError):
    """A setting is missing, unknown or out of range."""


class InputError(EngineError, ValueError):
    """A table breaks its contract; details holds counts or examples."""

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.details = details or {}


class FeatureError(EngineError):
    """Features can't be computed or stored."""


class LearnerError(EngineError):
    """A model can't be fitted or gives invalid predictions."""


class AcquisitionError(EngineError, ValueError):
    """Scores can't be computed from the given columns or settings."""


class OracleError(EngineError):
    """A measurement is missing or invalid."""


class StorageError(EngineError, OSError):
    """A table can't be written or read."""


class PruningError(EngineError, ValueError):
    """Pruning got invalid settings."""


class CycleError(EngineError):
    """A cycle failed; cycle says which."""

    def __init__(self, message: str, cycle: int):
        super().__init__(f"cycle {cycle}: {message}")
        self.cycle = cycle


class EngineWarning(UserWarning):
    """Base of all warnings."""


class FitWarning(EngineWarning):
    """A fit ended before it converged."""

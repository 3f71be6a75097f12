"""Errors that the engine raises."""


class EngineError(Exception):
    """Base of all errors below."""


class LoadError(EngineError):
    """A source cannot be read."""


class ValidationError(EngineError, ValueError):
    """Input lacks required columns or has inconsistent lengths."""


class InsufficientHistory(EngineError, ValueError):
    """A series is too short for what was asked."""


class UnknownDataset(EngineError, KeyError):
    """No dataset of that name."""


class ConflictingWrite(EngineError, RuntimeError):
    """Another writer changed the dataset."""


class UnknownModel(EngineError, KeyError):
    """No model of that name."""

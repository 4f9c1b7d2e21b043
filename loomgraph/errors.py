"""Errors that the driver raises. Bad data never raises: it becomes issues and reasons on rows."""


class ConfigurationError(ValueError):
    """A pipeline or operator is put together wrongly."""


class SourceError(RuntimeError):
    """A source as a whole can't be read."""


class IllegalTransition(ValueError):
    """A ledger row can't go from its state to the one asked for."""


class ReplayMiss(KeyError):
    """A replayed completion was never recorded."""


class EvidenceMissing(LookupError):
    """Evidence that is cited isn't stored."""


class Conflict(RuntimeError):
    """Another writer committed first, or a different row is already recorded."""


class CapabilityError(RuntimeError):
    """A read asks for what the store doesn't support."""

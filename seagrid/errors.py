"""Errors of the engine."""


class GridDataError(ValueError):
    """Malformed grid files, axes or catalogs."""


class SourceNotRegistered(KeyError):
    """No source of that id."""


class SourceNotReady(RuntimeError):
    """The source exists but can't be queried."""


class EngineClosed(RuntimeError):
    """The engine was closed."""

"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors that the engine raises."""


class ProtocolError(EngineError):
    """A malformed or unsupported replication message."""


class ConfigError(EngineError):
    """An invalid definition file."""


class SchemaDriftError(EngineError):
    """A source no longer has what a view needs."""


class SetupError(EngineError):
    """Views can't be set up."""

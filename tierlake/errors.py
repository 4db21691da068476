"""Errors of this package; all derive from EngineError."""


class EngineError(Exception):
    """Anything that this package refuses."""


class QueryError(EngineError):
    """A query that can't be resolved."""


class AttributeMissing(QueryError):
    """A name that the schema doesn't have at that place."""


class SubsetMissing(QueryError):
    """A subset that the schema doesn't have."""


class ParseFailure(EngineError):
    """A source file that isn't what its reader expects; carries the path."""

    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")
        self.path = path

"""Errors that statements raise."""


class SqlError(Exception):
    """Any error in a statement."""


class ParseError(SqlError):
    """The text isn't a statement of the dialect."""


class Unsupported(ParseError):
    """The text is SQL that the dialect leaves out; nothing is ignored in silence."""


class PlanError(SqlError):
    """Names, types or groups don't fit the catalog."""


class CommitConflict(SqlError):
    """Another writer committed to the table first."""

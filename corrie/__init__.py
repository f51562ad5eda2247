"""A SQL analytics engine on PySpark: a compact dialect lowered to DataFrames, over Parquet tables with snapshots."""

from .errors import CommitConflict, ParseError, PlanError, SqlError, Unsupported
from .session import Engine, Result
from .sources.store import StoreConfig

__all__ = ["CommitConflict", "Engine", "ParseError", "PlanError", "Result", "SqlError", "StoreConfig", "Unsupported"]

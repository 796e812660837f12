"""Registered queries over the test tables, each with its SQL counterpart."""

from sparkprep.queries.registry import ORACLES, QUERIES

from sparkprep.queries import (  # noqa: F401, E402  (modules register on import)
    cleaning,
    columns,
    layouts,
    planning,
    quality,
    raw_files,
    runs,
)

__all__ = ["ORACLES", "QUERIES"]

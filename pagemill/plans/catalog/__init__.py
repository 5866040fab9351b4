"""Every operator as a named query over the given tables, with SQL to check it."""

from pagemill.plans.catalog import (  # noqa: F401
    geometry_queries,
    text_queries,
    document_queries,
    input_queries,
    task_queries,
    stream_queries,
)
from pagemill.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

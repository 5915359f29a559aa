"""Query catalog."""

from cargoscope.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

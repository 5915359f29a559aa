"""Named queries, each with the SQL its result is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cargoscope.catalog.views import VIEWS
from cargoscope.sources.starschema import DERIVED, Star, needs

MODULES = ("scans", "columns", "lookups", "risk", "behaviour", "release", "cases")

_QUERIES: dict[str, Callable[[Star], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` names derived tables and views as ``{name}``."""

    def register(fn: Callable[[Star], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = sql
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"cargoscope.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(fn: Callable[[Star], DataFrame]):
        return lambda spark, folder: fn(Star(spark, folder))

    return {name: bound(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _CHECKS.items()}


def with_views(sql: str) -> str:
    """The statement headed by every view it depends on, in dependency order."""
    known = DERIVED | VIEWS
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name in known and name not in ordered:
                visit(known[name])
                ordered.append(name)

    visit(sql)

    def plain(text: str) -> str:
        return re.sub(r"\{(\w+)\}", r"\1", text)

    if not ordered:
        return plain(sql)
    # Materialised, or a long chain of views would be expanded again at every reference.
    head = ",\n".join(f"{name} AS MATERIALIZED ({plain(known[name])})" for name in ordered)
    body = plain(sql).strip()
    if body.startswith("WITH "):
        return f"WITH {head},\n{body.removeprefix('WITH ')}"
    return f"WITH {head}\n{body}"

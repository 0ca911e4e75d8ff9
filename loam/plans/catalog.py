"""Registry of the engine's queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from loam.functions.shared import size_shuffles

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that must give the same rows. Its shuffles are dealt out by the size of its tables."""

    def add(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark, sf_dir):
            size_shuffles(spark, sf_dir)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _load() -> None:
    import importlib
    import pkgutil

    import loam.plans as here

    for m in pkgutil.iter_modules(here.__path__):
        if m.name != "catalog":
            importlib.import_module(f"loam.plans.{m.name}")


_load()

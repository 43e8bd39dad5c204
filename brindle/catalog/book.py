"""A family's list of queries."""

from __future__ import annotations

from collections.abc import Callable

from brindle.catalog import datasets


class Book:
    """Collects a family's queries: ``@book("name", sql)`` over a function of (tables)."""

    def __init__(self):
        self.queries: dict[str, tuple[Callable, str | None]] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f):
            def run(spark, sf_dir: str):
                return f(datasets.Tables(spark, sf_dir))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = (run, sql)
            return f

        return add

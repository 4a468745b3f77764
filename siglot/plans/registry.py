"""Every registered query of the analytics library, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) as query `name`, with SQL that gives the same rows where there is some."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


from siglot.plans import cleaning, linking, lots, measures, models, publication, quality, release, signals, summaries, tables  # noqa: E402, F401

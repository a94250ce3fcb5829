"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def load() -> None:
    from . import analysis, cube, estimation, file_jobs, measures, ordered, panels, records, pixel_tables, profiles, recoding, text_jobs  # noqa: F401

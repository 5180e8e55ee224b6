"""Queries of the change-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import base, folds, logs, scalars, streams  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)

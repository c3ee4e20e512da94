"""All registered queries with their SQL."""

from __future__ import annotations

from ..operators import aggregates, conversations, joins, knowledge, scalars, statements, windows  # noqa: F401  they register themselves
from ..sources import layout  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)

"""Queries over the driver tables, and the same queries as SQL."""

from __future__ import annotations

from . import catalog, geo, lenses, metrics, motion, recurrences, robust, rotations, search, sources, stages, trajectory  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

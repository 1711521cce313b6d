"""Registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from tessaria.plans import aggregates, comparables, details, ingest, ledgers, linking, models, operations, relational, selections, sources  # noqa: F401  (modules register on import)
from tessaria.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

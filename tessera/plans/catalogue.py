"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from tessera.plans import arrays, branches, curate, evaluate, inventory, lookups, meters, prefer, text, vectors  # noqa: F401  they register themselves
from tessera.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

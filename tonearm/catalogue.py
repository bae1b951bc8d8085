"""Every query of the library, with the SQL that states its result."""

from __future__ import annotations

from tonearm.plans import browse, library, registry, shapes, streams  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)

"""Every query of the engine by name, with its DuckDB statement."""

from __future__ import annotations

from . import numeric, phase, scalars, segments, similarity

MODULES = (scalars, segments, numeric, phase, similarity)


def queries() -> dict:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

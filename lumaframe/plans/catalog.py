"""All core queries and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from lumaframe.plans import frames, records, relational

_MODULES = (relational, records, frames)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_scalars", "q_windows", "q_evaluate", "q_detect", "q_sources", "q_tables", "q_streams"]


def _registries():
    return [import_module(f"{__package__}.{m}").R for m in MODULES]


def queries() -> dict:
    return {name: q for r in _registries() for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in _registries() for name, sql in r.sql.items()}

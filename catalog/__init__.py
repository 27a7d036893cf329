"""Registered queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("laps", "telemetry", "models", "reports")


def all_queries() -> dict:
    from catalog.registry import QUERIES

    for m in MODULES:
        import_module(f"catalog.{m}")
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    from catalog.registry import SQL

    return dict(SQL)

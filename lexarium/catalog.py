"""All queries of the engine with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

_MODULES = ("graphs", "tables", "texts", "records", "actors", "screening")


def _collect(name: str) -> dict:
    found: dict = {}
    for m in _MODULES:
        own = getattr(importlib.import_module(f"lexarium.plans.{m}"), name)
        if twice := found.keys() & own.keys():
            raise ValueError(f"named twice: {twice}")
        found |= own
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")

"""Queries of the engine with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("changes", "graph", "compare", "source")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f".{m}", __name__), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")

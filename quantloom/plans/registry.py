"""Every registered plan with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

MODULES = ("universe", "features", "books", "graphs", "studies")


def _modules():
    return [import_module(f"quantloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}

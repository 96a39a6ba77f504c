"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLE, QUERIES

_MODULES = ("tables", "features", "evaluation", "anomaly", "learning")


def _load() -> None:
    for m in _MODULES:
        import_module(f"{__name__}.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLE)

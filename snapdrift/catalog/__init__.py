"""Every operator and monitor as a query over ordinary tables."""

from __future__ import annotations

from importlib import import_module

from snapdrift.catalog.registry import ORACLE, QUERIES, Query

MODULES = ("monitors", "extraction", "columns", "history")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)

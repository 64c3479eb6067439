"""Registered queries over the star-schema tables."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "data_queries",
    "feature_queries",
    "metric_queries",
    "audit_queries",
    "ledger_queries",
    "record_queries",
    "source_queries",
)


def _load() -> None:
    for module in MODULES:
        import_module(f"jetframe.plans.{module}")


def registry():
    from jetframe.plans import catalog

    _load()
    return catalog.QUERIES


def oracles():
    from jetframe.plans import catalog

    _load()
    return catalog.ORACLES

"""All queries of the core library."""

from __future__ import annotations

import importlib

from quern.plans.registry import Query

MODULES: list[str] = ["select_queries", "record_queries", "relate_queries", "stats_queries", "array_queries", "pipeline_queries"]


def _registries() -> list:
    return [importlib.import_module(f"quern.plans.{m}").R for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}

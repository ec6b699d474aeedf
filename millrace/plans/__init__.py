"""Runnable plans, one module per operator family."""

from __future__ import annotations

import importlib

from millrace.plans import registry

FAMILIES = (
    "scans",
    "expressions",
    "joins",
    "aggregates",
    "windows",
    "composition",
    "dialect",
    "incremental",
    "cdc",
    "schema",
    "layout",
    "corpus",
    "sql_tokens",
    "review",
    "duplicates",
    "history",
)


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"millrace.plans.{name}")


def queries() -> dict[str, registry.Builder]:
    load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(registry.ORACLES)

"""Registered queries: name -> (Spark builder, equivalent SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["rules", "data", "monitoring", "search", "cases", "live"]


def registry() -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in import_module(f"remedia.catalog.{name}").QUERIES.items():
            if key in found:
                raise ValueError(f"query {key} registered twice")
            found[key] = value
    return found

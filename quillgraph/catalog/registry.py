"""All registered queries and their SQL, collected from the catalog modules."""

from __future__ import annotations

import importlib

MODULES = ["chunking", "store", "media", "graph", "search", "review", "streams"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"quillgraph.catalog.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")

"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from panelworks.workload.registry import REGISTRY, Query

MODULES = ["relational", "features", "tables", "text", "vectors", "graphs", "learning", "modelling", "snapshots"]


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"panelworks.workload.{m}")
    return dict(REGISTRY)

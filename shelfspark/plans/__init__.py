"""Registered queries, one module per part of the inventory."""

from __future__ import annotations

import importlib

MODULES = [
    "relational",
    "cleaning",
    "windows",
    "pricing",
    "anomaly",
    "inventory",
    "forecast",
    "files",
    "streams",
    "models",
]


def load():
    """(queries, oracles) of all modules."""
    from shelfspark.plans import registry

    for name in MODULES:
        importlib.import_module(f"shelfspark.plans.{name}")
    return registry.QUERIES, registry.ORACLES

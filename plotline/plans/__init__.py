"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

from plotline.plans.registry import ORACLES, QUERIES

_MODULES = ("ingest", "normalise", "sequences", "selection", "matching", "scoring", "release", "checks", "picks", "models", "sinks")


def load() -> tuple[dict, dict]:
    """All queries and the SQL of those that have some."""
    for name in _MODULES:
        importlib.import_module(f"plotline.plans.{name}")
    return QUERIES, ORACLES

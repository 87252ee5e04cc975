"""Named queries over the given tables and their SQL counterparts."""

from __future__ import annotations

import importlib

from txquality.catalog.registry import ORACLES, QUERIES

MODULES = [
    "mart_queries",
    "quality_queries",
    "evaluation_queries",
    "drift_queries",
    "search_queries",
    "run_queries",
    "version_queries",
    "metric_queries",
    "model_queries",
    "stream_queries",
    "source_queries",
]

for _module in MODULES:
    importlib.import_module(f"txquality.catalog.{_module}")

__all__ = ["QUERIES", "ORACLES"]

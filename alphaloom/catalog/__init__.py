"""All registered queries."""

from __future__ import annotations

import importlib

from alphaloom.catalog.base import ORACLES, QUERIES

MODULES = (
    "technical",
    "fundamental",
    "sentiment",
    "preprocess",
    "effectiveness",
    "selection",
    "quality",
    "rollups",
    "scans",
    "store",
    "streams",
    "ml",
    "registry",
)

for _m in MODULES:
    importlib.import_module(f"alphaloom.catalog.{_m}")

__all__ = ["ORACLES", "QUERIES"]

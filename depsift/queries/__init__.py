"""Registered queries over the supply-chain operators."""

from __future__ import annotations

import importlib

from depsift.queries.registry import ORACLES, QUERIES

for _module in ("audit", "containers", "core", "feeds", "findings", "graphs", "names", "supply", "streams", "threats", "upgrades"):
    importlib.import_module(f"depsift.queries.{_module}")

__all__ = ["ORACLES", "QUERIES"]

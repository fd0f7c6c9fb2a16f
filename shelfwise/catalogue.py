"""Every query by name, and its SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ("prices", "entities", "labelling", "serving", "auditing", "records", "taxonomies")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in PARTS:
    _module = import_module(f"shelfwise.plans.{_part}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["panels", "splits", "models", "exploration", "storage", "training", "fitted", "seasonal", "artifacts"]


def _modules():
    return [importlib.import_module(f"panelmill.catalog.{m}") for m in MODULES]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}

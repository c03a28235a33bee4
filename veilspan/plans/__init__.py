"""Queries bound to the given tables."""
from __future__ import annotations

import importlib

MODULES = ("texts", "calls", "people", "facts", "tables")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"veilspan.plans.{m}")

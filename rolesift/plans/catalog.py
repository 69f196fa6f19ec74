"""All catalogue queries by name: (Spark query, checking SQL or None)."""

from __future__ import annotations

import importlib

_PARTS = ["matching", "scalars", "pages", "state", "sources"]

CATALOG = {}
for _part in _PARTS:
    CATALOG.update(importlib.import_module(f"rolesift.plans.catalog_{_part}").QUERIES)

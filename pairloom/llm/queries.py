"""All queries of this package: name -> (query, comparison SQL or None)."""

from __future__ import annotations

import importlib
import pkgutil

import pairloom.llm as package


def registry() -> dict:
    found: dict = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module != "queries":
            found |= getattr(importlib.import_module(f"{package.__name__}.{module}"), "QUERIES", {})
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))

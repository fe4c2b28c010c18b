"""Named queries over the data folder, one module per family."""

from __future__ import annotations

import importlib
import pkgutil


def registry() -> dict:
    """name -> (query, sql or None), from the QUERIES of every module here."""
    found: dict = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        for name, entry in getattr(importlib.import_module(f"{__name__}.{module}"), "QUERIES", {}).items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = entry
    return found

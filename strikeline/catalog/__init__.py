"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("pipelines", "series", "joins", "chains", "evaluation", "scalars", "tables", "learning", "streams", "ticks")


def load() -> dict:
    """Import every catalog module once and return the registry."""
    for m in MODULES:
        importlib.import_module(f"strikeline.catalog.{m}")
    from strikeline.catalog.base import REGISTRY

    return REGISTRY

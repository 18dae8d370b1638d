"""Query catalogue: importing a plan module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["ledger", "analytics", "citizens", "labels", "products", "tokens", "pages", "scans", "streams"]


def load_all():
    from tallymark.plans.registry import REGISTRY

    for name in MODULES:
        importlib.import_module(f"tallymark.plans.{name}")
    return REGISTRY

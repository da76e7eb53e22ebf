from __future__ import annotations

import importlib

MODULES = ["files", "cleaning", "joins", "profiling", "rules", "evaluation", "modelling", "checks", "text"]


def load_catalog():
    """Import every catalog module and return ``(queries, sql)``."""
    from claimsieve.catalog import registry

    for name in MODULES:
        importlib.import_module(f"claimsieve.catalog.{name}")
    return dict(registry.QUERIES), dict(registry.SQL)

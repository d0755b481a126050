"""Queries over the given tables, one module per family."""

import importlib
import pkgutil

from logquarry.catalog.registry import CHECKS, QUERIES

for _module in pkgutil.iter_modules(__path__):
    if _module.name not in ("registry", "views"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["CHECKS", "QUERIES"]

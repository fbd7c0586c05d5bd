"""Registered queries over the driver tables, each with its plain-SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries():
    """Import every catalog module and return (queries, oracle texts)."""
    from catalog import registry

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"catalog.{module.name}")
    return registry.QUERIES, {k: registry.with_views(s) for k, s in registry.ORACLE.items()}

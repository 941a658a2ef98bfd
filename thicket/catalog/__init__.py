"""Registered queries and their SQL twins, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every module of the catalog; returns (queries, oracles)."""
    from . import base

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return base.QUERIES, base.ORACLES

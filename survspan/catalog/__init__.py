"""Registered queries (one per operator of the survey's inventory) and their oracles."""

from __future__ import annotations

from . import describe, exponential, maximum, models, prep, resampling, survival  # noqa: F401  (register)
from .registry import REGISTRY


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

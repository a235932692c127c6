"""Query registry: name -> (Spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def r6(c, name: str | None = None):
    """Round a computed double to 6 places (the oracle does the same)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0
    return out.alias(name or (c if isinstance(c, str) else None)) if (name or isinstance(c, str)) else out


def sql_r6(expr: str, name: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0) AS {name}"

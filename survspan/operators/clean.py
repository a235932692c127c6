"""Cleaning, projection, recode and row filters.

All are column expressions: they stay inside whole-stage codegen and need no
shuffle.  Missing-value rules follow the reference: a null test never selects
a branch (falls through), except where a default class is stated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

MAX_LEVELS = 1000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- C1-C6
def null_token(df: DataFrame, token: str = ".", cols: Sequence[str] | None = None) -> DataFrame:
    """The text token (default '.') becomes missing on every (string) column."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(F.col(c) == F.lit(token), F.lit(None)).otherwise(F.col(c)) for c in cols})


def to_numeric(df: DataFrame, cols: Sequence[str] | None = None, dtype: str = "double") -> DataFrame:
    """Text -> number; unparsable text -> missing (try_cast, never throws)."""
    cols = cols or df.columns
    return df.withColumns({c: F.col(c).try_cast(dtype) for c in cols})


def id_as_string(df: DataFrame, col: str = "id") -> DataFrame:
    """Numeric id -> canonical string ('0048' -> '48')."""
    return df.withColumn(col, F.col(col).try_cast("double").try_cast("long").cast("string"))


def as_factor(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4: declare categorical columns; sorted distinct non-null levels go to column metadata.

    Level discovery is one distinct aggregate per column, bounded by MAX_LEVELS.
    """
    for c in cols:
        vals = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
        if len(vals) > MAX_LEVELS:
            raise ValueError(f"{c}: more than {MAX_LEVELS} levels; not a categorical column")
        levels = sorted(vals)  # numbers sort as numbers, text as text
        meta = dict(df.schema[c].metadata)
        meta["levels"] = [str(v) for v in levels]
        df = df.withMetadata(c, meta)
    return df


def label(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Column labels as metadata (survive Parquet)."""
    for c, text in labels.items():
        meta = dict(df.schema[c].metadata)
        meta["label"] = text
        df = df.withMetadata(c, meta)
    return df


def across(df: DataFrame, selector, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a Column -> Column function over the selected columns."""
    names = select_names(df, selector) if not isinstance(selector, (list, tuple)) else list(selector)
    return df.withColumns({c: fn(F.col(c)) for c in names})


# ---------------------------------------------------------------- C7 projection
def select_names(df: DataFrame, *spec) -> list[str]:
    """Names from a spec list.  Items: 'name', 'contains:txt' (case-insensitive),
    'a:b' positional range in current order, '-item' removes (minus)."""
    cols = df.columns
    keep: list[str] = []
    drop: set[str] = set()

    def expand(item: str) -> list[str]:
        if item.startswith("contains:"):
            t = item[len("contains:"):].lower()
            return [c for c in cols if t in c.lower()]
        if ":" in item and not item.startswith("contains"):
            a, b = item.split(":", 1)
            i, j = cols.index(a), cols.index(b)
            return cols[min(i, j):max(i, j) + 1]
        if item not in cols:
            raise KeyError(item)
        return [item]

    only_minus = all(isinstance(s, str) and s.startswith("-") for s in spec)
    if only_minus:
        keep = list(cols)
    for s in spec:
        if s.startswith("-"):
            drop.update(expand(s[1:]))
        else:
            keep.extend(x for x in expand(s) if x not in keep)
    return [c for c in keep if c not in drop]


def cols(df: DataFrame, *spec) -> DataFrame:
    return df.select(*select_names(df, *spec))


def drop_cols(df: DataFrame, *spec) -> DataFrame:
    return df.drop(*select_names(df, *spec))


# ---------------------------------------------------------------- C8-C15
def dummies(df: DataFrame, col: str, levels: Iterable, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per level; missing -> 0."""
    prefix = prefix or col
    return df.withColumns({f"{prefix}{k}": F.when(F.col(col) == F.lit(k), 1).otherwise(0).cast("int")
                           for k in levels})


def recode(df: DataFrame, col: str, mapping: Mapping, default, out: str | None = None) -> DataFrame:
    """Many-to-one recode; any value not listed (missing included) -> default."""
    expr = None
    groups: dict = {}
    for src, dst in mapping.items():
        groups.setdefault(dst, []).append(src)
    for dst, srcs in groups.items():
        cond = F.col(col).isin(*srcs)
        expr = F.when(cond, F.lit(dst)) if expr is None else expr.when(cond, F.lit(dst))
    expr = F.lit(default) if expr is None else expr.otherwise(F.lit(default))
    return df.withColumn(out or col, expr)


def design(df: DataFrame, terms: Sequence[str], factors: Mapping[str, Sequence] | None = None) -> tuple[DataFrame, list[str]]:
    """C11: expand factor terms ('i.x') into dummies of all but the lowest level."""
    factors = dict(factors or {})
    names: list[str] = []
    for t in terms:
        if t.startswith("i."):
            v = t[2:]
            levels = list(factors[v]) if v in factors else sorted(
                r[0] for r in df.select(v).where(F.col(v).isNotNull()).distinct().limit(MAX_LEVELS + 1).collect())
            if len(levels) > MAX_LEVELS and v not in factors:
                raise ValueError(f"{v} has more than {MAX_LEVELS} levels; name them in `factors`")
            df = dummies(df, v, levels[1:], prefix=f"{v}_")
            names += [f"{v}_{k}" for k in levels[1:]]
        else:
            names.append(t)
    return df, names


def assign_if(df: DataFrame, col: str, expr, cond) -> DataFrame:
    """Replace col with expr where cond is true (null cond keeps old value)."""
    return df.withColumn(col, F.when(_c(cond), _c(expr) if not isinstance(expr, (int, float)) else F.lit(expr))
                         .otherwise(F.col(col)))


def interact(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    """Product column."""
    return df.withColumn(out or f"{a}_x_{b}", F.col(a) * F.col(b))


def relabel(df: DataFrame, col: str, mapping: Mapping, out: str | None = None, order_col: str | None = None) -> DataFrame:
    """C14: display labels for codes; optional display-order int column."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    df = df.withColumn(out or col, m[F.col(col)])
    if order_col:
        o = F.create_map(*[x for i, k in enumerate(mapping) for x in (F.lit(k), F.lit(i + 1))])
        df = df.withColumn(order_col, o[F.col(col)])
    return df


# ---------------------------------------------------------------- filters
def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """drop rows with any missing value in subset (NaN counts as missing)."""
    cond = None
    for c in subset:
        t = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, NumericType):
            t = t | F.isnan(F.col(c))
        cond = t if cond is None else (cond | t)
    return df if cond is None else df.filter(~cond)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """F4 helper: Spark keeps NaN apart from null; normalise at IO."""
    from pyspark.sql.types import DoubleType, FloatType
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)) for c in cols})


def on_integer_grid(col: str, start: int, stop: int, step: int = 1, scale: int = 1) -> Column:
    """membership in seq(start/scale, stop/scale, step/scale) tested on integers."""
    k = F.round(F.col(col) * F.lit(scale)).cast("long")
    exact = (F.abs(F.col(col) * F.lit(scale) - k) < F.lit(1e-9))
    return exact & (k >= start) & (k <= stop) & (((k - start) % step) == 0)


# ---------------------------------------------------------------- B1
def cut(df: DataFrame, col: str, breaks: Sequence[float], out: str | None = None,
        right: bool = False, codes: Sequence | None = None) -> DataFrame:
    """B1: interval codes for breaks; left-closed [a,b) by default; outside -> null."""
    codes = list(codes) if codes is not None else list(range(1, len(breaks)))
    x = F.col(col)
    expr = None
    for (lo, hi), code in zip(zip(breaks[:-1], breaks[1:]), codes):
        cond = ((x >= lo) & (x < hi)) if not right else ((x > lo) & (x <= hi))
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return df.withColumn(out or f"{col}_group", expr.cast("int"))


BP_BREAKS = (0, 50, 90, 95, 101)  # fixed value from the reference: percentile cut points

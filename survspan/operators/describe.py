"""Description and aggregation.

Exact quantiles never sort a column in one task: values are cut into global
quantile blocks, ranked with the blocked scan, and only the wanted ranks are
picked by an aggregate.  ``approx=True`` switches to ``percentile_approx``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scan import blocks_from_quantiles, materialize, ordered_scan


def _ranked(df: DataFrame, col: str, by: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Rows of (by..., x, rn, n): rank 1..n of non-null ``col`` within ``by``."""
    by = list(by)
    d = df.select(*by, F.col(col).cast("double").alias("_qx")).filter(F.col("_qx").isNotNull() & ~F.isnan("_qx"))
    # the projected column is checkpointed once: the quantile cuts and both
    # sides of the blocked rank scan read it instead of the input's lineage
    d = materialize(d)
    d = blocks_from_quantiles(d, "_qx", n_blocks)
    return ordered_scan(d, by, ["_qx"], row_number="_rn", count="_n")


def _rank_aggs(probs: Sequence[float], names: Sequence[str], rule: str):
    """Aggregates over a ranked frame (_qx, _rn, _n) picking the order statistics."""
    aggs, exprs = [], {}
    n, rn, x = F.col("_n"), F.col("_rn"), F.col("_qx")
    for p, nm in zip(probs, names):
        if rule == "linear":
            h = (n - 1) * F.lit(float(p)) + 1
            lo = F.floor(h)
            hi = F.least(lo + 1, n)
            aggs += [F.max(F.when(rn == lo, x)).alias(f"_lo_{nm}"), F.max(F.when(rn == hi, x)).alias(f"_hi_{nm}"),
                     F.max(h - lo).alias(f"_fr_{nm}")]
            exprs[nm] = F.col(f"_lo_{nm}") + F.col(f"_fr_{nm}") * (F.col(f"_hi_{nm}") - F.col(f"_lo_{nm}"))
        elif rule == "stata":
            pp = int(round(p * 100))  # whole percent
            np_ = n * F.lit(pp)
            whole = (np_ % 100) == 0
            i = F.floor(np_ / 100)
            ceil_i = F.floor((np_ + 99) / 100)
            a = F.when(whole, i).otherwise(ceil_i)
            b = F.when(whole, F.least(i + 1, n)).otherwise(ceil_i)
            aggs += [F.max(F.when(rn == a, x)).alias(f"_lo_{nm}"), F.max(F.when(rn == b, x)).alias(f"_hi_{nm}")]
            exprs[nm] = (F.col(f"_lo_{nm}") + F.col(f"_hi_{nm}")) / 2
        else:
            raise ValueError(rule)
    return aggs, exprs


def quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), rule: str = "linear",
              names: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Quantiles per group; rule 'linear' = R type 7 / DuckDB quantile_cont,
    'stata' = mean of x(i), x(i+1) when i = n p is whole, else x(ceil i)."""
    by = list(by)
    names = list(names) if names else [f"q{int(round(p * 1000)):03d}" for p in probs]
    if approx:
        arr = F.percentile_approx(F.col(col), list(probs), 10000)
        out = df.groupBy(*by).agg(arr.alias("_qa"))
        return out.select(*by, *[F.col("_qa")[i].alias(nm) for i, nm in enumerate(names)])
    r = _ranked(df, col, by)
    aggs, exprs = _rank_aggs(probs, names, rule)
    g = r.groupBy(*by).agg(*aggs)
    return g.select(*by, *[e.alias(nm) for nm, e in exprs.items()])


def describe_quantiles(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """A1: min, 25 %, median, 75 %, max."""
    q = quantiles(df, col, [0.0, 0.25, 0.5, 0.75, 1.0], by, names=["min", "q25", "median", "q75", "max"])
    return q


def summarize_detail(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """N, mean, sd, variance, skewness, kurtosis (not excess), percentiles
    1..99 by the Stata rule, 4 smallest and 4 largest values: one ranked pass,
    one aggregate."""
    by = list(by)
    pcts = [1, 5, 10, 25, 50, 75, 90, 95, 99]
    r = _ranked(df, col, by)
    aggs, exprs = _rank_aggs([p / 100 for p in pcts], [f"p{p}" for p in pcts], "stata")
    x, rn, n = F.col("_qx"), F.col("_rn"), F.col("_n")
    aggs += [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
             F.var_samp(x).alias("variance"), F.skewness(x).alias("skewness"),
             (F.kurtosis(x) + F.lit(3.0)).alias("kurtosis")]
    aggs += [F.max(F.when(rn == k, x)).alias(f"smallest_{k}") for k in (1, 2, 3, 4)]
    aggs += [F.max(F.when(rn == n - (k - 1), x)).alias(f"largest_{k}") for k in (1, 2, 3, 4)]
    g = r.groupBy(*by).agg(*aggs)
    return g.select(*by, "n", "mean", "sd", "variance", "skewness", "kurtosis",
                    *[e.alias(nm) for nm, e in exprs.items()],
                    *[f"smallest_{k}" for k in (1, 2, 3, 4)], *[f"largest_{k}" for k in (1, 2, 3, 4)])


def person_years(df: DataFrame, start: str, stop: str, event: str, by: Sequence[str] = (), scale: float = 1.0) -> DataFrame:
    """A2: person-time, events, records and rate per group (map-side partial aggregation)."""
    return df.groupBy(*by).agg(
        (F.sum(F.col(stop) - F.col(start)) / F.lit(scale)).alias("person_time"),
        F.sum(F.col(event)).cast("long").alias("events"),
        F.count(F.lit(1)).alias("records"),
    ).withColumn("rate", F.try_divide(F.col("events"), F.col("person_time")))


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """A5: two-way counts with column percents (window over the small count table)."""
    from pyspark.sql import Window
    c = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("col_pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(col)))


def crosstab_wide(df: DataFrame, row: str, col: str, levels) -> DataFrame:
    """A5 wide: one row per ``row`` value, one count column per listed ``col`` level
    (pivot with the levels given, so no extra pass discovers them)."""
    return df.groupBy(row).pivot(col, list(levels)).agg(F.count(F.lit(1))) \
        .select(row, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("long").alias(f"{col}_{v}") for v in levels])


def band(df: DataFrame, cols: Sequence[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Per-column lo/hi quantiles skipping missing; one blocked scan for all columns."""
    long = unpivot(df.select(*cols), [], cols, "name", "value")
    return quantiles(long, "value", [lo, hi], ["name"], names=["lo", "hi"])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "name", val: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)


def missing_report(df: DataFrame, col: str, last_rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with missing ``col``, distinct subjects with one, subjects whose last row has one."""
    a = df.agg(F.count_if(F.col(col).isNull()).alias("rows_missing"),
               F.count_distinct(F.when(F.col(col).isNull(), F.col(id_col))).alias("subjects_missing"),
               F.count_distinct(F.col(id_col)).alias("subjects"), F.count(F.lit(1)).alias("rows"))
    b = last_rows.agg(F.count_if(F.col(col).isNull()).alias("last_row_missing"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def event_share(last_rows: DataFrame, event: str) -> DataFrame:
    """A3: share of subjects whose last row has the event."""
    return last_rows.agg(F.count(F.lit(1)).alias("subjects"), F.sum(F.col(event)).cast("long").alias("events"),
                         F.avg(F.col(event).cast("double")).alias("share"))

"""Blank-delimited headerless text tables (IO1) and table sinks (IO2, IO4).

Spark's CSV reader cannot collapse runs of blanks, so lines are read as text
and split on ``\\s+``.  Lines with a wrong field count are kept aside and
counted, not silently dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Return (rows, bad_lines).  All fields are strings; use clean.null_token / to_numeric next."""
    names = list(names)
    lines = spark.read.text(path)
    parts = lines.select(F.col("value").alias("_line"),
                         F.split(F.trim(F.col("value")), r"\s+").alias("_f"))
    parts = parts.filter(F.length(F.trim("_line")) > 0)
    ok = F.size("_f") == len(names)
    rows = parts.filter(ok).select(*[F.col("_f").getItem(i).alias(n) for i, n in enumerate(names)])
    bad = parts.filter(~ok).select(F.col("_line").alias("line"), F.size("_f").alias("n_fields"))
    return rows, bad


def write_table(df: DataFrame, path: str, mode: str = "errorifexists",
                partition_by: Sequence[str] | None = None) -> None:
    """Parquet sink; column labels/levels travel in the field metadata.

    Never overwrite the path the frame is read from: write to a new path.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach a text label to each named column (kept by Parquet)."""
    for c, text in labels.items():
        meta = dict(df.schema[c].metadata)
        meta["label"] = text
        df = df.withMetadata(c, meta)
    return df

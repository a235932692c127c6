"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# A word is a run of characters other than space and U+0009 to U+000D.
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder: short lineage, no copy tied to one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on, beside the workers of the next stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not a GNU C library
        pass


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body is itself a lambda."""
    return F.transform(F.array(value), body)[0]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def blocks(total: int, rows_per_block: int) -> int:
    """As many blocks as keep each near rows_per_block; grows with the data, 1 at least."""
    return max(1, -(-int(total) // rows_per_block))


def numbered(df: DataFrame, group: str, block: str, order: list, name: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order (block, *order).

    Rows are numbered inside (group, block); the few counts per block give each
    block its start. No task holds a whole group.
    """
    counts = df.groupBy(group, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col(block).alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, block).orderBy(*order)
    rows = df.withColumn("_i", F.row_number().over(inside))
    return (rows.join(starts, rows[group].eqNullSafe(starts["_g"]) & rows[block].eqNullSafe(starts["_b"]))
            .withColumn(name, (F.col("_start") + F.col("_i") - 1).cast("long"))
            .drop("_g", "_b", "_start", "_i"))

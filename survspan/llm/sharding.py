"""Sharding by vector bin packing.

Equal texts form a group with a vector (bytes, tokens, rows). Every group goes to
the shard where the dot product of its vector with the shard's residual capacity
is highest, the largest first. A group larger than 1/`CUT_ABOVE` of a shard is
cut by a hash of doc_id into items that each weigh little, so a text with a
third of all copies spreads over all shards.

Items larger than 1/`BIG_ABOVE` of a shard, of which there are at most
3 * shards * BIG_ABOVE, are placed together first. The others are dealt at random into
parts of about `ITEMS_PER_PART`, and each part fills its share of the room that the
big ones left. So every shard ends near equal in bytes, tokens and rows, and no
task holds more than one part.

Defined cases: a null text is empty; a null doc_id is a value like any other; repeated rows
are rows of their own; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable, n_words, numbered, text_or_empty

SHARDS = 40
ROW_BYTES = 16
CUT_ABOVE = 4
BIG_ABOVE = 256
CUTS = 4096
ITEMS_PER_PART = 20_000
ROWS_PER_BLOCK = 50_000


def place(sizes: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shard of every item: the highest dot product with the residual capacity, largest items first.

    sizes: items x dimensions; room: shards x dimensions, in any unit; the items' totals are scaled to it.
    """
    share = room / np.maximum(room.sum(axis=0), 1e-12)
    vectors = sizes / np.maximum(sizes.sum(axis=0), 1.0)
    residual = share.copy()
    out = np.zeros(len(sizes), np.int32)
    for i in np.lexsort((np.arange(len(sizes)), -vectors.sum(axis=1))):
        out[i] = s = int(np.argmax(residual @ vectors[i]))
        residual[s] -= vectors[i]
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tokens and shard of every row."""
    ship_code(docs.sparkSession)
    text = text_or_empty()
    rows = durable(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), n_words(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(CUTS)).cast("int").alias("_cut")))
    sums = [F.sum(c).alias(c) for c in ("size", "tokens", "rows")]
    # Partial sums by (text, cut) first: no text gathers its rows.
    cuts = durable(rows.withColumn("rows", F.lit(1)).groupBy("_text", "_cut").agg(*sums))
    groups = cuts.groupBy("_text").agg(*sums)
    total = [int(t or 0) for t in groups.agg(F.sum("size"), F.sum("tokens"), F.sum("rows")).first()]

    def above(part):
        return F.greatest(*[F.col(c) * F.lit(float(shards * part)) / F.lit(max(1, t))
                            for c, t in zip(("size", "tokens", "rows"), total)]) > 1

    # A single row cannot be cut. At most 3 * shards * CUT_ABOVE texts are: small enough to broadcast at any scale.
    cut = F.broadcast(durable(groups.where(above(CUT_ABOVE) & (F.col("rows") > 1)).select("_text", F.lit(True).alias("_is_cut"))))

    def items(df):
        return df.join(cut, "_text", "left").withColumn("_cut", F.when(F.col("_is_cut"), F.col("_cut")).otherwise(-1)).drop("_is_cut")

    vectors = durable(items(cuts).groupBy("_text", "_cut").agg(*sums).withColumn("_big", above(BIG_ABOVE)))
    parts = blocks(vectors.count(), ITEMS_PER_PART)
    schema = "_text long, _cut int, size double, tokens double, rows double, shard int"

    def placing(room):
        def place_part(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["_text", "_cut"], ignore_index=True)
            sizes = part[["size", "tokens", "rows"]].to_numpy(float)
            return part[["_text", "_cut", "size", "tokens", "rows"]].assign(shard=place(sizes, room))
        return place_part

    capacity = np.maximum(np.array(total, float), 1.0) / shards
    big = durable(vectors.where("_big").withColumn("_part", F.lit(0)).groupBy("_part").applyInPandas(placing(np.tile(capacity, (shards, 1))), schema))
    room = np.tile(capacity, (shards, 1))
    for r in big.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.sum("rows")).collect():  # a row per shard
        room[r[0]] = np.maximum(room[r[0]] - np.array(r[1:], float), 0.0)
    small = (vectors.where(~F.col("_big")).withColumn("_part", F.pmod(F.xxhash64("_text", "_cut"), F.lit(parts)))
             .groupBy("_part").applyInPandas(placing(room), schema))
    placed = big.unionByName(small).select("_text", "_cut", "shard")
    return items(rows).join(placed, ["_text", "_cut"])


def op2_sharding(docs: DataFrame) -> DataFrame:
    rows = durable(sharded(docs))
    per_shard = blocks(rows.count(), ROWS_PER_BLOCK * SHARDS)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(per_shard)))
    return numbered(dealt, "shard", "_block", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")

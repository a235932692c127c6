"""Exact top-k inner products with vector-approximation files.

Every component is quantised to one of 2^BITS cells of its dimension. The scan
of the cells alone bounds each score from above and below. Exact vectors are
then read in the order of their upper bounds (the largest possible score, that is the
smallest possible distance, first) until the k-th best exact score exceeds the
next bound, so that no vector that could still enter is left unread. The grid is fitted
on the whole table's extremes per dimension: 2 numbers each.

Queries and candidates meet in blocks: a block of queries is sent to every block
of candidates, each pair of blocks returns k rows per query at most, and these
are merged per query in bounded groups.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty
or shorter vector counts as padded with zeros; repeated rows stay rows of their own, as queries and as
candidates, also where they share a vec_id, and only a query's own row is left out; ties go to the smaller vec_id, a
null one last; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable

SCALE = 1024
BITS = 6
QUERY_BLOCK = 256
VECTOR_BLOCK = 8192
LAST = (1 << 63) - 1  # stands for a null vec_id in orders
SPREAD = 16  # partial top-k lists of a query are merged in so many groups first


def integers(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): floor(1024 * x) per component, of the rows that take part; row tells repeated rows apart."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id",
                    F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("v")))


def grid(ints: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lowest value and cell width per dimension."""
    ext = (ints.select(F.posexplode("v").alias("d", "x")).groupBy("d")
           .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect())
    lo = np.array([min(0, r["lo"]) for r in ext], np.int64)  # 0 is inside, for padding
    hi = np.array([max(0, r["hi"]) for r in ext], np.int64)
    return lo, np.maximum(1, -(-(hi - lo + 1) // (1 << BITS)))


def _matrix(rows, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through floats where these are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ c.T.astype(float)).astype(np.int64) if most < 2.0 ** 53 else q @ c.T


def search_block(qrow, q, crow, cid, c, cells, lo, width, k):
    """(query, candidate, score) by place: the k best of the candidates for each query; cells bound, then exact reads."""
    low = (lo + cells * width).astype(float)
    high = low + (width - 1)
    plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
    upper = plus @ high.T + minus @ low.T
    lower = plus @ low.T + minus @ high.T
    own = qrow[:, None] == crow[None, :]
    upper[own], lower[own] = -np.inf, -np.inf
    out = []
    for i in range(len(q)):
        n = min(k, int((~own[i]).sum()))
        if not n:
            continue
        # Cell scan: only candidates whose upper bound reaches the k-th lower bound can matter.
        floor = np.partition(lower[i], len(cid) - n)[len(cid) - n]
        left = np.flatnonzero((upper[i] >= floor - 1.0) & ~own[i])
        left = left[np.argsort(-upper[i][left], kind="stable")]
        read, scores = left[:0], np.zeros(0, np.int64)
        step = max(4 * k, 64)
        for at in range(0, len(left), step):
            some = left[at:at + step]
            read, scores = np.concatenate([read, some]), np.concatenate([scores, _scores(q[i:i + 1], c[some])[0]])
            if len(read) >= n and at + step < len(left):
                kth = np.partition(scores, len(scores) - n)[len(scores) - n]
                if upper[i][left[at + step]] < kth - 1.0:
                    break
        best = np.lexsort((cid[read], -scores))[:n]
        out += [(i, int(read[j]), int(scores[j])) for j in best]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: every query's k highest scores among all rows but its own.

    rows: a materialised table of (row, vec_id, v) by integers(); queries: some of its rows."""
    ship_code(rows.sparkSession)
    lo, width = grid(rows.select("v"))
    dims = len(lo)
    n_c, n_q = blocks(rows.count(), VECTOR_BLOCK), blocks(queries.count(), QUERY_BLOCK)
    cand = rows.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(n_c))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    query = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")).withColumn(
        "qb", F.pmod(F.xxhash64("query_row"), F.lit(n_q)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<long>")))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_row", "query_id", "row", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in names})
        cid = right["vec_id"].astype("Int64")
        q, c = _matrix(left["q"], dims), _matrix(right["v"], dims)
        qrow, crow = left["query_row"].to_numpy(), right["row"].to_numpy()
        found = search_block(qrow, q, crow, cid.fillna(LAST).to_numpy(np.int64), c, (c - lo) // width, lo, width, k)
        i, j = [x[0] for x in found], [x[1] for x in found]
        return pd.DataFrame({"query_row": qrow[i], "query_id": left["query_id"].to_numpy()[i], "row": crow[j],
                             "vec_id": cid.array[j], "score": [x[2] for x in found]}, columns=names)

    near = query.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb")).applyInPandas(
        meet, "query_row long, query_id long, row long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"]
    first = Window.partitionBy("query_row", "_s").orderBy(*order)
    few = (near.withColumn("_s", F.pmod(F.xxhash64("row"), F.lit(SPREAD)))
           .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(*order)))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_exact_topk(vectors: DataFrame) -> DataFrame:
    """Queries: vectors whose id is divisible by 100."""
    rows = durable(integers(vectors))
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid AS qrid, c.rid AS crid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(
           list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(c.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id NULLS LAST, crid) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

"""Hard negatives by Kronecker-packed integer products.

Components become integers and are biased to be non-negative. Several candidates'
biased components of one dimension go into separated fields of one wide integer, so that one
multiplication by an anchor's biased component scores all of them at once; after summing over the
dimensions each field holds one candidate's biased product, and the exact score is that minus
what the bias added, which row sums give. The fields' width comes from the extremes of all components. Where
two or more fields fit in 53 bits, the wide integers are doubles, exact in that range, and the
products are one matrix product; beyond that they are integers of any length with 64-bit
(or wider) fields, unpacked modulo 2^64.

Anchors and candidates meet in blocks of bounded size: a first pass keeps each anchor's best rows of its own label, a
second its best rows of other labels within the band of each of those. Within a pair
of blocks only the labels asked for are multiplied, so the two passes together score each pair once.
Partial lists are merged in bounded groups.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; an
empty or shorter vector counts as padded with zeros; repeated rows are rows of their own, also where
they share a vec_id; a null vec_id is no anchor, its label stays, and it comes last among ties; an anchor
without positives or without negatives in the band has no rows; an empty table gives an empty result.
Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOWEST = 50  # a negative's score lies between these hundredths of the positive's
HIGHEST = 95
ANCHOR_BLOCK = 2048
VECTOR_BLOCK = 16384
SCORES_AT_ONCE = 1 << 21
MERGED = 20_000  # rows of partial lists that one task merges
EXACT_BITS = 53
LAST = (1 << 63) - 1  # stands for a null vec_id in orders


class Packing:
    """How many fields of which width a wide integer gets, from the components' extremes."""

    def __init__(self, lowest: int, highest: int, dims: int):
        self.low, self.dims = min(0, lowest), dims
        most = dims * (max(0, highest) - self.low) ** 2
        self.width = max(1, most.bit_length())
        self.fields = EXACT_BITS // self.width
        self.doubles = self.fields >= 2
        if not self.doubles:
            self.width, self.fields = -(-self.width // 64) * 64, 64

    def _packed(self, biased: np.ndarray) -> np.ndarray:
        """One wide integer per group of candidates and dimension: (groups, dims)."""
        n = len(biased)
        groups = -(-n // self.fields)
        whole = np.zeros((groups * self.fields, self.dims), np.int64)
        whole[:n] = biased
        whole = whole.reshape(groups, self.fields, self.dims)
        if self.doubles:
            return (whole << (self.width * np.arange(self.fields))[None, :, None]).sum(1).astype(float)
        out = np.zeros((groups, self.dims), object)
        for f in range(self.fields):
            out += whole[:, f].astype(object) << (self.width * f)
        return out

    def _unpacked(self, wide: np.ndarray, n: int) -> np.ndarray:
        """The fields of (anchors, groups), one column per candidate."""
        if self.doubles:
            wide = wide.astype(np.int64)
            out = np.empty((*wide.shape, self.fields), np.int64)
            for f in range(self.fields):
                out[:, :, f] = (wide >> (self.width * f)) & ((1 << self.width) - 1)
        else:
            size = self.width // 8 * self.fields
            raw = b"".join(x.to_bytes(size, "little") for x in wide.ravel().tolist())
            out = np.frombuffer(raw, "<u8").reshape(*wide.shape, self.fields, -1)[..., 0].view(np.int64)
        return out.reshape(len(wide), -1)[:, :n]

    def scores(self, anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Exact inner products of integer rows, (anchors, candidates)."""
        if not self.dims or not len(candidates):
            return np.zeros((len(anchors), len(candidates)), np.int64)
        a, c = anchors - self.low, candidates - self.low
        if not self.doubles:
            wide = a.astype(object) @ self._packed(c).T
        else:
            wide = a.astype(float) @ self._packed(c).T
        with np.errstate(over="ignore"):
            biased = self._unpacked(wide, len(c))
            return (biased + self.low * a.sum(1)[:, None] + self.low * c.sum(1)[None, :]
                    + np.int64(((self.dims * self.low * self.low) + (1 << 63)) % (1 << 64) - (1 << 63)))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Block:
    """Rows of one table of a pair of blocks, by label, then by vec_id with nulls last."""

    def __init__(self, table: pa.Table, dims: int):
        ids = table.column("vec_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(LAST).to_numpy()
        label = table.column("label").to_numpy()
        order = np.lexsort((null, ids, label))
        self.ids, self.null, self.label = ids[order], null[order], label[order]
        self.row = table.column("row").to_numpy()[order]
        self.order = order
        self.v = _matrix(table.column("v"), dims)[order]

    def slices(self):
        """(label, first row, row after the last)."""
        names, begin = np.unique(self.label, return_index=True)
        return zip(names.tolist(), begin.tolist(), [*begin[1:].tolist(), len(self.label)])


def _best(scores: np.ndarray, k: int):
    """(anchor row, column, score) of each row's k highest, the leftmost of equal ones; None where masked."""
    lowest = np.iinfo(np.int64).min
    rows = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        top = scores[rows, at]
        good = top != lowest
        if not good.any():
            return
        yield rows[good], at[good], top[good]
        scores[rows, at] = lowest


def _chunks(packing: Packing, anchors: np.ndarray, candidates: Block, begin: int, end: int):
    step = max(64, SCORES_AT_ONCE // max(1, len(anchors)))
    for a in range(begin, end, step):
        b = min(a + step, end)
        yield a, packing.scores(anchors, candidates.v[a:b])


def near_own_label(packing: Packing, anchors: Block, candidates: Block, k: int):
    """(anchor row number, candidate, score): each anchor's k best rows of its label, without itself."""
    own = {name: (a, b) for name, a, b in anchors.slices()}
    for name, begin, end in candidates.slices():
        if name not in own:
            continue
        a, b = own[name]
        for at, scores in _chunks(packing, anchors.v[a:b], candidates, begin, end):
            lowest = np.iinfo(np.int64).min
            scores[anchors.row[a:b, None] == candidates.row[None, at:at + scores.shape[1]]] = lowest
            for i, j, s in _best(scores, k):
                yield a + i, at + j, s


def near_other_labels(packing: Packing, anchors: Block, candidates: Block, bands: list, k: int):
    """(anchor row number, band's positive score, candidate, score): the k best of other labels in each band."""
    most = max(map(len, bands), default=0)
    low = np.ones((len(bands), most), np.int64)
    high, of = np.zeros_like(low), np.zeros_like(low)
    for i, positive in enumerate(bands):
        for j, s in enumerate(positive):
            of[i, j], low[i, j], high[i, j] = s, -(-LOWEST * s // 100), HIGHEST * s // 100
    lowest = np.iinfo(np.int64).min
    for name, begin, end in candidates.slices():
        others = np.flatnonzero(anchors.label != name)
        if not len(others):
            continue
        for at, scores in _chunks(packing, anchors.v[others], candidates, begin, end):
            for j in range(most):
                inside = (scores >= low[others, j, None]) & (scores <= high[others, j, None])
                some = np.flatnonzero(inside.any(1))
                if len(some):
                    for i, c, s in _best(np.where(inside[some], scores[some], lowest), k):
                        at_row = others[some[i]]
                        yield at_row, of[at_row, j], at + c, s


def rows_taking_part(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, v): floor(scale * x) per component; row tells repeated rows apart."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", label.cast("long").alias("label"),
                    F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")))


def _merged(df: DataFrame, keys: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each key by (score descending, id); long keys are cut down in rounds of bounded groups."""
    order = [F.col("score").desc(), F.col("other_id").asc_nulls_last(), "other_row"]
    # Every block adds k rows to a key at most: partial lists of the blocks are merged in groups by their block.
    few = Window.partitionBy(*keys, "part").orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k).drop("_r")
    return (df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col(rank) <= k).drop("part"))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: a materialised table of (row, vec_id, label, v); anchors: some of its rows.
    """
    ship_code(rows.sparkSession)
    anchors = anchors.toDF(*anchors.columns)  # columns of their own, for the joins with rows
    ext = rows.select(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"),
                      F.max(F.size("v")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    packing = Packing(ext["lo"] or 0, ext["hi"] or 0, ext["d"] or 0)
    n_c, n_a = blocks(ext["n"], VECTOR_BLOCK), blocks(anchors.count(), ANCHOR_BLOCK)
    parts = blocks(n_c * negatives, MERGED)

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = (rows.withColumn("cb", F.pmod(F.xxhash64("row"), F.lit(n_c)).cast("int"))
                  .withColumn("ab", all_of(n_a)))
    asked = (anchors.withColumn("ab", F.pmod(F.xxhash64("row"), F.lit(n_a)).cast("int"))
             .withColumn("cb", all_of(n_c)))
    dims = packing.dims

    def found(anchor: Block, candidate: Block, i, j, s, key, extra=None) -> pa.Table:
        i, j, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j, s))
        cols = {"anchor_row": anchor.row[i], "anchor_id": anchor.ids[i]}
        if extra is not None:
            cols["positive_score"] = np.concatenate(extra) if extra else np.zeros(0, np.int64)
        cols |= {"other_row": candidate.row[j], "score": s, "part": np.full(len(i), key[1].as_py() % parts, np.int32)}
        cols = {name: pa.array(x) for name, x in cols.items()}
        cols["other_id"] = pa.array(candidate.ids[j], mask=candidate.null[j])
        return pa.table(cols)

    def own_label(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, c, out = Block(left, dims), Block(right, dims), ([], [], [])
        for got in near_own_label(packing, a, c, positives):
            for to, x in zip(out, got):
                to.append(x)
        return found(a, c, *out, key)

    def other_labels(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, c, out, of = Block(left, dims), Block(right, dims), ([], [], []), []
        bands = left.column("bands").to_pylist()
        for i, band, j, s in near_other_labels(packing, a, c, [bands[x] for x in a.order], negatives):
            of.append(band)
            for to, x in zip(out, (i, j, s)):
                to.append(x)
        return found(a, c, *out, key, of)

    kinds = "anchor_row long, anchor_id long, other_row long, score long, part int, other_id long"
    near = asked.groupBy("ab", "cb").cogroup(candidates.groupBy("ab", "cb")).applyInArrow(own_label, kinds)
    best = durable(_merged(near, ["anchor_row", "anchor_id"], positives))
    # A band starts and ends with its positive's score: positives of one score share a band, and one below 0 has none.
    bands = (best.where(F.col("score") >= 0).groupBy(F.col("anchor_row").alias("row"))
             .agg(F.collect_set("score").alias("bands")))
    with_bands = anchors.join(bands, "row").withColumn(
        "ab", F.pmod(F.xxhash64("row"), F.lit(n_a)).cast("int")).withColumn("cb", all_of(n_c))
    kinds = "anchor_row long, anchor_id long, positive_score long, other_row long, score long, part int, other_id long"
    far = with_bands.groupBy("ab", "cb").cogroup(candidates.groupBy("ab", "cb")).applyInArrow(other_labels, kinds)
    hard = _merged(far, ["anchor_row", "positive_score"], negatives).select(
        "anchor_row", "positive_score", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = best.select("anchor_row", "anchor_id", F.col("other_id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return pairs.join(hard, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(vectors: DataFrame) -> DataFrame:
    """Anchors: rows whose vec_id is divisible by 50; where it is divisible by 7, the label is another one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = durable(rows_taking_part(vectors, label))
    return mine(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, c.rid AS crid, c.vec_id AS vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST, crid) AS r
                 FROM s WHERE same) t WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.arid, p.crid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.crid) AS INTEGER) AS rank
  FROM p JOIN s ON p.arid = s.arid AND NOT s.same
  WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

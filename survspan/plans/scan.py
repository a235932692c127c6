"""Skew-safe ordered scans within groups.

Every per-subject operator of the reference (visit numbers, lag/lead, fill
down/up, running sums, first/last row, subject totals) is an ordered scan
inside a group.  A plain ``Window.partitionBy(key)`` puts a whole group into
one task, so one subject (or one stratum of a Kaplan-Meier curve) holding a
third of all rows would run in a single task.

Here every row carries a *block* number that is monotone in the order within
its group.  Work happens in three steps:

1. a window over ``(key, block)`` computes the local scan (bounded size);
2. a ``groupBy(key, block)`` gives one summary row per block (map-side
   partial aggregation, no skew);
3. a window over the small block table (``partitionBy(key).orderBy(block)``)
   turns block summaries into carries (offsets, previous last row, next first
   row, last non-null so far ...), joined back on ``(key, block)``.

The join key ``(key, block)`` keeps hot groups split, and the big side keeps
the hash partitioning of step 1, so chained scans on the same frame reuse one
exchange.  The block table holds one row per non-empty block, i.e. about one
row per group for normal groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP = Window.unboundedPreceding
UF = Window.unboundedFollowing

BLOCK = "_blk"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _orders(order: Sequence) -> list[Column]:
    return [_c(o) for o in order]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    block: str = BLOCK,
    *,
    row_number: str | None = None,
    count: str | None = None,
    cumsum: Mapping[str, object] | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    fill_down: Mapping[str, str] | None = None,
    fill_up: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    total: Mapping[str, object] | None = None,
    maximum: Mapping[str, object] | None = None,
    minimum: Mapping[str, object] | None = None,
    checkpoint: bool = False,
) -> DataFrame:
    """Add scan columns to ``df``; ``order`` must be unique within ``keys``.

    row_number  1..n in order                 count    rows in the group
    cumsum      inclusive running sum          lag/lead previous/next row value
    fill_down   last non-null at or before     fill_up  first non-null at or after
    first/last  value on the group's first/last row (nulls kept)
    total/maximum/minimum  group aggregates broadcast to every row

    When the block column says no group is hot (a statistic checked when the
    blocks were assigned) the scan is one plain window pass over the group.
    Otherwise the blocked three-step plan runs; ``checkpoint=True`` writes its
    result to the session's checkpoint folder so long chains of scans keep a
    short lineage (the blocked plan reads its input twice).
    """
    cumsum = dict(cumsum or {})
    lag, lead = dict(lag or {}), dict(lead or {})
    fill_down, fill_up = dict(fill_down or {}), dict(fill_up or {})
    first, last = dict(first or {}), dict(last or {})
    total, maximum, minimum = dict(total or {}), dict(maximum or {}), dict(minimum or {})

    keys = list(keys)
    ords = _orders(order)
    if not is_hot(df, block):
        return _plain_scan(df, keys, ords, row_number=row_number, count=count, cumsum=cumsum, lag=lag,
                           lead=lead, fill_down=fill_down, fill_up=fill_up, first=first, last=last,
                           total=total, maximum=maximum, minimum=minimum)
    kb = keys + [block]
    onames = [f"_o{i}" for i in range(len(ords))]
    wl = Window.partitionBy(*kb).orderBy(*ords)

    # 1. local scan inside (key, block)
    loc = {"_rl": F.row_number().over(wl)}
    for n, c in cumsum.items():
        loc[f"_cs_{n}"] = F.sum(_c(c)).over(wl.rowsBetween(UP, 0))
    for n, c in lag.items():
        loc[f"_lg_{n}"] = F.lag(_c(c)).over(wl)
    for n, c in lead.items():
        loc[f"_ld_{n}"] = F.lead(_c(c)).over(wl)
    for n, c in fill_down.items():
        loc[f"_fd_{n}"] = F.last(_c(c), ignorenulls=True).over(wl.rowsBetween(UP, 0))
    for n, c in fill_up.items():
        loc[f"_fu_{n}"] = F.first(_c(c), ignorenulls=True).over(wl.rowsBetween(0, UF))
    d1 = df.withColumns(loc)

    # 2. one summary row per (key, block)
    ostruct = [o.alias(nm) for o, nm in zip(ords, onames)]
    aggs = [F.count(F.lit(1)).alias("_bn")]
    head_cols = {**{f"l_{n}": _c(c) for n, c in lead.items()}, **{f"f_{n}": _c(c) for n, c in first.items()}}
    tail_cols = {**{f"g_{n}": _c(c) for n, c in lag.items()}, **{f"t_{n}": _c(c) for n, c in last.items()}}
    if head_cols:
        aggs.append(F.min(F.struct(*ostruct, *[c.alias(n) for n, c in head_cols.items()])).alias("_bf"))
    if tail_cols:
        aggs.append(F.max(F.struct(*ostruct, *[c.alias(n) for n, c in tail_cols.items()])).alias("_bl"))
    for n, c in cumsum.items():
        aggs.append(F.sum(_c(c)).alias(f"_bs_{n}"))
    for n, c in fill_down.items():
        aggs.append(F.max(F.when(_c(c).isNotNull(), F.struct(*ostruct, _c(c).alias("v")))).alias(f"_bd_{n}"))
    for n, c in fill_up.items():
        aggs.append(F.min(F.when(_c(c).isNotNull(), F.struct(*ostruct, _c(c).alias("v")))).alias(f"_bu_{n}"))
    for n, c in total.items():
        aggs.append(F.sum(_c(c)).alias(f"_bt_{n}"))
    for n, c in maximum.items():
        aggs.append(F.max(_c(c)).alias(f"_bx_{n}"))
    for n, c in minimum.items():
        aggs.append(F.min(_c(c)).alias(f"_bm_{n}"))
    blocks = d1.groupBy(*kb).agg(*aggs)

    # 3. carries over the small block table
    part = keys if keys else [F.lit(0)]
    wk = Window.partitionBy(*part).orderBy(block)
    wall = Window.partitionBy(*part)
    car = {"_off": F.coalesce(F.sum("_bn").over(wk.rowsBetween(UP, -1)), F.lit(0))}
    if count:
        car["_cnt"] = F.sum("_bn").over(wall)
    for n in cumsum:
        car[f"_co_{n}"] = F.sum(f"_bs_{n}").over(wk.rowsBetween(UP, -1))
    if lead:
        car["_nf"] = F.lead("_bf").over(wk)
    if lag:
        car["_pl"] = F.lag("_bl").over(wk)
    if first:
        car["_gf"] = F.first("_bf").over(wk.rowsBetween(UP, UF))
    if last:
        car["_gl"] = F.last("_bl").over(wk.rowsBetween(UP, UF))
    for n in fill_down:
        car[f"_cd_{n}"] = F.last(f"_bd_{n}", ignorenulls=True).over(wk.rowsBetween(UP, -1))
    for n in fill_up:
        car[f"_cu_{n}"] = F.first(f"_bu_{n}", ignorenulls=True).over(wk.rowsBetween(1, UF))
    for n in total:
        car[f"_gt_{n}"] = F.sum(f"_bt_{n}").over(wall)
    for n in maximum:
        car[f"_gx_{n}"] = F.max(f"_bx_{n}").over(wall)
    for n in minimum:
        car[f"_gm_{n}"] = F.min(f"_bm_{n}").over(wall)
    carries = blocks.withColumns(car).select(*kb, "_bn", *car.keys())

    # join back on (key, block); keys may be null -> null-safe equality
    right = carries.select(*[F.col(k).alias(f"_k_{k}") for k in kb],
                           *[c for c in carries.columns if c not in kb])
    cond = [d1[k].eqNullSafe(right[f"_k_{k}"]) for k in kb]
    j = d1.join(right, on=cond, how="inner")

    out = {}
    if row_number:
        out[row_number] = (F.col("_off") + F.col("_rl")).cast("int")
    if count:
        out[count] = F.col("_cnt").cast("long")
    for n in cumsum:
        loc_s, off_s = F.col(f"_cs_{n}"), F.col(f"_co_{n}")
        out[n] = F.when(loc_s.isNull() & off_s.isNull(), F.lit(None)) \
            .otherwise(F.coalesce(loc_s, F.lit(0)) + F.coalesce(off_s, F.lit(0)))
    last_in_block = F.col("_rl") == F.col("_bn")
    for n in lead:
        out[n] = F.when(last_in_block, F.col("_nf").getField(f"l_{n}")).otherwise(F.col(f"_ld_{n}"))
    for n in lag:
        out[n] = F.when(F.col("_rl") == 1, F.col("_pl").getField(f"g_{n}")).otherwise(F.col(f"_lg_{n}"))
    for n in fill_down:
        out[n] = F.coalesce(F.col(f"_fd_{n}"), F.col(f"_cd_{n}").getField("v"))
    for n in fill_up:
        out[n] = F.coalesce(F.col(f"_fu_{n}"), F.col(f"_cu_{n}").getField("v"))
    for n in first:
        out[n] = F.col("_gf").getField(f"f_{n}")
    for n in last:
        out[n] = F.col("_gl").getField(f"t_{n}")
    for n in total:
        out[n] = F.col(f"_gt_{n}")
    for n in maximum:
        out[n] = F.col(f"_gx_{n}")
    for n in minimum:
        out[n] = F.col(f"_gm_{n}")

    keep = [c for c in df.columns if c not in out]
    res = j.select(*[d1[c] for c in keep], *[e.alias(n) for n, e in out.items()])
    return materialize(res) if checkpoint else res


HOT_KEY = "survspan.hot"
SPLITS_KEY = "survspan.splits"


def is_hot(df: DataFrame, block: str) -> bool:
    if block not in df.columns:
        raise KeyError(f"block column {block} missing")
    return bool(df.schema[block].metadata.get(HOT_KEY, True))


def mark_blocks(df: DataFrame, hot: bool, block: str = BLOCK) -> DataFrame:
    meta = dict(df.schema[block].metadata)
    meta[HOT_KEY] = bool(hot)
    return df.withMetadata(block, meta)


def materialize(df: DataFrame, spread: bool = False) -> DataFrame:
    """Reliable checkpoint in spark.checkpoint.dir (survives executor loss, cuts lineage).

    ``spread=True`` (designs of iterative fits) first deals the rows round-robin
    over the cluster's cores (default parallelism), so every pass of a fit uses
    all cores even when the input was coalesced to a few partitions, and no pass
    pays for more Python tasks than there are cores."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if spread:
        df = df.repartition(max(1, spark.sparkContext.defaultParallelism))
    return df.checkpoint(eager=True)


def _plain_scan(df, keys, ords, *, row_number, count, cumsum, lag, lead, fill_down, fill_up, first, last,
                total, maximum, minimum) -> DataFrame:
    part = keys if keys else [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(*ords)
    wall = Window.partitionBy(*part)
    out = {}
    if row_number:
        out[row_number] = F.row_number().over(w).cast("int")
    if count:
        out[count] = F.count(F.lit(1)).over(wall).cast("long")
    for n, c in cumsum.items():
        out[n] = F.sum(_c(c)).over(w.rowsBetween(UP, 0))
    for n, c in lag.items():
        out[n] = F.lag(_c(c)).over(w)
    for n, c in lead.items():
        out[n] = F.lead(_c(c)).over(w)
    for n, c in fill_down.items():
        out[n] = F.last(_c(c), ignorenulls=True).over(w.rowsBetween(UP, 0))
    for n, c in fill_up.items():
        out[n] = F.first(_c(c), ignorenulls=True).over(w.rowsBetween(0, UF))
    for n, c in first.items():
        out[n] = F.first(_c(c)).over(w.rowsBetween(UP, UF))
    for n, c in last.items():
        out[n] = F.last(_c(c)).over(w.rowsBetween(UP, UF))
    for n, c in total.items():
        out[n] = F.sum(_c(c)).over(wall)
    for n, c in maximum.items():
        out[n] = F.max(_c(c)).over(wall)
    for n, c in minimum.items():
        out[n] = F.min(_c(c)).over(wall)
    return df.withColumns(out)


def blocks_from_rank(df: DataFrame, rank_col: str, block_rows: int, block: str = BLOCK) -> DataFrame:
    """Block = (rank - 1) div block_rows for a dense 1..n rank; normal groups get block 0.

    The hot flag of an existing block column is kept (ranks of a frame whose
    groups were all small stay small)."""
    hot = is_hot(df, block) if block in df.columns else True
    df = df.withColumn(block, F.floor((F.col(rank_col) - 1) / F.lit(int(block_rows))).cast("long"))
    return mark_blocks(df, hot, block)


TIME_BLOCK_ROWS = 1 << 20   # rows per time block of an ordered scan over a whole stratum


def blocks_from_quantiles(df: DataFrame, col: str, n_blocks: int | None = None, block: str = BLOCK,
                          rel_err: float | None = None, block_rows: int | None = None) -> DataFrame:
    """Block = bucket of ``col`` among global approximate quantile cuts.

    Used where every group is large by nature (strata of a curve): each block
    then holds about 1/n_blocks of all rows, whatever the skew between groups.
    Without ``n_blocks`` the count is ceil(rows / block_rows), so the cut list
    holds one number per million rows; the quantiles are taken to a quarter of a
    block, so that a block of distinct values stays below twice its share.
    Callers pass checkpointed frames, so the count is cheap.  One block means
    the plain single-pass scan.
    """
    from pyspark.ml.feature import Bucketizer

    if n_blocks is None:
        n = df.count()
        n_blocks = max(1, -(-n // int(block_rows or TIME_BLOCK_ROWS)))
    if n_blocks <= 1:
        return mark_blocks(df.withColumn(block, F.lit(0).cast("long")), False, block)
    probs = [i / n_blocks for i in range(1, n_blocks)]
    cuts = df.select(F.col(col).cast("double").alias("_q")).na.drop().approxQuantile(
        "_q", probs, min(0.001, 0.25 / n_blocks) if rel_err is None else rel_err)
    splits = sorted(set(float(c) for c in cuts))
    if not splits:
        return mark_blocks(df.withColumn(block, F.lit(0).cast("long")), False, block)
    splits = [float("-inf")] + splits + [float("inf")]
    tmp = "_bq_in"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=block, handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    out = out.withColumn(block, F.coalesce(F.col(block), F.lit(float(len(splits)))).cast("long")).drop(tmp)
    out = mark_blocks(out, True, block)
    meta = dict(out.schema[block].metadata)
    meta[SPLITS_KEY] = splits[1:-1]
    return out.withMetadata(block, meta)


def blocks_like(df: DataFrame, col: str, ref: DataFrame, block: str = BLOCK) -> DataFrame:
    """Assign blocks to ``df`` with the cut list already used by ``ref`` (no new
    quantile pass), so rows of both frames can be scanned together."""
    from pyspark.ml.feature import Bucketizer

    meta = ref.schema[block].metadata
    cuts = meta.get(SPLITS_KEY)
    if not cuts:
        return mark_blocks(df.withColumn(block, F.lit(0).cast("long")), bool(meta.get(HOT_KEY, False)), block)
    splits = [float("-inf")] + list(cuts) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="_bq_in", outputCol=block, handleInvalid="keep")
    out = b.transform(df.withColumn("_bq_in", F.col(col).cast("double")))
    out = out.withColumn(block, F.coalesce(F.col(block), F.lit(float(len(splits)))).cast("long")).drop("_bq_in")
    out = mark_blocks(out, True, block)
    m2 = dict(out.schema[block].metadata)
    m2[SPLITS_KEY] = list(cuts)
    return out.withMetadata(block, m2)


def blocks_for_hot_groups(df: DataFrame, keys: Sequence[str], order_col: str, block_rows: int,
                          block: str = BLOCK) -> DataFrame:
    """Block 0 for normal groups; the rows of hot groups (more than ``block_rows``
    rows) are cut into ranges of (keys, order) of about ``block_rows`` rows each,
    so a group gets as many blocks as its own rows need.

    Hot keys stay a DataFrame, however many there are; whether there is any is the
    only thing the driver learns.  Normal rows are neither shuffled by order
    nor checkpointed.  Null order values form the first range of their group.
    Rows that tie in ``order_col`` share a block.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).count()
    hot = counts.filter(F.col("count") > block_rows)
    n_hot = hot.agg(F.sum("count")).first()[0]
    if not n_hot:
        return mark_blocks(df.withColumn(block, F.lit(0).cast("long")), False, block)
    tags = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    tagged = df.join(tags, on=same, how="left").drop(*[f"_h_{k}" for k in keys])
    ranges = max(2, -(-int(n_hot) // block_rows))
    cut = tagged.filter(F.col("_hot")).drop("_hot").repartitionByRange(ranges, *keys, order_col)
    # The range number is fixed with the rows: both are read back from one checkpoint.
    cut = materialize(cut.withColumn(block, (F.spark_partition_id() + 1).cast("long")))
    normal = tagged.filter(F.col("_hot").isNull()).drop("_hot").withColumn(block, F.lit(0).cast("long"))
    return mark_blocks(normal.unionByName(cut), True, block)

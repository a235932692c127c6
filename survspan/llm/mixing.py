"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight w and a ramp a: its weight at training time t in [0, 1]
is w * (1 + a * (2t - 1)). The integral W(t) = t + a * (t^2 - t) scales the
source's target to its cumulative token demand. Documents of a source stand in a
reproducible random order and are passed over up to `max_repeats` times; a copy
that starts at token offset o of that sequence is trained on at the time t where
the demand reaches o (the inverse of W), and is left out where the demand ends
before the copy's middle.

Targets share the words of all sources by weight. No target exceeds
`max_repeats` times its source; what is cut there is shared again by weight.

Defined cases: a null or empty text has size 0: it takes no words and no
position; a null source is a source of its own, last in the order; repeated rows are rows
of their own; an empty table gives an empty mix. Only doc_id, text and source
are read by `positions`; `mixed` passes other columns through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, durable, n_words

# Weights by place in the order of the sources, repeating, and the ramps that go with them.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = (0.5, 0.0, -0.5)
MAX_REPEATS = 3
ROWS_PER_BLOCK = 50_000


def _key():
    """Order of documents inside a source: random, but the same in every run."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> and weight, ramp, target. One row per source.

    Every round shares what is left among the sources not yet at their limit;
    only two sums per round reach the driver.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # Places in the order: numbered inside range partitions, which start where the ones before end.
    ranged = durable(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    starts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())
    place = ranged.withColumn("_i", F.row_number().over(inside)).join(starts.drop("_n"), "_p").withColumn(
        "_i", F.col("_start") + F.col("_i") - 1).drop("_p", "_start")

    def by_place(values):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("_i") % len(values) + 1).cast("int"))

    weighed = durable(place.withColumn("weight", by_place(WEIGHTS)).withColumn("ramp", by_place(RAMPS)).drop("_i"))
    limit = F.col("source_size") * F.lit(float(max_repeats))
    rate = None
    while True:
        over = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) > limit
        s = weighed.agg(F.sum(F.when(over, limit)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w"),
                        F.count(F.when(over, 1)).alias("n")).first()
        if not s["w"]:
            break
        new = (total - (s["full"] or 0.0)) / s["w"]
        # Rates only rise, so a source at its limit stays there; equal rates end the rounds.
        if rate is not None and new <= rate:
            break
        rate = new
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(rate or 0.0), limit))


def offsets(rows: DataFrame, key: str = "_key", size: str = "size", group: str = "source") -> DataFrame:
    """rows with `_offset`: the sizes before each row inside its group, in the order of the hex key.

    The key's range is cut into blocks, as many as the rows need, so that a
    group with a third of all rows is summed by many tasks.
    """
    n = min(blocks(rows.count(), ROWS_PER_BLOCK), 1 << 28)
    cut = rows.withColumn("_block", F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / (1 << 32) * n).cast("long"))
    sums = cut.groupBy(group, "_block").agg(F.sum(size).alias("_n"))
    starts = sums.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_block").orderBy(key, size).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
            .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
            .withColumn("_offset", F.col("_start") + F.col("_inside"))
            .drop("_g", "_b", "_start", "_inside", "_block"))


def demand_time(offset, target, ramp):
    """Training time at which a source's cumulative demand reaches an offset: the inverse of t + a (t^2 - t)."""
    u = F.least(F.lit(1.0), offset / target)
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)
    return F.when(ramp == 0, u).otherwise((root - (1 - ramp)) / (2 * F.when(ramp == 0, F.lit(1.0)).otherwise(ramp)))


def positions(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per document: size, source_size, target, taken, copies and the training times of its copies."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("_key"))
    return _positions(durable(rows), max_repeats)


def _positions(rows: DataFrame, max_repeats: int) -> DataFrame:
    sources = durable(rows.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    shares = targets(sources, max_repeats).select(
        F.col("source").alias("_s"), "source_size", "target", "ramp")
    placed = offsets(rows).join(shares, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: F.col("_offset") + k * F.col("source_size"))
    taken = F.filter(passes, lambda o: (F.col("size") > 0) & (o + F.col("size") / 2 < F.col("target")))
    return (placed.withColumn("times", F.transform(taken, lambda o: demand_time(o, F.col("target"), F.col("ramp"))))
            .withColumn("copies", F.size("times")).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
            .drop("_offset", "ramp"))


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Every document's share of the mix, range-sorted by its first training position."""
    return (positions(docs).select("doc_id", "size", "source_size", "target", "taken", "copies",
                                   F.get("times", F.lit(0)).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def mixed(docs: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Pipeline stage: the training order itself: one row per taken copy, sorted by its position.

    The plan is made on (doc_id, source, size); texts then join it once by a key
    of the whole row. Equal rows share one key, hence one text and all their times.
    """
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                      F.xxhash64(*docs.columns).cast("string")).alias("_row")
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("_key"), row)
    plan = _positions(durable(rows), max_repeats).where("copies > 0")
    times = plan.groupBy("_row").agg(F.flatten(F.collect_list("times")).alias("_times"))
    texts = docs.select(row, F.struct(*docs.columns).alias("_d")).groupBy("_row").agg(F.first("_d").alias("_d"))
    return texts.join(times, "_row").select("_d", F.explode("_times").alias("_t")).orderBy("_t").select("_d.*")


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS i FROM d GROUP BY source),
w AS (
  SELECT *, CASE i WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight,
         CASE i WHEN 0 THEN {RAMPS[0]} WHEN 1 THEN {RAMPS[1]} ELSE {RAMPS[2]} END AS ramp,
         CAST({MAX_REPEATS} AS DOUBLE) * source_size AS lim FROM s),
-- Filling by the ratio of limit to weight: the first k sources are full, the rest share by weight.
f AS (
  SELECT *, coalesce(sum(lim) OVER o, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS w_left,
         sum(source_size) OVER () AS total FROM w
  WINDOW o AS (ORDER BY lim / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT (total - full_before) / w_left AS r FROM f WHERE (total - full_before) / w_left <= lim / weight
  ORDER BY lim / weight, source LIMIT 1),
t AS (SELECT source, source_size, ramp, least(weight * r, lim) AS target FROM w, rate),
p AS (
  SELECT doc_id, size, source_size, target, ramp,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
         CAST(o + size / 2.0 < target AS INT) + CAST(o + source_size + size / 2.0 < target AS INT)
         + CAST(o + 2 * source_size + size / 2.0 < target AS INT) END AS copies FROM p)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies,
       CASE WHEN copies = 0 THEN NULL WHEN ramp = 0 THEN least(1.0, o / target)
            ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * least(1.0, o / target)) - (1 - ramp)) / (2 * ramp) END AS position
FROM c"""

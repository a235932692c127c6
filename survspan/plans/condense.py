"""Bootstrap weights gathered on time nodes, so that a Newton round does not grow with the rows.

The log-likelihood of an AFT row with delayed entry splits into points of one time each, l(t0, t, d) = l(0, t, d) - l(0, t0, 0),
and a point's part is a smooth function of ln t. Points that share covariates, event flag and a cell of ln t (a quarter wide) are
interpolated from 12 Chebyshev nodes of the cell: the sum over the points of weight x l(t) is the sum over the nodes of
mass x l(node), where a replicate's mass is its weights times the Lagrange polynomials, whatever the coefficients. The error of
the interpolation is that of rounding. All rows and all draws go into the masses, in one pass over the data.

A fit to the rows themselves needs one mass per node (gather_once).

Of replicates, cells are sorted runs of a range partitioning: no cell is one task. A run of few points keeps its points, and so does a
design whose covariate vectors hardly repeat: their weights are drawn in every round, as before.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .likelihood import poisson_weights
from .scan import materialize

CELL = 0.25            # width of a cell of ln t
NODES = 12             # Chebyshev nodes in a cell
LEAST_POINTS = 24      # a run of no more points keeps them
POINTS_PER_PART = 1 << 17
TILE = 256             # points whose weights are drawn together: they stay in the cache
MASS = "_mass"         # of a gathered design

_ANGLES = (2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)
_X = -np.cos(_ANGLES)                                     # nodes in (-1, 1)
_BARY = (-1.0) ** np.arange(NODES) * np.sin(_ANGLES)      # barycentric weights


def lagrange(x: np.ndarray) -> np.ndarray:
    """(n, NODES): the Lagrange polynomials of the nodes at x in [-1, 1]."""
    gap = x[:, None] - _X[None, :]
    hit = gap == 0
    out = _BARY / np.where(hit, 1.0, gap)
    out /= out.sum(axis=1, keepdims=True)
    on = hit.any(axis=1)
    out[on] = hit[on]
    return out


def gather_once(design: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """design (t0, t, d, cols) -> rows (t0, t, d, cols, MASS) whose sums, weighted by MASS, are the design's: every point of a row goes
    to the nodes of its cell. A task sums its cells batch by batch, and one small aggregate adds the tasks. Rows with times that are
    not finite stay as they are, with their weight as mass."""
    from ..session import ship_code

    cols = list(dict.fromkeys(cols))
    ship_code(design.sparkSession)
    masses = [f"_m{j}" for j in range(NODES)]
    unit = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = design.select("t0", "t", "d", *cols, unit.alias(MASS))

    def inside(c: str):
        return (F.log(c) > -1e6) & (F.log(c) < 1e6)
    plain = F.coalesce(inside("t") & ((F.col("t0") == 0) | inside("t0")), F.lit(False))

    def part(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            w, late = pdf[MASS].to_numpy(float), pdf["t0"].to_numpy(float) > 0
            lt = np.log(np.concatenate([pdf["t"].to_numpy(float), pdf["t0"].to_numpy(float)[late]]))
            w = np.concatenate([w, -w[late]])
            keys = pd.concat([pdf[[*cols, "d"]], pdf.loc[late, cols].assign(d=0.0)], ignore_index=True)
            keys["_cell"] = np.floor(lt / CELL)
            group = keys.groupby([*cols, "d", "_cell"], sort=False, dropna=False)
            code = group.ngroup().to_numpy()
            part_of = lagrange(2 * (lt / CELL - keys["_cell"].to_numpy() - 0.5)) * w[:, None]
            out = keys.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
            yield out.assign(**{m: np.bincount(code, part_of[:, j], len(out)) for j, m in enumerate(masses)})

    fields = ", ".join(f"`{c}` double" for c in [*cols, "d", "_cell", *masses])
    cells = rows.where(plain).mapInPandas(part, fields).groupBy(*cols, "d", "_cell").agg(*[F.sum(m).alias(m) for m in masses])
    nodes = F.explode(F.array(*[F.struct(F.exp(F.lit(CELL) * (F.col("_cell") + float(0.5 + x / 2))).alias("t"), F.col(m).alias(MASS))
                                for x, m in zip(_X, masses)]))
    gathered = cells.select(F.lit(0.0).alias("t0"), "d", *cols, nodes.alias("_node")).select("t0", "_node.t", "d", *cols, f"_node.{MASS}")
    few = max(1, design.sparkSession.sparkContext.defaultParallelism // 4)  # a round is short: fewer tasks than cores
    return materialize(gathered.unionByName(rows.where(~plain)).coalesce(few))


def condense(design: DataFrame, cols: Sequence[str], reps: Sequence[int], seed: int, key: str = "_rk") -> DataFrame:
    """design (t0, t, d, cols, key) -> rows (t0 = 0, t, d, cols, key, _sign, _mass) for evaluate_reps: nodes with one mass per
    replicate, and points (null _mass) whose weights are drawn from their key times _sign."""
    from ..session import ship_code

    cols, reps = list(dict.fromkeys(cols)), np.array(sorted(reps), dtype=np.int64)
    spark = design.sparkSession
    ship_code(spark)
    ends = F.array(F.struct(F.col("t").alias("t"), F.col("d").alias("d"), F.lit(1.0).alias("_sign")),
                   F.when(F.col("t0") > 0, F.struct(F.col("t0").alias("t"), F.lit(0.0).alias("d"), F.lit(-1.0).alias("_sign"))))
    points = design.select(*cols, key, F.explode(ends).alias("_end")).where(F.col("_end").isNotNull()).select(*cols, key, "_end.*")
    lt = F.log("t")
    points = points.withColumn("_cell", F.when((lt > -1e6) & (lt < 1e6), F.floor(lt / CELL).cast("double")))
    n = points.count()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, n // 4096), -(-n // (POINTS_PER_PART * cores)) * cores if n > POINTS_PER_PART else 1)  # whole waves of tasks
    order = [*cols, "d", "_cell"]
    runs = points.repartitionByRange(parts, *order, key).sortWithinPartitions(*order)

    def raw(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.drop(columns="_cell").assign(t0=0.0, _mass=None)[names]

    def nodes(head: pd.Series, mass: np.ndarray) -> pd.DataFrame:
        u = CELL * (float(head["_cell"]) + 0.5 + _X / 2)
        out = pd.DataFrame({"t0": 0.0, "t": np.exp(u), "d": float(head["d"]), **{c: float(head[c]) for c in cols}, key: 0, "_sign": 1.0})
        return out.assign(_mass=list(mass))[names]

    def gather(pdf: pd.DataFrame, mass: np.ndarray) -> None:
        """Adds the run's weights to its cell's masses."""
        for a in range(0, len(pdf), TILE):
            some = pdf.iloc[a:a + TILE]
            x = 2 * (np.log(some["t"].to_numpy(float)) / CELL - some["_cell"].to_numpy(float) - 0.5)
            w = poisson_weights(some[key].to_numpy(), reps, seed)
            mass += (lagrange(x) * some["_sign"].to_numpy(float)[:, None]).T @ w

    class Run:
        """The cell that is open: its points while they are few, then its masses."""

        def __init__(self):
            self.few, self.n, self.mass, self.head = [], 0, None, None

        def add(self, pdf: pd.DataFrame) -> None:
            if self.head is None:
                self.head = pdf.iloc[0]
            self.few.append(pdf)
            self.n += len(pdf)
            if self.n > LEAST_POINTS:
                if self.mass is None:
                    self.mass = np.zeros((NODES, len(reps)))
                for x in self.few:
                    gather(x, self.mass)
                self.few = []

        def close(self) -> list[pd.DataFrame]:
            return [raw(x) for x in self.few] if self.mass is None else [nodes(self.head, self.mass)]

    def part(batches):
        run, last = Run(), None
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[order].to_numpy(float)
            new = np.concatenate([[last is None or not np.array_equal(values[0], last)], (values[1:] != values[:-1]).any(axis=1)])
            last = values[-1]
            begin = np.flatnonzero(new)
            begin = begin if new[0] else np.concatenate([[0], begin])
            end = np.concatenate([begin[1:], [len(pdf)]])
            kept = np.zeros(len(pdf), bool)
            for i in np.flatnonzero((end - begin > LEAST_POINTS) | (np.arange(len(begin)) % (len(begin) - 1 or 1) == 0)):
                if new[begin[i]]:
                    yield from run.close()
                    run = Run()
                run.add(pdf.iloc[begin[i]:end[i]])
                kept[begin[i]:end[i]] = True
            if not kept.all():
                yield raw(pdf[~kept])
        yield from run.close()

    def finite(batches):
        """part(), with what has no cell (times that are not finite) kept as points."""
        def cells():
            for pdf in batches:
                none = pdf["_cell"].isna().to_numpy()
                if none.any():
                    odd.append(raw(pdf[none]))
                yield pdf[~none]
        odd: list[pd.DataFrame] = []
        yield from part(cells())
        yield from odd

    fields = [StructField(c, DoubleType()) for c in ("t0", "t", "d", *cols)]
    schema = StructType([*fields, StructField(key, LongType()), StructField("_sign", DoubleType()),
                         StructField("_mass", ArrayType(DoubleType()))])
    names = schema.fieldNames()
    return materialize(runs.mapInPandas(finite, schema), spread=True)

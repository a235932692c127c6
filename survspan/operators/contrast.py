"""Model contrasts (K1-K5): relative hazards and relative times between groups.

Curves are grid x parameter rows: the grid is exploded per parameter row
(no cross join), the GG hazard / quantile kernels run in Arrow batches, and
ratios to the base group come from an equi-join on (replicate, grid point).
Bands are 5 % / 95 % quantiles over replicates, exact and distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.gengamma import gg_hazard, gg_quantile
from ..session import ship_code
from .describe import quantiles

HAZARD_TIMES = list(range(0, 31))                      # fixed grid of the reference: t = 0..30
QUANTILE_PCTS = list(range(5, 71))                     # fixed grid: p = .05 .. .70 by .01 (as integers)
BOOT_TIMES = [5, 10, 15, 20, 25, 30]                   # fixed grid of the replicate curves
BOOT_PCTS = [10, 20, 30, 40, 50, 60]


@F.pandas_udf(DoubleType())
def gg_hazard_col(t: pd.Series, mu: pd.Series, sigma: pd.Series, kappa: pd.Series) -> pd.Series:
    return pd.Series(gg_hazard(t.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), kappa.to_numpy(float)))


@F.pandas_udf(DoubleType())
def gg_quantile_col(p: pd.Series, mu: pd.Series, sigma: pd.Series, kappa: pd.Series) -> pd.Series:
    return pd.Series(gg_quantile(p.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), kappa.to_numpy(float)))


def _curve(params: DataFrame, grid: Sequence[int], scale: float, kind: str, keys: Sequence[str]) -> DataFrame:
    ship_code(params.sparkSession)
    g = params.withColumn("_g", F.explode(F.array(*[F.lit(int(x)) for x in grid])))
    x = (F.col("_g").cast("double") / F.lit(scale))
    fn = gg_hazard_col if kind == "hazard" else gg_quantile_col
    return g.select(*keys, "group", F.col("_g").alias("grid"), x.alias("x"),
                    fn(x, F.col("mu"), F.col("sigma"), F.col("kappa")).alias("v"))


def relative(params: DataFrame, kind: str = "hazard", grid: Sequence[int] | None = None, scale: float = 1.0,
             base=1, keys: Sequence[str] = ()) -> DataFrame:
    """K1/K2 (and K3/K4 with keys=['rep']): value_k(x) / value_base(x) per grid point.

    params: (keys..., group, mu, sigma, kappa).  At t = 0 the hazard ratio is 0/0
    and comes out null (try_divide), as the reference's NaN."""
    keys = list(keys)
    grid = list(grid) if grid is not None else (HAZARD_TIMES if kind == "hazard" else QUANTILE_PCTS)
    scale = scale if kind == "hazard" else (100.0 if scale == 1.0 else scale)
    c = _curve(params, grid, scale, kind, keys)
    b = c.filter(F.col("group") == F.lit(base)).select(*keys, "grid", F.col("v").alias("_base"))
    r = c.filter(F.col("group") != F.lit(base)).join(b, on=keys + ["grid"], how="inner")
    return r.select(*keys, F.concat(F.col("group").cast("string"), F.lit(":"), F.lit(str(base))).alias("contrast"),
                    "x", F.try_divide(F.col("v"), F.col("_base")).alias("ratio"))


def contrast_table(point: DataFrame, boot: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """K5: point curve with the lo/hi quantiles of the replicate curves at each grid point."""
    band = quantiles(boot.filter(F.col("ratio").isNotNull()), "ratio", [lo, hi], ["contrast", "x"], names=["lo", "hi"])
    return point.join(band, ["contrast", "x"], "inner").select("contrast", "x", "ratio", "lo", "hi")

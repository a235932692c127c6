"""Inference on fits (I1-I6) as column operators over a fits table.

A fits table has one row per (model, stratum, replicate):
  model string, terms array<string> ('eq:term'), beta array<double>,
  vcov array<double> (row-major p x p), loglik, loglik_logtime, k, n, events,
  converged.
Linear combinations use higher-order array functions (JVM side); tails and
matrix solves use Arrow-batched pandas UDFs.  Thousands of strata or bootstrap
replicates are handled in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.special import chi2_sf, norm_sf
from ..plans.likelihood import FitResult
from ..session import ship_code

Z975 = 1.959963984540054
MAX_MODELS = 100  # columns of the wide comparison table

FITS_SCHEMA = StructType([
    StructField("model", StringType()), StructField("terms", ArrayType(StringType())),
    StructField("beta", ArrayType(DoubleType())), StructField("vcov", ArrayType(DoubleType())),
    StructField("loglik", DoubleType()), StructField("loglik_logtime", DoubleType()),
    StructField("k", IntegerType()), StructField("n", LongType()), StructField("events", DoubleType()),
    StructField("converged", BooleanType()), StructField("scale", StringType()),
])


def fit_row(f: FitResult) -> tuple:
    return (f.model, [f"{e}:{t}" for e, t in f.names], [float(x) for x in f.params],
            [float(x) for x in np.asarray(f.vcov).ravel()], float(f.loglik),
            float(f.extra.get("loglik_logtime", f.loglik)) if f.extra.get("dist") != "cox" else float(f.loglik),
            int(f.k), int(f.n), float(f.events), bool(f.converged),
            "partial" if f.extra.get("dist") == "cox" else "density")


def fits_table(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    """A handful of fitted models as a fits table (small driver-side result rows)."""
    return fits_frame(spark, [fit_row(f) for f in fits])


def fits_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of FITS_SCHEMA, sent as one Arrow table: a list of rows would be read back by Python tasks in every job."""
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "double": pa.float64(),
             "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in FITS_SCHEMA])
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema), FITS_SCHEMA)


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return pd.Series(2.0 * norm_sf(np.abs(z.to_numpy(float))))


@F.pandas_udf(DoubleType())
def p_chi2(df: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(df.to_numpy(float), x.to_numpy(float)))


def _weights(terms_col: Column, weights: Mapping[str, float]) -> Column:
    m = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.transform(terms_col, lambda t: F.coalesce(m[t], F.lit(0.0)))


def lincom(fits: DataFrame, weights: Mapping[str, float], name: str = "lincom") -> DataFrame:
    """w'b, sqrt(w'Vw), z, p, 95 % CI per fit row."""
    ship_code(fits.sparkSession)
    d = fits.withColumn("_w", _weights(F.col("terms"), weights)).withColumn("_p", F.size("terms"))
    est = F.aggregate(F.zip_with("_w", "beta", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    var = F.aggregate(
        F.sequence(F.lit(0), F.col("_p") * F.col("_p") - 1), F.lit(0.0),
        lambda acc, k: acc + F.element_at("_w", (k / F.col("_p")).cast("int") + 1)
        * F.element_at("_w", (k % F.col("_p")) + 1) * F.element_at("vcov", k + 1))
    d = d.withColumns({"estimate": est, "se": F.sqrt(F.greatest(var, F.lit(0.0)))})
    d = d.withColumns({"z": F.try_divide(F.col("estimate"), F.col("se"))})
    return d.select("model", F.lit(name).alias("contrast"), "estimate", "se", "z", p_normal(F.col("z")).alias("p"),
                    (F.col("estimate") - Z975 * F.col("se")).alias("lo"),
                    (F.col("estimate") + Z975 * F.col("se")).alias("hi"))


def nlcom_exp(fits: DataFrame, weights: Mapping[str, float], name: str = "exp") -> DataFrame:
    """exp(w'b) with delta-method se = exp(w'b) se(w'b); CI = estimate +- 1.96 se."""
    lc = lincom(fits, weights, name)
    e = F.exp("estimate")
    return lc.select("model", "contrast", e.alias("estimate"), (e * F.col("se")).alias("se"),
                     F.try_divide(e, e * F.col("se")).alias("z"),
                     p_normal(F.try_divide(e, e * F.col("se"))).alias("p"),
                     (e - Z975 * e * F.col("se")).alias("lo"), (e + Z975 * e * F.col("se")).alias("hi"))


def ic(fits: DataFrame, scale: str = "density") -> DataFrame:
    """AIC = -2 lnL + 2k, BIC = -2 lnL + k ln N, on one named likelihood scale;
    a partial likelihood (Cox) has its own scale, whatever is named."""
    ll = F.col("loglik") if scale == "density" else F.col("loglik_logtime")
    named = F.when(F.col("scale") == "partial", "partial").otherwise(F.lit(scale)).alias("scale")
    return fits.select("model", "n", ll.alias("loglik"), "k", named,
                       (-2 * ll + 2 * F.col("k")).alias("aic"),
                       (-2 * ll + F.col("k") * F.log(F.col("n").cast("double"))).alias("bic"))


def lrtest(fits: DataFrame, pairs: Sequence[tuple[str, str]], scale: str = "density") -> DataFrame:
    """I4: likelihood-ratio tests small vs large (self equi-join of the fits table).
    A pair on different likelihood scales (a partial against a full one) is an error."""
    ll = "loglik" if scale == "density" else "loglik_logtime"
    spark = fits.sparkSession
    p = spark.createDataFrame(list(pairs), "small string, large string")
    a = fits.select(F.col("model").alias("small"), F.col(ll).alias("ll0"), F.col("k").alias("k0"), F.col("scale").alias("s0"))
    b = fits.select(F.col("model").alias("large"), F.col(ll).alias("ll1"), F.col("k").alias("k1"), F.col("scale").alias("s1"))
    j = p.join(a, "small").join(b, "large")
    mixed = F.raise_error(F.concat_ws(" ", F.lit("likelihood scales differ:"), "small", "large")).cast("double")
    chi2 = F.when(F.col("s0") == F.col("s1"), 2 * (F.col("ll1") - F.col("ll0"))).otherwise(mixed)
    dfree = F.col("k1") - F.col("k0")
    ship_code(spark)
    return j.select("small", "large", chi2.alias("chi2"), dfree.alias("df"),
                    p_chi2(dfree.cast("double"), chi2).alias("p"))


@F.pandas_udf(DoubleType())
def _wald_udf(beta: pd.Series, vcov: pd.Series, idx: pd.Series) -> pd.Series:
    out = []
    for b, v, ix in zip(beta, vcov, idx):
        b = np.asarray(b, float)
        p = len(b)
        V = np.asarray(v, float).reshape(p, p)
        ix = np.asarray(ix, int)
        if len(ix) == 0 or not np.all(np.isfinite(b[ix])):
            out.append(np.nan)
            continue
        bb, VV = b[ix], V[np.ix_(ix, ix)]
        try:
            out.append(float(bb @ np.linalg.solve(VV, bb)))
        except np.linalg.LinAlgError:
            out.append(np.nan)
    return pd.Series(out)


def wald(fits: DataFrame, terms: Sequence[str], name: str = "wald") -> DataFrame:
    """Joint Wald chi-square b' V^-1 b over the named terms."""
    ship_code(fits.sparkSession)
    want = F.array(*[F.lit(t) for t in terms])
    idx = F.filter(F.transform(F.col("terms"), lambda t, i: F.when(F.array_contains(want, t), i)),
                   lambda x: x.isNotNull())
    d = fits.withColumn("_idx", idx)
    chi = _wald_udf(F.col("beta"), F.col("vcov"), F.col("_idx"))
    return d.select("model", F.lit(name).alias("test"), chi.alias("chi2"), F.size("_idx").alias("df"),
                    p_chi2(F.size("_idx").cast("double"), chi).alias("p"))


def coef_long(fits: DataFrame, exponentiate: bool = False) -> DataFrame:
    """One row per (model, equation, term): b (or exp b), se, z, p, CI."""
    ship_code(fits.sparkSession)
    d = fits.select("model", F.posexplode("terms").alias("i", "name"), "beta", "vcov", F.size("terms").alias("p"))
    b = F.element_at("beta", F.col("i") + 1)
    se = F.sqrt(F.greatest(F.element_at("vcov", F.col("i") * F.col("p") + F.col("i") + 1), F.lit(0.0)))
    d = d.select("model", F.split("name", ":").getItem(0).alias("equation"),
                 F.split("name", ":").getItem(1).alias("term"), b.alias("coef"), se.alias("se"))
    d = d.withColumn("z", F.try_divide(F.col("coef"), F.col("se")))
    d = d.withColumns({"p": p_normal(F.col("z")), "lo": F.col("coef") - Z975 * F.col("se"),
                       "hi": F.col("coef") + Z975 * F.col("se")})
    if exponentiate:
        # delta method: the se that belongs to exp(b); z, p and the limits stay those of b
        d = d.withColumns({"coef": F.exp("coef"), "se": F.exp("coef") * F.col("se"), "lo": F.exp("lo"), "hi": F.exp("hi")})
    return d


def compare(fits: DataFrame) -> DataFrame:
    """Coefficient by model, wide (pivot over the model names present)."""
    long = coef_long(fits)
    models = [r[0] for r in fits.select("model").distinct().limit(MAX_MODELS + 1).collect()]
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models; a wide table needs a selection, coef_long has them all")
    return long.groupBy("equation", "term").pivot("model", sorted(models)).agg(F.first("coef"))


def hazard_ratio_weibull(fits: DataFrame) -> DataFrame:
    """M8: Weibull time coefficients b -> hazard ratios exp(-b / sigma)."""
    long = coef_long(fits)
    sig = long.filter((F.col("equation") == "lnsigma") & (F.col("term") == "_cons")) \
        .select("model", F.exp("coef").alias("sigma"))
    m = long.filter((F.col("equation") == "mu") & (F.col("term") != "_cons")).join(sig, "model")
    return m.select("model", "term", F.exp(-F.col("coef") / F.col("sigma")).alias("hazard_ratio"),
                    F.exp("coef").alias("time_ratio"))

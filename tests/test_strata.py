"""Fits per stratum (M7): thousands of strata, failing strata, against closed forms and joint fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from survspan.operators import aft
from survspan.operators.survival import SurvSpec
from survspan.plans import strata as plan

SPEC = SurvSpec("s", "e", "ev")
SCHEMA = "g string, s double, e double, ev int, x double"


def rows_of(g, n, seed, censor=0.2, shape=1.5):
    rng = np.random.default_rng(seed)
    start = rng.uniform(0, 0.5, n)
    return [(g, float(a), float(a + 0.05 + 2 * rng.weibull(shape)), int(rng.random() > censor), float(rng.integers(0, 2)))
            for a in start]


def test_five_thousand_strata(spark):
    n = 5000
    df = spark.range(n * 12).select(
        (F.col("id") % n).alias("g"), F.lit(0.0).alias("s"),
        (F.lit(0.1) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 250.0).alias("e"),
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) > 0, 1).otherwise(0).alias("ev"))
    fits = aft.aft_by(df, SPEC, "g", "exponential", tol=1e-16)
    want = df.groupBy("g").agg(F.sum("e").alias("t"), F.sum("ev").alias("d"))
    both = fits.join(want, "g").withColumn("b", F.element_at("beta", 1)).withColumn("v", F.element_at("vcov", 1))
    bad = both.where("converged != (d > 0) or (d > 0 and (abs(b - ln(t / d)) > 1e-7 or abs(v - 1 / d) > 1e-7 "
                     "or abs(loglik - (-d * ln(t / d) - d)) > 1e-7)) or (d = 0 and beta is not null)")
    assert fits.count() == n and bad.isEmpty() and both.where("converged").count() > 4900


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_strata_alone_and_together(spark, monkeypatch, bound):
    """Each stratum's fit is the fit of its rows alone; one without events or with a null name spoils nothing."""
    monkeypatch.setattr(plan, "BROADCAST_NUMBERS", bound)  # 0: candidates meet the design in a shuffled join
    rows = rows_of("a", 150, 1) + rows_of("b", 400, 2, shape=0.8) + rows_of("none", 20, 3, censor=2.0) + rows_of(None, 30, 4)
    rows += [("b", None, None, 1, 0.0), ("b", 0.0, 1.0, 1, None), ("lone", 0.0, 1.0, 0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    fits = {r.g: r for r in aft.aft_by(df, SPEC, "g", "weibull", terms=["x"]).collect()}
    assert set(fits) == {"a", "b", "none", "lone"}
    assert not fits["none"].converged and fits["none"].beta is None and fits["none"].n == 20
    for g in "ab":
        alone = aft.aft(df.where(F.col("g") == g), SPEC, ["x"], "weibull")
        assert fits[g].converged and fits[g].terms == [f"{e}:{t}" for e, t in alone.names]
        assert np.allclose(fits[g].beta, alone.params, atol=1e-6) and abs(fits[g].loglik - alone.loglik) < 1e-7
        assert np.allclose(np.array(fits[g].vcov).reshape(3, 3), alone.vcov, atol=1e-6)


def test_generalised_gamma_by_stratum(spark):
    df = spark.createDataFrame(rows_of("a", 300, 5) + rows_of("b", 300, 6), SCHEMA)
    fits = aft.aft_by(df, SPEC, "g", "ggamma")
    for r in aft.by_params(fits, "g").collect():
        alone = aft.aft_ggamma(df.where(F.col("g") == r.g), SPEC)
        p = aft.group_params(alone, [1], {})[0]
        assert r.converged and np.allclose([r.mu, r.sigma, r.kappa], [p["mu"], p["sigma"], p["kappa"]], atol=1e-4)


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame(rows_of("a", 40, 1), SCHEMA).withColumnRenamed("g", "cand_of").withColumn("theta", F.lit(1)).withColumn("v0", F.lit("x"))
    assert aft.aft_by(df, SPEC, "cand_of", "weibull").first().converged
    assert aft.aft_by(df.where("false"), SPEC, "cand_of", "ggamma").count() == 0

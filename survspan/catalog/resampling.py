"""Registered queries: bootstrap (Z*) and model contrasts (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrast, infer, resample
from .models import RACES, SPEC, _memo, fit_frame, fit_named
from .registry import r6, register

# Race has events in every class at every size of the data, so that all groups' effects are identified.
GROUP_TERMS = {1: None} | {i + 2: t for i, t in enumerate(RACES)}


def _reps(spark, sf, model: str = "gg_race_saturated"):
    """Replicates of a crude generalized gamma (seed, count and cap of the reference)."""
    def make():
        start = fit_named(spark, sf, model)
        return resample.bootstrap_aft(fit_frame(spark, sf), SPEC, ["id", "visit"], start)
    return _memo(spark, sf, f"boot_{model}", make)


# Contrast curves and bands use the conventional GG: one model for the point
# curve and the replicates (no mixing of sources).
CONTRAST_MODEL = "gg_race"


def _point_params(spark, sf):
    f = fit_named(spark, sf, CONTRAST_MODEL)
    obs = infer.fits_table(spark, [f]).withColumn("rep", F.lit(0))
    return resample.replicate_group_params(obs, GROUP_TERMS, "ggamma").drop("rep")


@register("bootstrap")
def q_bootstrap(spark, sf):
    """500 Poisson-weight replicates of the saturated GG, failed draws kept as missing."""
    r = _reps(spark, sf)
    return r.select("rep", "converged", F.transform("beta", lambda x: F.round(x, 6)).alias("beta"))


@register("bootstrap_conventional")
def q_bootstrap_conventional(spark, sf):
    """500 replicates of the conventional GG by race (used for the contrast bands)."""
    r = _reps(spark, sf, CONTRAST_MODEL)
    return r.select("rep", "converged", F.transform("beta", lambda x: F.round(x, 6)).alias("beta"))


@register("boot_table_conventional")
def q_boot_table_conventional(spark, sf):
    """Z2 for the conventional crude GG."""
    obs = infer.fits_table(spark, [fit_named(spark, sf, CONTRAST_MODEL)])
    t = resample.boot_table(_reps(spark, sf, CONTRAST_MODEL), obs)
    return t.select("equation", "term", *[r6(c) for c in ("coef", "se", "z", "p", "lo", "hi")], "n_ok", "failed", "reps")


@register("boot_table")
def q_boot_table(spark, sf):
    """Bootstrap standard errors, z, p and normal CI next to the observed coefficients."""
    obs = infer.fits_table(spark, [fit_named(spark, sf, "gg_race_saturated")])
    t = resample.boot_table(_reps(spark, sf), obs)
    return t.select("equation", "term", *[r6(c) for c in ("coef", "se", "z", "p", "lo", "hi")], "n_ok", "failed", "reps")


@register("boot_group_params")
def q_boot_group_params(spark, sf):
    """Per replicate and group (mu, sigma, kappa) of the conventional GG (shared sigma, kappa)."""
    g = resample.replicate_group_params(_reps(spark, sf, CONTRAST_MODEL), GROUP_TERMS, "ggamma")
    return g.select("rep", "group", r6("mu"), r6("sigma"), r6("kappa"))


@register("relative_hazard")
def q_relative_hazard(spark, sf):
    """K1: hazard of races 2 and 3 relative to race 1 at t = 0..30 (GG fit)."""
    r = contrast.relative(_point_params(spark, sf), "hazard")
    return r.select("contrast", F.col("x").alias("t"), r6("ratio"))


@register("relative_time")
def q_relative_time(spark, sf):
    """K2: failure-time quantiles of races 2 and 3 relative to race 1 at p = .05 .. .70."""
    r = contrast.relative(_point_params(spark, sf), "quantile")
    return r.select("contrast", r6("x", "p"), r6("ratio"))


@register("boot_band")
def q_boot_band(spark, sf):
    """K3/K5: relative hazards at 5..30 with 5-95 % replicate bands."""
    point = contrast.relative(_point_params(spark, sf), "hazard", grid=contrast.BOOT_TIMES)
    gp = resample.replicate_group_params(_reps(spark, sf, CONTRAST_MODEL), GROUP_TERMS, "ggamma")
    boot = contrast.relative(gp, "hazard", grid=contrast.BOOT_TIMES, keys=["rep"])
    t = contrast.contrast_table(point, boot)
    return t.select("contrast", F.col("x").alias("t"), r6("ratio"), r6("lo"), r6("hi"))


@register("boot_band_time")
def q_boot_band_time(spark, sf):
    """K4/K5: relative times at p = .1 .. .6 with 5-95 % replicate bands."""
    point = contrast.relative(_point_params(spark, sf), "quantile", grid=contrast.BOOT_PCTS)
    gp = resample.replicate_group_params(_reps(spark, sf, CONTRAST_MODEL), GROUP_TERMS, "ggamma")
    boot = contrast.relative(gp, "quantile", grid=contrast.BOOT_PCTS, keys=["rep"])
    t = contrast.contrast_table(point, boot)
    return t.select("contrast", r6("x", "p"), r6("ratio"), r6("lo"), r6("hi"))



@register("boot_wald")
def q_boot_wald(spark, sf):
    """I5 with the bootstrap covariance (as the reference's logged Wald test): joint test
    of the race effects of the conventional GG; nulls where too few draws converged."""
    f = fit_named(spark, sf, CONTRAST_MODEL)
    chi2, df, p, n = resample.boot_wald(_reps(spark, sf, CONTRAST_MODEL), f, [f"mu:{g}" for g in GROUP_TERMS.values() if g])
    out = spark.createDataFrame([(f.model, chi2, int(df), p, int(n))],
                                "model string, chi2 double, df int, p double, reps_used long")
    return out.select("model", r6("chi2"), "df", r6("p"), "reps_used")


def _cox_reps(spark, sf):
    def make():
        return resample.bootstrap_cox(fit_frame(spark, sf), SPEC, ["id", "visit"], fit_named(spark, sf, "cox_race"))
    return _memo(spark, sf, "boot_cox_race", make)


@register("bootstrap_cox")
def q_bootstrap_cox(spark, sf):
    """Z1/Z5 for the Cox model: 500 Poisson-weight replicates of the log hazard ratios by race."""
    return _cox_reps(spark, sf).select("rep", "converged", F.transform("beta", lambda x: F.round(x, 6)).alias("beta"))


@register("boot_table_cox")
def q_boot_table_cox(spark, sf):
    """Z2 for the Cox model."""
    t = resample.boot_table(_cox_reps(spark, sf), infer.fits_table(spark, [fit_named(spark, sf, "cox_race")]))
    return t.select("equation", "term", *[r6(c) for c in ("coef", "se", "z", "p", "lo", "hi")], "n_ok", "failed", "reps")

"""Bootstrap.

Rows are resampled with Poisson(1) weights drawn from a hash of
(row key, replicate, seed): no copies of the data, identical draws under any
partitioning.  The weights of AFT rows are gathered on time nodes once
(plans/condense.py); every Newton round of every active replicate shares one
scan of these.  Only replicate x parameter sums are shuffled.  Replicates that do not converge within the iteration cap are kept
as rows with missing coefficients (never dropped), like the reference's
failed draws.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.likelihood import CONS, FitResult, newton_lockstep, newton_reps
from ..plans.risksets import replicate_sets, risk_stats
from . import aft, cox
from .infer import Z975, fits_frame, p_normal
from .survival import SurvSpec

SEED = 19210428  # fixed value of the reference: bootstrap seed
REPS = 500       # fixed value of the reference: number of replicates
MAX_ITER = 50    # fixed value of the reference: iteration cap per replicate


def bootstrap_aft(df: DataFrame, spec: SurvSpec, key_cols: Sequence[str], start: FitResult,
                  reps: int = REPS, seed: int = SEED, max_iter: int = MAX_ITER) -> DataFrame:
    """Bootstrap an AFT fit; returns a replicate fits table (one row per draw)."""
    dist = start.extra["dist"]
    eqs = start.equations
    cols = list(dict.fromkeys(t for _e, ts in eqs for t in ts if t != CONS))
    design = aft.model_frame(df.withColumn("_rk", F.xxhash64(*key_cols)), spec, cols + ["_rk"])
    design = design.withColumn("_rk", F.col("_rk").cast("long"))
    res = newton_reps(design, aft.family_model(dist), eqs, start.params, list(range(1, reps + 1)), seed,
                      max_iter=max_iter, prepared=start.extra.get("prepared", False))
    return _replicates(df.sparkSession, start, res, reps, "density")


def bootstrap_cox(df: DataFrame, spec: SurvSpec, key_cols: Sequence[str], start: FitResult,
                  reps: int = REPS, seed: int = SEED, max_iter: int = MAX_ITER) -> DataFrame:
    """Bootstrap a Cox fit (Breslow ties); returns a replicate fits table (one row per draw).

    The sorted risk-set records carry the row key; every scan draws the weights of a chunk of replicates and
    keeps their sums side by side, so that a round of all replicates reads the records twice per chunk (once after
    the first round where covariate vectors are few)."""
    terms = list(start.equations[0][1])
    frame = df.withColumn("_rk", F.xxhash64(*key_cols))
    design = cox.cox_design(frame, spec, terms, start.extra.get("strata"), keep=["_rk"])
    sets = replicate_sets(design, terms, "_rk")
    chunk = sets.replicates_at_once()
    kept: dict = {}

    def evalr(active: dict) -> dict:
        out, ids = {}, sorted(active)
        for a in range(0, len(ids), chunk):
            some = ids[a:a + chunk]
            ll, u, info = risk_stats(sets, np.array([active[r] for r in some]), reps=np.array(some), seed=seed, kept=kept)
            out |= {r: (float(ll[i]), u[i], -info[i]) for i, r in enumerate(some)}
        return out

    res = newton_lockstep(evalr, start.params, list(range(1, reps + 1)), max_iter=max_iter)
    return _replicates(df.sparkSession, start, res, reps, "partial")


def _replicates(spark: SparkSession, start: FitResult, res: dict, reps: int, scale: str) -> DataFrame:
    """One row per draw; a draw that did not converge has no coefficients."""
    terms = [f"{e}:{t}" for e, t in start.names]
    rows = []
    for r in range(1, reps + 1):
        theta, ll, vcov, conv, it = res[r]
        ok = bool(conv)
        rows.append((f"{start.model}#{r}", terms, [float(x) for x in theta] if ok else None,
                     [float(x) for x in np.asarray(vcov).ravel()] if ok and vcov is not None else None,
                     float(ll) if ok and ll is not None else None, None, int(start.k), int(start.n),
                     float(start.events), ok, scale))
    out = fits_frame(spark, rows)
    return out.withColumn("rep", F.split("model", "#").getItem(1).cast("int"))


def boot_table(reps: DataFrame, observed: DataFrame) -> DataFrame:
    """Bootstrap se (sd over converged replicates), z, p, normal 95 % CI,
    plus the number of failed replicates."""
    long = reps.filter(F.col("converged")).select(F.posexplode("terms").alias("i", "name"), "beta") \
        .select("name", F.element_at("beta", F.col("i") + 1).alias("b"))
    se = long.groupBy("name").agg(F.stddev_samp("b").alias("se"), F.count("b").alias("n_ok"))
    obs = observed.select(F.posexplode("terms").alias("i", "name"), "beta") \
        .select("name", F.element_at("beta", F.col("i") + 1).alias("coef"))
    failed = reps.agg(F.count_if(~F.col("converged")).alias("failed"), F.count(F.lit(1)).alias("reps"))
    j = obs.join(se, "name", "left").withColumn("_one", F.lit(1)) \
        .join(failed.withColumn("_one", F.lit(1)), "_one").drop("_one")
    z = F.try_divide(F.col("coef"), F.col("se"))
    return j.select(F.split("name", ":").getItem(0).alias("equation"), F.split("name", ":").getItem(1).alias("term"),
                    "coef", "se", z.alias("z"), p_normal(z).alias("p"),
                    (F.col("coef") - Z975 * F.col("se")).alias("lo"), (F.col("coef") + Z975 * F.col("se")).alias("hi"),
                    "n_ok", "failed", "reps")


def replicate_group_params(reps: DataFrame, groups: dict, dist: str = "ggamma", only_converged: bool = True) -> DataFrame:
    """Per replicate and group (mu, sigma, kappa) from the coefficient arrays:
    sums of the constant and the group dummy, exp for sigma (shared or per group)."""
    def coef(name):
        idx = F.array_position("terms", F.lit(name))
        return F.when(idx > 0, F.element_at("beta", F.greatest(idx, F.lit(1)).cast("int"))).otherwise(F.lit(0.0))

    parts = []
    for g, term in groups.items():
        def lin(eq):
            e = coef(f"{eq}:{CONS}")
            return e + coef(f"{eq}:{term}") if term else e
        sigma = F.exp(lin("lnsigma"))
        kappa = lin("kappa") if dist == "ggamma" else (F.lit(1.0) if dist == "weibull" else sigma)
        src = reps.filter(F.col("converged")) if only_converged else reps
        parts.append(src.select(
            "rep", F.lit(g).alias("group"), lin("mu").alias("mu"), sigma.alias("sigma"), kappa.alias("kappa")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def boot_covariance(reps: DataFrame) -> tuple[list, np.ndarray, int]:
    """Covariance of the coefficients over converged replicates, as one
    aggregate: sums of b and of the outer products b b' (arrays exploded by index)."""
    ok = reps.filter(F.col("converged"))
    terms = ok.select("terms").limit(1).collect()
    if not terms:
        return [], np.zeros((0, 0)), 0
    names = list(terms[0]["terms"])
    p = len(names)
    prod = F.transform(F.sequence(F.lit(0), F.lit(p * p - 1)),
                       lambda k: F.element_at("beta", (k / p).cast("int") + 1) * F.element_at("beta", (k % p) + 1))
    vec = F.concat(F.col("beta"), prod)
    rows = ok.select(F.posexplode(vec).alias("k", "v")).groupBy("k") \
        .agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    acc = np.zeros(p + p * p)
    n = 0
    for r in rows:
        acc[r["k"]] = r["s"]
        n = max(n, r["n"])
    if n < 2:
        return names, np.full((p, p), np.nan), n
    m = acc[:p] / n
    cov = (acc[p:].reshape(p, p) - n * np.outer(m, m)) / (n - 1)
    return names, cov, n


def boot_wald(reps: DataFrame, observed, terms: list) -> tuple[float | None, int, float | None, int]:
    """Joint Wald chi-square of ``terms`` with the bootstrap covariance; null where fewer draws converged
    than the test needs (one more than it has terms)."""
    from ..functions.special import chi2_sf
    names, cov, n = boot_covariance(reps)
    if n <= len(terms):
        return None, len(terms), None, n
    obs = [f"{e}:{t}" for e, t in observed.names]
    idx = [names.index(t) for t in terms]
    oi = [obs.index(t) for t in terms]
    b = np.asarray(observed.params)[oi]
    V = cov[np.ix_(idx, idx)]
    chi2 = float(b @ np.linalg.solve(V, b))
    return chi2, len(terms), float(chi2_sf(len(terms), chi2)), n

"""Model fits: likelihood identities, brute-force Cox, bootstrap determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from survspan.operators import aft, cohort, cox, resample
from survspan.operators.survival import SurvSpec
from survspan.plans import risksets
from survspan.plans.likelihood import CONS, evaluate, poisson_weights
from survspan.sources.person_period import person_periods

SPEC = SurvSpec("t_start", "t_stop", "outcome")


def _data(spark):
    return cohort.survival_design(cohort.locf(person_periods(spark, SF001)))


def test_gg_at_kappa_one_is_weibull(spark):
    d = aft.model_frame(_data(spark), SPEC, [])
    th = np.array([3.0, np.log(0.6)])
    lw, gw, _ = evaluate(d, aft.family_model("weibull"), [("mu", [CONS]), ("lnsigma", [CONS])], th)
    lg, gg, _ = evaluate(d, aft.family_model("ggamma"), [("mu", [CONS]), ("lnsigma", [CONS]), ("kappa", [CONS])],
                         np.array([3.0, np.log(0.6), 1.0]))
    assert abs(lw - lg) < 1e-8 and np.allclose(gw, gg[:2], atol=1e-6)


def test_weibull_fit_score_zero(spark):
    f = aft.aft(_data(spark), SPEC, ["sbp_group2"], "weibull")
    assert f.converged
    d = aft.model_frame(_data(spark), SPEC, ["sbp_group2"])
    _, g, _ = evaluate(d, aft.family_model("weibull"), f.equations, f.params)
    assert np.max(np.abs(g)) < 1e-4


def test_cox_matches_brute_force(spark):
    d = _data(spark)
    f = cox.cox(d, SPEC, ["sbp_group2", "lbw"])
    pdf = d.select("t_start", "t_stop", "outcome", "sbp_group2", "lbw").toPandas()
    X = pdf[["sbp_group2", "lbw"]].to_numpy(float)
    t0, t1, ev = pdf.t_start.to_numpy(), pdf.t_stop.to_numpy(), pdf.outcome.to_numpy()

    def ll(b):
        xb = X @ b
        return sum(xb[i] - np.log(np.exp(xb[(t0 < t1[i]) & (t1[i] <= t1)]).sum()) for i in np.where(ev == 1)[0])
    assert abs(ll(f.params) - f.loglik) < 1e-8
    for delta in (np.array([0.01, 0]), np.array([0, -0.01])):
        assert ll(f.params + delta) < f.loglik


def test_bootstrap_weights_deterministic():
    keys = np.arange(-500, 500, dtype=np.int64) * 7919
    a = poisson_weights(keys, np.arange(1, 6), 19210428)
    b = poisson_weights(keys[::-1], np.arange(1, 6), 19210428)[::-1]
    assert np.array_equal(a, b)
    assert abs(a.mean() - 1.0) < 0.1 and abs(a.var() - 1.0) < 0.15


def test_bootstrap_partition_independent(spark):
    d = _data(spark)
    f = aft.aft(d, SPEC, [], "weibull")
    r1 = resample.bootstrap_aft(d, SPEC, ["id", "visit"], f, reps=4)
    r2 = resample.bootstrap_aft(d.repartition(5), SPEC, ["id", "visit"], f, reps=4)
    b1 = {r["rep"]: r["beta"] for r in r1.collect()}
    b2 = {r["rep"]: r["beta"] for r in r2.collect()}
    for k in b1:
        assert np.allclose(b1[k], b2[k], atol=1e-8)


def test_cox_efron_matches_brute_force(spark):
    # tied event times: coarsen the clock to whole days
    d = _data(spark).withColumn("t_stop", F.ceil("t_stop").cast("double")) \
        .withColumn("t_start", F.floor("t_start").cast("double"))
    f = cox.cox(d, SPEC, ["sbp_group2", "lbw"], ties="efron")
    b = cox.cox(d, SPEC, ["sbp_group2", "lbw"], ties="breslow")
    pdf = d.filter("t_stop > t_start").select("t_start", "t_stop", "outcome", "sbp_group2", "lbw").toPandas()
    X = pdf[["sbp_group2", "lbw"]].to_numpy(float)
    t0, t1, ev = pdf.t_start.to_numpy(), pdf.t_stop.to_numpy(), pdf.outcome.to_numpy()

    def ll(beta):
        r = np.exp(X @ beta)
        tot = 0.0
        for t in np.unique(t1[ev == 1]):
            e = (t1 == t) & (ev == 1)
            risk = (t0 < t) & (t <= t1)
            dd = e.sum()
            tot += (X[e] @ beta).sum() - sum(np.log(r[risk].sum() - l / dd * r[e].sum()) for l in range(dd))
        return tot
    assert abs(ll(f.params) - f.loglik) < 1e-8
    for delta in (np.array([0.01, 0]), np.array([0, -0.01])):
        assert ll(f.params + delta) < f.loglik
    assert abs(f.loglik - b.loglik) > 1e-6  # ties present: the two methods differ


def test_split_episodes_join_equals_array(spark):
    d = cohort.locf(person_periods(spark, SF001))
    cut_df = d.filter(F.col("outcome") == 1).select(F.col("t_stop").alias("c")).distinct()
    cuts = [r["c"] for r in cut_df.collect()]
    a = cox.split_episodes(d, SPEC, cuts, keep=["id", "visit"])
    b = cox.split_episodes_join(d, SPEC, cut_df, keep=["id", "visit"], n_bins=3)
    from conftest import rows
    assert rows(a) == rows(b) and len(rows(a)) > d.count()


def _brute_cox(t0, t1, ev, X, beta, strata=None, zt=None, gamma=None, texp=None):
    """Breslow log partial likelihood by brute force; zt/gamma/texp add z * texp(t) terms."""
    strata = np.zeros(len(t1)) if strata is None else strata
    tot = 0.0
    for i in np.where(ev == 1)[0]:
        t = t1[i]
        risk = (t0 < t) & (t <= t1) & (strata == strata[i])
        eta = X @ beta
        if zt is not None:
            eta = eta + (zt @ gamma) * texp(t)
        tot += eta[i] - np.log(np.exp(eta[risk]).sum())
    return tot


def test_cox_tvc_matches_brute_force(spark):
    d = _data(spark)
    texp = lambda c: (c - F.lit(16.0)) * (c <= F.lit(16.0)).cast("double")
    f = cox.cox_tvc(d, SPEC, ["sbp_group2"], ["sbp_group2"], texp)
    pdf = d.filter("t_stop > t_start").select("t_start", "t_stop", "outcome", "sbp_group2").toPandas()
    X = pdf[["sbp_group2"]].to_numpy(float)
    args = (pdf.t_start.to_numpy(), pdf.t_stop.to_numpy(), pdf.outcome.to_numpy(), X)
    g = lambda t: (t - 16.0) * (t <= 16.0)
    ll = lambda b: _brute_cox(*args, b[:1], zt=X, gamma=b[1:], texp=g)
    assert abs(ll(f.params) - f.loglik) < 1e-8
    assert ll(f.params + np.array([0.01, 0.0])) < f.loglik and ll(f.params + np.array([0.0, -0.01])) < f.loglik


def test_stratified_cox_matches_brute_force(spark):
    d = _data(spark)
    f = cox.cox(d, SPEC, ["sbp_group2"], strata="lbw")
    pdf = d.filter("t_stop > t_start").select("t_start", "t_stop", "outcome", "sbp_group2", "lbw").toPandas()
    args = (pdf.t_start.to_numpy(), pdf.t_stop.to_numpy(), pdf.outcome.to_numpy(), pdf[["sbp_group2"]].to_numpy(float))
    ll = lambda b: _brute_cox(*args, b, strata=pdf.lbw.to_numpy())
    assert abs(ll(f.params) - f.loglik) < 1e-8
    assert ll(f.params + 0.01) < f.loglik and ll(f.params - 0.01) < f.loglik


def test_efron_chunks_equal(spark, monkeypatch):
    d = _data(spark).withColumn("t_stop", F.ceil("t_stop").cast("double")) \
        .withColumn("t_start", F.floor("t_start").cast("double"))
    a = cox.cox(d, SPEC, ["sbp_group2"], ties="efron")
    monkeypatch.setattr(risksets, "EFRON_ROWS", 2)  # tied events in several chunks
    b = cox.cox(d, SPEC, ["sbp_group2"], ties="efron")
    assert abs(a.loglik - b.loglik) < 1e-9 and np.allclose(a.params, b.params, atol=1e-9)


def test_boot_covariance_matches_numpy(spark):
    from survspan.operators.infer import FITS_SCHEMA
    rng = np.random.default_rng(5)
    B = rng.normal(size=(40, 3))
    rows_ = [(f"m#{i}", ["mu:a", "mu:b", "mu:c"], [float(x) for x in B[i]], None, None, None, 3, 10, 1.0, True, "density")
             for i in range(40)]
    reps = spark.createDataFrame(rows_, FITS_SCHEMA)
    names, cov, n = resample.boot_covariance(reps)
    assert names == ["mu:a", "mu:b", "mu:c"] and n == 40
    assert np.allclose(cov, np.cov(B, rowvar=False), atol=1e-12)


def test_level_without_events_is_not_converged(spark):
    rng = np.random.default_rng(5)
    rows = [(0.0, float(t), int(g == 0), float(g)) for g in (0, 1) for t in rng.weibull(1.5, 200) + 0.01]
    df = spark.createDataFrame(rows, "start double, stop double, ev int, g1 double")
    spec = SurvSpec("start", "stop", "ev")
    assert not aft.aft(df, spec, ["g1"], "weibull").converged
    assert not cox.cox(df, spec, ["g1"]).converged
    assert aft.aft(df.where("g1 = 0"), spec, [], "weibull").converged


def test_stratified_residuals_stay_in_their_stratum(spark):
    rng = np.random.default_rng(6)
    rows = [(0.0, float(np.ceil(4 * t)), int(e), float(x), int(s)) for t, e, x, s in zip(
        rng.weibull(1.2, 300) + 0.01, rng.integers(0, 2, 300), rng.normal(size=300), rng.integers(0, 3, 300))]
    rows += [(5.0, 5.0, 1, 0.0, 0)]  # not a valid interval
    df = spark.createDataFrame(rows, "start double, stop double, ev int, x double, s int")
    spec = SurvSpec("start", "stop", "ev")
    fit = cox.fixed_fit(df, spec, ["x"], [0.3], strata="s")
    r = cox.schoenfeld(fit, df, spec, keep=["s"]).toPandas()
    assert len(r) == sum(e for _, _, e, _, _ in rows[:-1])
    one = cox.fixed_fit(df.where("s = 1"), spec, ["x"], [0.3])
    alone = cox.schoenfeld(one, df.where("s = 1"), spec).toPandas()
    assert np.allclose(sorted(r[r.s == 1].r_x), sorted(alone.r_x))
    cs = cox.cox_snell(fit, df, spec, keep=["s"]).toPandas()
    assert len(cs) == 300 and abs(cs.cs_resid.sum() - cs.event.sum()) < 1e-6 * 300
    with pytest.raises(ValueError, match="terms"):
        cox.cox_snell(fit, df.drop("x"), spec)

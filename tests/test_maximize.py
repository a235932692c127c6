"""Second-order numbers, likelihoods of one's own, functions of coefficients and constraints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from survspan.functions import jets
from survspan.functions.jets import Jet
from survspan.functions.special import log_gammainc
from survspan.operators import aft, infer
from survspan.operators import maximize as ml
from survspan.operators.survival import SurvSpec
from survspan.plans.likelihood import CONS

SPEC = SurvSpec("s", "e", "ev")


def numeric(fn, at, h=1e-4):
    """Value, gradient and Hessian by central differences."""
    at = np.asarray(at, float)
    eye = np.eye(len(at)) * h

    def f(x):
        return fn(*Jet.variables(np.array([x]))).v[0]

    g = np.array([(f(at + e) - f(at - e)) / (2 * h) for e in eye])
    H = np.array([[(f(at + a + b) - f(at + a - b) - f(at - a + b) + f(at - a - b)) / (4 * h * h) for b in eye] for a in eye])
    return f(at), g, H


FUNCTIONS = {
    "arithmetic": lambda x, y: (x * y - 3.0 / x + y / (x + 2.0)) ** 3 - 1.0,
    "exp log": lambda x, y: jets.exp(x * 0.3) * jets.log(y) + jets.log(x * x + y),
    "tails": lambda x, y: jets.norm_log_sf(x - y * y) + jets.log1mexp(-x) * y,
    "lgamma": lambda x, y: jets.lgamma(x * y) + jets.lgamma(y),
    "where": lambda x, y: jets.where(np.array([True]), x * x, jets.log(y - 100.0)),
}


@pytest.mark.parametrize("name", FUNCTIONS)
@pytest.mark.parametrize("at", [(0.7, 1.9), (2.5, 0.4)])
def test_derivatives(name, at):
    j = FUNCTIONS[name](*Jet.variables(np.array([at])))
    f, g, H = numeric(FUNCTIONS[name], at)
    assert np.allclose(j.v, f) and np.allclose(j.g[0], g, rtol=1e-5, atol=1e-6) and np.allclose(j.h[0], H, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("a, x", [(0.3, 0.01), (0.3, 2.0), (2.0, 0.5), (2.0, 9.0), (25.0, 24.0), (25.0, 60.0), (400.0, 380.0), (1.5, 2.4)])
def test_incomplete_gamma(a, x):
    got = jets.log_gamma_sf(*Jet.variables(np.array([[a, x]])))
    _f, g, H = numeric(jets.log_gamma_sf, (a, x), 1e-4 * min(1.0, x, a))
    assert np.allclose(got.v[0], log_gammainc(np.array([a]), np.array([x]))[1][0], rtol=1e-10, atol=1e-12)
    assert np.allclose(got.g[0], g, rtol=1e-5, atol=1e-8) and np.allclose(got.h[0], H, rtol=2e-2, atol=1e-4)


def test_incomplete_gamma_edges(monkeypatch):
    a, x = Jet.variables(np.array([[2.0, 0.0], [np.nan, 1.0], [-1.0, 1.0], [3.0, 1.0]]))
    got = jets.log_gamma_sf(a, x)
    assert got.v[0] == 0 and np.isnan(got.v[1:3]).all() and np.isfinite(got.v[3])
    monkeypatch.setattr(jets, "MAX_TERMS", 3)
    assert np.isnan(jets.log_gamma_sf(a, x).v[3])  # not converged: NaN, not a wrong number


def rows(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    start = np.where(rng.random(n) < 0.5, 0.0, rng.uniform(0, 0.4, n))
    x = rng.integers(0, 2, n)
    stop = start + 0.05 + rng.gamma(1.5, 1.0 + 0.5 * x)
    data = [(float(a), float(b), int(rng.random() < 0.8), float(c)) for a, b, c in zip(start, stop, x)]
    return spark.createDataFrame(data + [(None, None, 1, 1.0), (0.0, 1.0, 1, None)], "s double, e double, ev int, x double")


@pytest.mark.parametrize("name, shape", [("ammag", ml.ammag), ("gamma", ml.standard_gamma)])
def test_user_likelihood_matches_the_family(spark, name, shape):
    df = rows(spark)
    family = aft.aft(df, SPEC, ["x"], name)
    fit = ml.maximize(aft.model_frame(df, SPEC, ["x"]), ml.gengamma_loglik(shape), [("mu", ["x", CONS]), ("lnsigma", [CONS])],
                      ["t0", "t", "d"], name=name)
    assert fit.converged and np.abs(fit.extra["score"]).max() < 1e-8
    assert np.allclose(fit.params, family.params, atol=1e-5) and np.allclose(fit.vcov, family.vcov, atol=1e-5)
    assert abs(fit.loglik - family.loglik) < 1e-6 and fit.n == family.n


def test_weights_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0), (None, 1.0), (2.0, None), (7.0, 1.0)], "y double, w double")

    def normal(eta, data):
        z = (-eta["mu"] + data["y"]) * jets.exp(-eta["ls"])
        return z * z * -0.5 - eta["ls"]

    fit = ml.maximize(df, normal, [("mu", [CONS]), ("ls", [CONS])], ["y"], weight="w")
    mean = (2 * 1 + 3 + 7) / 4
    sd = np.sqrt((2 * (1 - mean) ** 2 + (3 - mean) ** 2 + (7 - mean) ** 2) / 4)
    assert fit.converged and fit.n == 3 and np.allclose(fit.params, [mean, np.log(sd)], atol=1e-8)
    assert not ml.maximize(df.where("false"), normal, [("mu", [CONS]), ("ls", [CONS])], ["y"]).converged


def test_functions_and_constraints_of_fits(spark):
    df = rows(spark)
    good = aft.aft(df, SPEC, ["x"], "weibull", name="good")
    bad = aft.aft(df.withColumn("ev", F.lit(0)), SPEC, ["x"], "weibull", name="bad")
    other = aft.aft(df, SPEC, [], "exponential", name="other")
    fits = infer.fits_table(spark, [good, bad, other])
    hr = {r.model: r for r in ml.weibull_hazard_ratios(fits, ["x"]).collect()}
    b, s = good.coef("mu", "x"), np.exp(good.coef("lnsigma", CONS))
    i, k = good.index("mu", "x"), good.index("lnsigma", CONS)
    j = np.zeros(good.k)
    j[i], j[k] = -1 / s, b / s
    se = np.sqrt(j @ good.vcov @ j)
    assert np.isclose(hr["good"].hazard_ratio, np.exp(-b / s)) and np.isclose(hr["good"].se, np.exp(-b / s) * se)
    assert np.isclose(hr["good"].lo, np.exp(-b / s - infer.Z975 * se)) and hr["other"].hazard_ratio is None and hr["bad"].se is None
    joint = {r.model: r for r in ml.wald_constraints(fits, {"both": lambda b: [b["mu:x"] * 2.0, b[f"lnsigma:{CONS}"] - 0.1]}).collect()}
    c = np.array([2 * b, np.log(s) - 0.1])
    J = np.zeros((2, good.k))
    J[0, i], J[1, k] = 2, 1
    assert np.isclose(joint["good"].chi2, c @ np.linalg.solve(J @ good.vcov @ J.T, c)) and joint["good"].df == 2
    assert joint["other"].chi2 is None and joint["bad"].p is None


def test_special_cases(spark):
    """On gamma data the gamma stands and the lognormal falls."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(0.0, float(t), 1, 0.0) for t in rng.gamma(0.8, 2.0, 4000)], "s double, e double, ev int, x double")
    fit = aft.aft_ggamma(df, SPEC, name="gg")
    p = {r.test: r for r in ml.special_cases(infer.fits_table(spark, [fit])).collect()}
    assert set(p) == set(ml.SPECIAL_CASES) and p["gamma"].p > 0.01 and p["lognormal"].p < 1e-6 and p["exponential"].df == 2

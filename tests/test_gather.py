"""A fit's rounds read gathered rows, whose number does not grow with the design, and the rows confirm its maximum."""

import numpy as np
import pandas as pd
import pytest

from survspan.operators import aft, infer
from survspan.operators.survival import SurvSpec
from survspan.plans import likelihood
from survspan.plans.condense import MASS, gather_once
from survspan.plans.likelihood import CONS, batch_stats, evaluate, newton_lockstep

SPEC = SurvSpec("start", "stop", "ev")
EQS = [("mu", ["x", CONS]), ("lnsigma", [CONS]), ("kappa", ["x", CONS])]


def _rows(n, seed=3):
    rng = np.random.default_rng(seed)
    start = np.where(rng.random(n) < 0.2, 0.0, rng.exponential(5.0, n))
    return pd.DataFrame({"start": start, "stop": start + rng.weibull(1.3, n) * 4 + 0.01, "ev": (rng.random(n) < 0.2).astype(int),
                         "x": rng.integers(0, 2, n).astype(float), "w": rng.integers(0, 4, n) / 2.0})


@pytest.mark.parametrize("weight", [None, "w"])
def test_gathered_sums_equal_rows(spark, weight):
    design = aft.model_frame(spark.createDataFrame(_rows(6000)), SPEC, ["x"], weight)
    model, theta = aft.family_model("ggamma"), np.array([0.1, 1.5, 0.2, -0.1, 0.9])
    want = batch_stats(model, EQS, theta, design.toPandas(), weight)
    got = evaluate(gather_once(design, ["x"], weight), model, EQS, theta, MASS)
    assert abs(got[0] - want[0]) < 1e-10 * abs(want[0])
    assert np.allclose(got[1], want[1], rtol=1e-8, atol=1e-6)
    assert np.allclose(got[2], want[2], rtol=1e-5, atol=1e-2)  # second kappa derivatives are differences


def test_gathered_rows_do_not_grow(spark):
    few, many = (gather_once(aft.model_frame(spark.createDataFrame(_rows(n)).where("stop > 1 and (start = 0 or start > 1)"), SPEC, ["x"]),
                             ["x"]).count() for n in (4000, 16000))
    assert many < 1.4 * few


def test_times_that_are_not_finite_stay_rows(spark):
    design = spark.createDataFrame([(0.0, float("inf"), 0.0, 1.0), (0.0, float("nan"), 1.0, 1.0), (1.0, 2.0, 1.0, 1.0)], "t0 double, t double, d double, x double")
    odd = [r for r in gather_once(design, ["x"]).collect() if not np.isfinite(r["t"])]
    assert sorted((str(r["t"]), r["d"], r[MASS]) for r in odd) == [("inf", 0.0, 1.0), ("nan", 1.0, 1.0)]


@pytest.mark.parametrize("prepared", [False, True])
def test_fit_reads_its_rows_once(spark, monkeypatch, prepared):
    df = spark.createDataFrame(_rows(5000)).checkpoint()
    rows = aft.aft_ggamma(df, SPEC, ["x"], kappa=["x"])
    assert rows.extra["gathered"] is None  # a small design
    passes = []

    def counted(design, model, equations, theta, weight=None):
        passes.append((model.name, MASS if weight == MASS else "rows"))
        return evaluate(design, model, equations, theta, weight)
    monkeypatch.setattr(likelihood, "evaluate", counted)
    monkeypatch.setattr(aft, "SMALL_DESIGN", 1000)
    monkeypatch.setattr(aft, "PATTERN_ROWS", 100)
    fit = aft.aft_ggamma(df, SPEC, ["x"], kappa=["x"], prepared=prepared)
    assert passes.count(("weibull", "rows")) == passes.count(("ggamma", "rows")) == 1 and ("ggamma", MASS) in passes
    assert fit.converged and fit.n == 5000 and fit.iterations == rows.iterations
    assert np.allclose(fit.params, rows.params, atol=1e-7) and np.allclose(fit.vcov, rows.vcov, rtol=1e-4)
    assert abs(fit.loglik - rows.loglik) < 1e-9 * abs(rows.loglik)


def test_halvings_in_one_round():
    """Replicates whose steps are halved, taken after some halvings or given up: the same ends in fewer rounds."""
    def value(rep, th):  # concave; the true log-likelihood is lower away from where a step would start
        x = float(th[0])
        return -np.sqrt(1 + x * x) - (1e3 if rep == 3 and x != 5.0 else 0.0), np.array([-x / np.sqrt(1 + x * x)]), np.array([[-(1 + x * x) ** -1.5]])
    rounds = {False: 0, True: 0}

    def run(ahead):
        def evalr(active):
            rounds[ahead] += 1
            return {k: value(k[0] if ahead else k, th) for k, th in active.items()}
        return newton_lockstep(evalr, np.array([5.0]), [1, 2, 3], 50, ahead=ahead)
    one, many = run(True), run(False)
    for r in (1, 2, 3):
        assert np.array_equal(one[r][0], many[r][0]) and one[r][1] == many[r][1] and one[r][3:] == many[r][3:]
    assert one[1][3] and not one[3][3] and rounds[True] < rounds[False]


def test_fit_rows_are_local(spark):
    row = ("m#1", ["mu:_cons"], None, None, None, None, 1, 5, 2.0, False, "density")
    df = infer.fits_frame(spark, [row, ("m#2", ["mu:_cons"], [0.5], [float("nan")], -1.0, None, 1, 5, 2.0, True, "density")])
    got = df.collect()
    assert df.schema == infer.FITS_SCHEMA and tuple(got[0]) == row and np.isnan(got[1]["vcov"][0]) and got[1]["beta"] == [0.5]
    assert df.rdd.getNumPartitions() <= 2  # not a scan of pickled rows by every core

"""Golden numbers that need no data (FIXTURES.md section 4)."""

import math

import numpy as np
import pytest

from survspan.functions.gengamma import gg_hazard, gg_quantile, gg_survival, gg_taxonomy_label
from survspan.functions.special import chi2_sf

# Fixed values of the reference: final crude model parameters per group (mu, sigma, Q)
CRUDE = {1: (3.262489, .5965208, 1.0), 2: (3.1287, .410369, 1.687639),
         3: (2.818067, .4477858, 1 / .4477858), 4: (2.39798, .5708262, .5708262)}
RH = {5: (1.3047, 2.9372, 3.6342), 10: (1.3114, 2.6122, 4.0950), 15: (1.4879, 3.1071, 3.8972),
      20: (1.8052, 4.3343, 3.6081), 25: (2.2775, 6.5752, 3.3339), 30: (2.9288, 10.2334, 3.0935)}
RT = {.1: (.8096, .3110, .6014), .2: (.8372, .3976, .5327), .3: (.8405, .4509, .5005),
      .4: (.8326, .4857, .4813), .5: (.8175, .5072, .4685), .6: (.7968, .5181, .4598)}
SURV = {5: (.9393, .9134, .7643, .8461), 10: (.8187, .7650, .5299, .4887), 20: (.5276, .3906, .1248, .0895)}


def test_relative_hazards_numpy():
    for t, exp in RH.items():
        h = [gg_hazard(np.array([t]), *CRUDE[g])[0] for g in (1, 2, 3, 4)]
        got = [h[1] / h[0], h[2] / h[0], h[3] / h[0]]
        assert np.allclose(got, exp, atol=1e-4), (t, got, exp)


def test_relative_times_numpy():
    for p, exp in RT.items():
        q = [gg_quantile(np.array([p]), *CRUDE[g])[0] for g in (1, 2, 3, 4)]
        got = [q[1] / q[0], q[2] / q[0], q[3] / q[0]]
        assert np.allclose(got, exp, atol=1e-4), (p, got, exp)


def test_survival_numpy():
    for t, exp in SURV.items():
        got = [gg_survival(np.array([t]), *CRUDE[g])[0] for g in (1, 2, 3, 4)]
        assert np.allclose(got, exp, atol=1e-4), (t, got, exp)


def test_lr_pvalues_and_aic():
    assert abs(chi2_sf(1, 1.60868) - .20468) < 1e-5
    assert abs(chi2_sf(1, 3.17156) - .07493) < 1e-5
    assert abs(chi2_sf(6, 4.26006) - .64153) < 1e-5
    assert abs(chi2_sf(6, 5.50254) - .48115) < 1e-5
    assert abs(2 * (300.72771 - 299.92337) - 1.60868) < 1e-5
    for ll, k, aic in [(-300.72771, 5, 611.45542), (-299.92337, 6, 611.84674), (-297.79334, 12, 619.58668)]:
        assert abs(-2 * ll + 2 * k - aic) < 1e-5


def test_sigma_from_lnsigma():
    assert abs(math.exp(-.5378369) - .5840102) < 1e-7


def test_relative_curves_spark(spark):
    from pyspark.sql import functions as F
    from survspan.operators.contrast import relative
    params = spark.createDataFrame([(g, *CRUDE[g]) for g in CRUDE], "group int, mu double, sigma double, kappa double")
    rh = {(r["contrast"], r["x"]): r["ratio"] for r in relative(params, "hazard").collect()}
    for t, exp in RH.items():
        for k, e in zip((2, 3, 4), exp):
            assert abs(rh[(f"{k}:1", float(t))] - e) < 1e-4
    assert rh[("2:1", 0.0)] is None  # 0/0 at t = 0 -> null
    rt = {(r["contrast"], round(r["x"], 2)): r["ratio"] for r in relative(params, "quantile").collect()}
    for p, exp in RT.items():
        for k, e in zip((2, 3, 4), exp):
            assert abs(rt[(f"{k}:1", round(p, 2))] - e) < 1e-4


def _numeric_shape(sigma, kappa):
    t = np.exp(np.linspace(np.log(1e-4), np.log(1e4), 4000))
    h = gg_hazard(t, 0.0, sigma, kappa)
    dh = np.diff(np.log(h))
    ok = np.isfinite(dh)
    dh = dh[ok]
    up, down = dh > 1e-9, dh < -1e-9
    if up.all():
        return "increasing"
    if down.all():
        return "decreasing"
    first_up = np.argmax(up) if up.any() else None
    if dh[0] > 0 and dh[-1] < 0:
        return "arc"
    if dh[0] < 0 and dh[-1] > 0:
        return "bathtub"
    return "other"


@pytest.mark.parametrize("sigma,kappa", [(0.5, 1.5), (0.5, 0.3), (0.5, 3.0), (2.0, 1.2), (2.0, 0.2),
                                         (2.0, 3.0), (0.8, -0.5), (1.5, -1.0), (0.7, 1.2)])
def test_taxonomy_rule_matches_hazard(sigma, kappa):
    assert gg_taxonomy_label(sigma, kappa) == _numeric_shape(sigma, kappa)

"""Bootstrap rounds over condensed weights equal rounds over the rows and do not grow with them."""

import numpy as np
import pandas as pd
import pytest

from survspan.operators import aft
from survspan.operators.survival import SurvSpec
from survspan.plans.condense import LEAST_POINTS, condense
from survspan.plans.likelihood import CONS, batch_stats, evaluate_reps, poisson_weights

SPEC = SurvSpec("start", "stop", "ev")
EQS = [("mu", ["x", CONS]), ("lnsigma", [CONS]), ("kappa", ["x", CONS])]


def _rows(n, seed=3, levels=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, n) if levels else rng.normal(size=n)
    start = np.where(rng.random(n) < 0.2, 0.0, rng.exponential(5.0, n))
    stop = start + rng.weibull(1.3, n) * 4 + 1e-6
    return pd.DataFrame({"_rk": rng.integers(-2**62, 2**62, n), "start": start, "stop": stop,
                         "ev": (rng.random(n) < 0.2).astype(int), "x": x.astype(float)})


@pytest.mark.parametrize("levels", [2, 0])  # 0: no two rows share the covariate
def test_condensed_sums_equal_rows(spark, levels):
    pdf = _rows(6000 if levels else 600, levels=levels)
    pdf.loc[0, "x"] = 7.0  # a pattern of one row
    design = aft.model_frame(spark.createDataFrame(pdf), SPEC, ["x", "_rk"]).selectExpr("t0", "t", "d", "x", "cast(_rk as long) _rk")
    rows = design.toPandas()
    reps = [1, 2, 3, 5]
    small = condense(design, ["x"], reps, 11)
    n = small.count()
    assert n < 4000 if levels else n <= 2 * len(rows)
    model = aft.family_model("ggamma")
    thetas = {r: np.array([0.1, 1.5 + 0.05 * r, 0.2, -0.1, 0.9]) for r in (1, 3, 5)}  # replicate 2 has ended
    got = evaluate_reps(small, model, EQS, thetas, 11, drawn=reps)
    for r, th in thetas.items():
        rows["w"] = poisson_weights(rows["_rk"].to_numpy(), np.array([r]), 11)[:, 0]
        ll, g, H = batch_stats(model, EQS, th, rows, "w")
        assert abs(got[r][0] - ll) < 1e-9 * abs(ll)
        assert np.allclose(got[r][1], g, rtol=1e-7, atol=1e-5)
        assert np.allclose(got[r][2], H, rtol=1e-5, atol=1e-2)  # second kappa derivatives are differences


def test_condensed_rows_do_not_grow(spark):
    """The rows of a round, 8 000 and 32 000 intervals on the same times."""
    sizes = []
    for n in (8000, 32000):
        design = aft.model_frame(spark.createDataFrame(_rows(n)), SPEC, ["x", "_rk"]).selectExpr("t0", "t", "d", "x", "cast(_rk as long) _rk")
        small = condense(design.where("t > 1 and (t0 = 0 or t0 > 1)"), ["x"], [1, 2], 11)
        assert small.where("_mass is null").count() <= 8 * LEAST_POINTS * 60
        sizes.append(small.count())
    assert sizes[1] < 1.5 * sizes[0]


def test_times_that_are_not_finite_stay_points(spark):
    pdf = _rows(200)
    design = spark.createDataFrame(pd.DataFrame({"t0": 0.0, "t": [np.inf, np.nan, *pdf["stop"]], "d": 0.0, "x": 1.0, "_rk": range(202)}))
    small = condense(design, ["x"], [1], 11).toPandas()
    assert sorted(map(str, small[~np.isfinite(small["t"])]["t"])) == ["inf", "nan"]
    assert small[~np.isfinite(small["t"])]["_mass"].isna().all()

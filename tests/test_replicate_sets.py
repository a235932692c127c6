"""Risk sets for Cox replicates: sums by pattern equal sums with covariates, and the first scan is made once."""

import numpy as np
import pytest

from survspan.operators import cox
from survspan.operators.survival import SurvSpec
from survspan.plans import risksets as rs

SPEC = SurvSpec("start", "stop", "ev")


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(9)
    n = 3000
    start = np.round(rng.exponential(3.0, n), 1)
    rows = list(zip(start.tolist(), (start + np.round(rng.weibull(1.2, n) * 3, 1) + 0.1).tolist(), (rng.random(n) < 0.2).astype(int).tolist(),
                    (rng.integers(0, 3, n) + 1000.0).tolist(), rng.integers(0, 2, n).tolist(), rng.integers(-2**62, 2**62, n).tolist(),
                    [None if x == 0 else int(x) for x in rng.integers(0, 3, n)]))
    df = spark.createDataFrame(rows, "start double, stop double, ev int, x double, y int, _rk long, s int")
    return cox.cox_design(df, SPEC, ["x", "y"], "s", keep=["_rk"]).checkpoint()


def test_patterns_equal_covariates(spark, design, monkeypatch):
    monkeypatch.setattr(rs, "ROWS_PER_PART", 500)
    monkeypatch.setattr(rs, "CHUNK_NUMBERS", 1)  # chunks of 256 records cut groups
    few = rs.replicate_sets(design, ["x", "y"], "_rk")
    many = rs.risk_sets(design, ["x", "y"], key="_rk", rows_per_part=500)
    assert few.terms == [] and len(few.patterns) == 6 and many.terms == ["x", "y"]
    reps, theta = np.array([1, 4, 9]), np.array([[0.2, -0.4], [0.0, 0.0], [-0.3, 0.1]])
    kept: dict = {}
    for _ in range(2):
        a = rs.risk_stats(few, theta, reps=reps, seed=5, kept=kept)
        b = rs.risk_stats(many, theta, reps=reps, seed=5)
        for x, y in zip(a, b):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-7)
        theta = theta[1:] + 0.1
        reps = reps[1:]


def test_many_patterns_keep_covariates(spark, design, monkeypatch):
    monkeypatch.setattr(rs, "FEW_PATTERNS", 5)
    assert rs.replicate_sets(design, ["x", "y"], "_rk").terms == ["x", "y"]


def test_first_scan_is_made_once(spark, design, monkeypatch):
    sets = rs.replicate_sets(design, ["x", "y"], "_rk")
    kept: dict = {}
    reps = np.array([1, 2])
    one = rs.risk_stats(sets, np.zeros((2, 2)), reps=reps, seed=5, kept=kept)
    assert {1, 2} <= set(kept)
    frames = rs.pass_frames

    def no_first(*args):
        kernel, _totals, second = frames(*args)
        return kernel, None, second
    monkeypatch.setattr(rs, "pass_frames", no_first)
    two = rs.risk_stats(sets, np.zeros((2, 2)), reps=reps, seed=5, kept=kept)
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])

"""Risk-set passes over sorted records: against the shuffled passes, brute force and repeated rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from survspan.operators import cox, resample
from survspan.operators.survival import SurvSpec
from survspan.plans import risksets as rs
from survspan.plans.likelihood import poisson_weights

SPEC = SurvSpec("s", "e", "ev")
TERMS = ["x", "z"]
BETA = np.array([0.3, -0.5])


def cohort(spark, n=900, seed=1):
    """Rounded times (many ties), a hot event time, null strata, null starts."""
    rng = np.random.default_rng(seed)
    start = np.round(rng.uniform(0, 5, n), 1)
    stop = np.round(start + rng.exponential(2, n) + 0.1, 1)
    stop[::4] = 6.0
    rows = [(i, None if i % 9 == 0 else float(a), float(b), int(rng.random() < 0.4), float(rng.normal() + 3),
             float(rng.integers(0, 3)), int(rng.integers(0, 3)) if i % 50 else None)
            for i, (a, b) in enumerate(zip(start, stop))]
    return spark.createDataFrame(rows, "id long, s double, e double, ev int, x double, z double, st int")


@pytest.fixture(scope="module")
def df(spark):
    return cohort(spark).cache()


@pytest.mark.parametrize("strata", [None, "st"])
@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_passes_match_the_shuffled_ones(df, strata, ties, monkeypatch):
    design = cox.cox_design(df, SPEC, TERMS, strata)
    ll, u, info = cox.cox_stats(design, TERMS, BETA, None, ties)
    for rows_per_part, chunk in ((1 << 17, 1 << 21), (60, 1)):
        monkeypatch.setattr(rs, "CHUNK_NUMBERS", chunk)
        sets = rs.risk_sets(design, TERMS, rows_per_part=rows_per_part)
        got = rs.risk_stats(sets, BETA, ties == "efron")
        assert abs(got[0][0] - ll) < 1e-8 and np.allclose(got[1][0], u, atol=1e-8) and np.allclose(got[2][0], info, atol=1e-7)
    assert sets.parts > 20  # event times are cut by partitions there


def test_no_record_moves_in_a_pass(df):
    sets = rs.risk_sets(cox.cox_design(df, SPEC, TERMS), TERMS, rows_per_part=200)
    _kernel, first, second = rs.pass_frames(sets, BETA)
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
    plan = second({})._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInPandas"):]
    assert "Aggregate" not in below and "Join" not in below and "Sort" not in below and "Repartition" not in below


def test_hot_time_is_cut(df):
    """A quarter of all rows ends at one time; no partition holds them all."""
    sets = rs.risk_sets(cox.cox_design(df, SPEC, TERMS), TERMS, rows_per_part=100)
    most = sets.records.where("_time = 6").groupBy("_part").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert most[1] > 1 and most[0] < 250


def test_large_covariates_do_not_overflow(df):
    """Centring: adding a constant to a covariate changes nothing."""
    far = df.withColumn("x", F.col("x") + 5000.0)
    near, moved = (cox.cox(d, SPEC, TERMS) for d in (df, far))
    assert moved.converged and np.allclose(near.params, moved.params, atol=1e-8) and abs(near.loglik - moved.loglik) < 1e-7


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_time_varying_equals_split_episodes(df, ties, monkeypatch):
    def texp(t):
        return F.log(t + 1.0)

    d = df.where("x > 2")
    fit = cox.cox_tvc(d, SPEC, ["x", "z"], ["z"], texp, strata="st", ties=ties)
    split = cox._cox_tvc_split(d, SPEC, ["x", "z"], ["z"], texp, "st", ties, 50, "split")
    assert fit.converged and fit.names == split.names
    assert np.allclose(fit.params, split.params, atol=1e-7) and np.allclose(fit.vcov, split.vcov, atol=1e-8)
    assert abs(fit.loglik - split.loglik) < 1e-7


def test_many_patterns_take_the_other_exact_way(df, monkeypatch):
    monkeypatch.setattr(rs, "MAX_PATTERNS", 2)
    few = cox.cox_tvc(df.where("z < 2"), SPEC, ["x"], ["z"], lambda t: t)
    assert "risk_sets" in few.extra and few.extra["risk_sets"].tvc == ["z"]
    many = cox.cox_tvc(df, SPEC, ["x"], ["z"], lambda t: t)
    monkeypatch.setattr(rs, "MAX_PATTERNS", 256)
    again = cox.cox_tvc(df, SPEC, ["x"], ["z"], lambda t: t)
    assert np.allclose(many.params, again.params, atol=1e-7)


def test_empty_and_eventless(spark, df):
    none = df.where("false")
    sets = rs.risk_sets(cox.cox_design(none, SPEC, TERMS), TERMS)
    ll, u, info = rs.risk_stats(sets, BETA)
    assert ll[0] == 0 and not u.any() and not info.any()
    assert not cox.cox(df.withColumn("ev", F.lit(0)), SPEC, TERMS).converged


def test_bootstrap_equals_repeated_rows(spark, df):
    """A replicate's fit is the fit of a table that holds each row as often as its weight says."""
    start = cox.cox(df, SPEC, TERMS)
    reps = {r.rep: r for r in resample.bootstrap_cox(df, SPEC, ["id"], start, reps=20, seed=7).collect()}
    assert sum(r.converged for r in reps.values()) >= 18
    keyed = df.withColumn("_rk", F.xxhash64("id")).toPandas()
    for rep in (1, 13):
        n = poisson_weights(keyed["_rk"].to_numpy(), np.array([rep]), 7)[:, 0].astype(int)
        copies = spark.createDataFrame(list(zip(keyed["id"].tolist(), n.tolist())), "id long, copies int")
        again = df.join(copies, "id").where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        fit = cox.cox(again, SPEC, TERMS)
        assert np.allclose(reps[rep].beta, fit.params, atol=1e-6)
        assert abs(reps[rep].loglik - fit.loglik) < 1e-6


def test_bootstrap_in_chunks_and_partitions(df, monkeypatch):
    start = cox.cox(df, SPEC, TERMS)
    whole = {r.rep: r.beta for r in resample.bootstrap_cox(df, SPEC, ["id"], start, reps=6, seed=3).collect()}
    monkeypatch.setattr(rs, "DRIVER_NUMBERS", 1)  # one replicate per scan
    monkeypatch.setattr(rs.risk_sets, "__defaults__", (*rs.risk_sets.__defaults__[:-1], 150))
    cut = {r.rep: r.beta for r in resample.bootstrap_cox(df.repartition(5), SPEC, ["id"], start, reps=6, seed=3).collect()}
    assert all(np.allclose(whole[r], cut[r], atol=1e-8) for r in whole)

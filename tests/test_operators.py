"""Hand-made cases (FIXTURES.md section 5) and properties of the operators."""

from pyspark.sql import functions as F

from conftest import SF001, rows
from survspan.operators import clean, describe, periods, survival
from survspan.plans.scan import BLOCK, mark_blocks

SPEC = periods.SubjectSpec()


def _frame(spark, data, schema, hot=False):
    df = spark.createDataFrame(data, schema).withColumn(BLOCK, F.lit(0).cast("long"))
    return mark_blocks(df, hot)


OUT_ROWS = [("A", 1, 0, 60.0), ("A", 2, 0, None), ("A", 3, 0, 28.0), ("A", 4, 1, 20.0),
            ("B", 1, 0, 50.0), ("B", 2, 0, None), ("B", 3, 0, None),
            ("D", 1, 0, None), ("D", 2, 0, 20.0)]
OUT_SCHEMA = "id string, visit int, status int, gfr double"


def test_composite_outcome_truncate_trim(spark):
    for hot in (False, True):
        df = _frame(spark, OUT_ROWS, OUT_SCHEMA, hot)
        o = periods.composite_outcome(df, SPEC, "status", "gfr", floor=15, drop=0.5)
        got = {(r["id"], r["visit"]): r["outcome"] for r in o.collect()}
        assert [got[("A", v)] for v in (1, 2, 3, 4)] == [0, None, 1, 1]
        assert [got[("B", v)] for v in (1, 2, 3)] == [0, None, None]
        assert [got[("D", v)] for v in (1, 2)] == [None, 0]
        t = periods.truncate_at_first(o, SPEC, "outcome")
        assert sorted((r["id"], r["visit"]) for r in t.collect() if r["id"] == "A") == [("A", 1), ("A", 2), ("A", 3)]
        tr = periods.trim_unknown_tail(t, SPEC, "outcome")
        got = {(r["id"], r["visit"]): r["outcome"] for r in tr.collect()}
        assert [got[("A", v)] for v in (1, 2, 3)] == [0, 0, 1]
        assert got[("B", 1)] == 0 and ("B", 2) not in got
        assert [got[("D", v)] for v in (1, 2)] == [0, 0]


def test_prevalent(spark):
    df = _frame(spark, [("C", 1, 0.0, 1), ("E", 1, 0.0, 0), ("E", 2, 1.0, 1)], "id string, visit int, b_start double, outcome int")
    out = periods.drop_prevalent(df, SPEC, "b_start", "outcome")
    assert sorted(r["id"] for r in out.collect()) == ["E", "E"]


def test_fill_downup(spark):
    for hot in (False, True):
        df = _frame(spark, [("a", 1, None), ("a", 2, 3), ("a", 3, None), ("b", 1, None), ("b", 2, None)],
                    "id string, visit int, x int", hot)
        out = periods.fill(df, ["x"], SPEC, "downup")
        got = {(r["id"], r["visit"]): r["x"] for r in out.collect()}
        assert [got[("a", v)] for v in (1, 2, 3)] == [3, 3, 3]
        assert [got[("b", v)] for v in (1, 2)] == [None, None]


def test_cut(spark):
    vals = [0.0, 49.999, 50.0, 90.0, 95.0, 100.9, 101.0, -1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["g"] for r in clean.cut(df, "x", clean.BP_BREAKS, out="g").collect()]
    assert got == [1, 1, 2, 3, 4, 4, None, None, None]


def test_joint_group(spark):
    df = _frame(spark, [("s", 1, 1, 2), ("s", 2, 3, 1), ("n", 1, 1, 2), ("n", 2, None, 1)],
                "id string, visit int, a int, b int")
    sub = {(r["id"], r["visit"]): r["j"] for r in periods.joint_group(df, "a", "b", SPEC, "subject", "j").collect()}
    row = {(r["id"], r["visit"]): r["j"] for r in periods.joint_group(df, "a", "b", SPEC, "row", "j").collect()}
    assert (sub[("s", 1)], sub[("s", 2)]) == (3, 3) and (row[("s", 1)], row[("s", 2)]) == (2, 3)
    assert (sub[("n", 1)], sub[("n", 2)]) == (None, None) and (row[("n", 1)], row[("n", 2)]) == (2, None)


def test_delayed_entry_km(spark):
    df = spark.createDataFrame([(0.0, 3.0, 1), (0.0, 5.0, 0), (2.0, 5.0, 1), (4.0, 6.0, 1)], "s double, e double, d int")
    spec = survival.SurvSpec("s", "e", "d")
    km = {r["time"]: r for r in survival.kaplan_meier(df, spec).collect()}
    assert (km[3.0]["n_risk"], km[3.0]["n_event"]) == (3, 1) and abs(km[3.0]["surv"] - 2 / 3) < 1e-12
    assert (km[5.0]["n_risk"], km[5.0]["n_event"]) == (3, 1) and abs(km[5.0]["surv"] - 4 / 9) < 1e-12
    assert (km[6.0]["n_risk"], km[6.0]["n_event"]) == (1, 1) and km[6.0]["surv"] == 0.0
    at = {r["time"]: r["surv"] for r in survival.km_at(df, spec, [1.0, 4.0, 5.0]).collect()}
    assert at[1.0] == 1.0 and abs(at[4.0] - 2 / 3) < 1e-12 and abs(at[5.0] - 4 / 9) < 1e-12


def test_exit_before_entry(spark):
    df = spark.createDataFrame([(5.0, 5.0, 1), (6.0, 4.0, 0), (1.0, 2.0, 1)], "s double, e double, d int")
    valid, rep = survival.surv_set(df, survival.SurvSpec("s", "e", "d"))
    assert valid.count() == 1
    assert {r["reason"]: r["n"] for r in rep.collect()} == {"exit <= entry": 2, "ok": 1}


def test_percentile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (7.5,)], "x double")
    q = describe.quantiles(df, "x", [.05, .25, .5, .95], names=["a", "b", "c", "d"]).collect()[0]
    assert [round(q[k], 9) for k in "abcd"] == [1.15, 1.75, 3.0, 6.975]


def test_partition_invariance(spark):
    from survspan.operators import cohort
    from survspan.sources.person_period import events_person_periods
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    a = cohort.locf(events_person_periods(ev))
    b = cohort.locf(events_person_periods(ev.repartition(7, "event_id").sortWithinPartitions(F.rand(3))))
    cols = ["id", "visit", "t_start", "t_stop", "outcome", "bp_group"]
    assert rows(a, cols) == rows(b, cols)


def test_trend_matches_numpy(spark):
    import numpy as np
    from survspan.sources.person_period import person_periods
    pp = person_periods(spark, SF001)
    fit = {r["t"]: r["fit"] for r in survival.trend(pp, "t_stop", "sbp").collect()}
    pdf = pp.select("t_stop", "sbp").dropna().toPandas()
    u = pdf.t_stop.to_numpy() / 30.0

    def basis(x):
        cols = [np.ones_like(x), x, x ** 2, x ** 3] + [np.maximum(x - k / 30.0, 0) ** 3 for k in (7.5, 15.0, 22.5)]
        return np.column_stack(cols)
    beta = np.linalg.lstsq(basis(u), pdf.sbp.to_numpy(), rcond=None)[0]
    for t, v in fit.items():
        assert abs(basis(np.array([t / 30.0])) @ beta - v)[0] < 1e-6

"""Blocked (hot-subject) scans must equal plain window scans."""

from pyspark.sql import functions as F

from conftest import SF001, rows
from survspan.operators import cohort, periods
from survspan.plans.scan import blocks_for_hot_groups, blocks_from_quantiles, is_hot, mark_blocks, ordered_scan
from survspan.sources.person_period import PP_COLUMNS, events_person_periods


def _pp(spark, block_rows):
    return events_person_periods(spark.read.parquet(f"{SF001}/events.parquet"), block_rows=block_rows)


def test_hot_detection(spark):
    assert not is_hot(_pp(spark, 1 << 16), "_blk")
    assert is_hot(_pp(spark, 7), "_blk")


def test_person_periods_blocked_equal(spark):
    plain = _pp(spark, 1 << 16).select(*PP_COLUMNS)
    hot = _pp(spark, 7).select(*PP_COLUMNS)
    assert rows(plain) == rows(hot)
    assert plain.count() == 985  # FIXTURES: 985 rows at sf0.001


def test_locf_chain_blocked_equal(spark):
    spec_small = periods.SubjectSpec(block_rows=5)
    plain = cohort.locf(_pp(spark, 1 << 16))
    hot = cohort.locf(_pp(spark, 5), spec_small)
    cols = ["id", "visit", "t_start", "t_stop", "outcome", "sbp", "dbp", "bp_group", "income"]
    assert rows(plain, cols) == rows(hot, cols)


def test_scan_ops_blocked_equal(spark):
    pp_plain = _pp(spark, 1 << 16)
    pp_hot = _pp(spark, 3)
    ops = dict(row_number="rn", count="n", cumsum={"cs": "measure"}, lag={"lg": "sbp"}, lead={"ld": "sbp"},
               fill_down={"fd": "dbp"}, fill_up={"fu": "dbp"}, first={"f1": "measure"}, last={"l1": "measure"},
               total={"tot": "t_stop"}, maximum={"mx": "sbp"}, minimum={"mn": "sbp"})
    a = ordered_scan(pp_plain, ["id"], ["visit"], **ops)
    b = ordered_scan(pp_hot, ["id"], ["visit"], **ops)
    cols = ["id", "visit", "rn", "n", "cs", "lg", "ld", "fd", "fu", "f1", "l1", "tot", "mx", "mn"]
    ra, rb = rows(a, cols), rows(b, cols)
    assert len(ra) == 985
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) < 1e-6 * max(1, abs(u))
            else:
                assert u == v


def test_time_quantile_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 0.5).alias("t"), F.lit(1).alias("one"))
    b = blocks_from_quantiles(df, "t", 8)
    assert is_hot(b, "_blk")
    s = ordered_scan(b, ["g"], ["t"], cumsum={"c": "one"}, row_number="rn")
    r = s.filter((F.col("g") == 1)).select("rn", "c").collect()
    assert all(x["rn"] == x["c"] for x in r) and max(x["rn"] for x in r) == 333


def test_fill_max_gap_blocked_equal(spark):
    plain = periods.fill(_pp(spark, 1 << 16), ["sbp", "dbp"], direction="downup", max_gap=1)
    hot = periods.fill(_pp(spark, 4), ["sbp", "dbp"], periods.SubjectSpec(block_rows=4), "downup", max_gap=1)
    cols = ["id", "visit", "sbp", "dbp"]
    assert rows(plain, cols) == rows(hot, cols)


def test_time_blocked_curves_equal_plain(spark, monkeypatch):
    """KM, risk table and Cox with many small time blocks equal the single-block plan."""
    import numpy as np
    from survspan.operators import cohort, cox, survival
    from survspan.plans import scan as scan_mod
    d = cohort.survival_design(cohort.locf(_pp(spark, 1 << 16)))
    spec = survival.SurvSpec("t_start", "t_stop", "outcome")
    cols = ["sbp_group", "time", "n_risk", "n_event", "surv", "std_err"]
    plain_km = rows(survival.kaplan_meier(d, spec, ["sbp_group"]), cols)
    plain_at = rows(survival.km_at(d, spec, [5.0, 10.0, 20.0], ["sbp_group"]))
    plain_cox = cox.cox(d, spec, ["sbp_group2", "lbw"])
    monkeypatch.setattr(scan_mod, "TIME_BLOCK_ROWS", 37)
    blocked = survival.kaplan_meier(d, spec, ["sbp_group"])
    assert is_hot(blocked, "_blk")
    assert plain_km == rows(blocked, cols)
    assert plain_at == rows(survival.km_at(d, spec, [5.0, 10.0, 20.0], ["sbp_group"]))
    hot_cox = cox.cox(d, spec, ["sbp_group2", "lbw"])
    assert abs(hot_cox.loglik - plain_cox.loglik) < 1e-9 and np.allclose(hot_cox.params, plain_cox.params, atol=1e-9)


def _groups(spark, sizes, null_order=False):
    rows = [(f"g{i}", None if null_order else float(j % 7 if i == 0 else j), i * 1000 + j) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "k string, t double, u long")


def test_many_tied_hot_groups_get_blocks_of_their_own_size(spark):
    df = blocks_for_hot_groups(_groups(spark, [20] * 20 + [3] * 50), ["k"], "t", block_rows=10)
    sizes = df.groupBy("_blk").count().toPandas().set_index("_blk")["count"]
    assert sizes[0] == 150 and sizes.drop(0).sum() == 400 and len(sizes) <= 45
    got = ordered_scan(df, ["k"], ["t", "u"], row_number="rn", cumsum={"s": "u"})
    want = _groups(spark, [20] * 20 + [3] * 50).toPandas().sort_values(["k", "t", "u"])
    want["rn"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["u"].cumsum()
    assert sorted(map(tuple, got.select("k", "u", "rn", "s").collect())) == sorted(
        want[["k", "u", "rn", "s"]].itertuples(index=False, name=None))


def test_hot_group_with_null_order_column(spark):
    df = blocks_for_hot_groups(_groups(spark, [50, 2], null_order=True), ["k"], "t", block_rows=10)
    got = ordered_scan(df, ["k"], ["t", "u"], row_number="rn")
    assert sorted(r.rn for r in got.where("k = 'g0'").collect()) == list(range(1, 51))


def test_quantile_cuts_reach_the_block_size(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    out = blocks_from_quantiles(df, "v", n_blocks=2000)
    assert out.groupBy("_blk").count().agg(F.max("count")).first()[0] <= 100


def test_clusters_must_name_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    import pytest

    from survspan.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(fake)

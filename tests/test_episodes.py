"""Episodes are made where they leave the query: no shuffle of their rows, at any number of cuts."""

import re

import pytest

from conftest import rows
from survspan.operators import cox
from survspan.operators.survival import SurvSpec
from survspan.plans.scan import materialize

SPEC = SurvSpec("s", "e", "ev")
NAN = float("nan")
INTERVALS = [(1, 0.0, 5.0, 1), (2, 2.0, 2.0, 1), (3, 5.0, 1.0, 1), (4, None, 3.0, 1), (5, 3.0, None, 1), (6, None, None, 1),
             (7, 1.0, NAN, 1), (8, 0.5, 20.0, 0), (8, 0.5, 20.0, 0), (9, 1.0, 2.0, None), (10, -3.0, 1.0, 1), (11, 7.0, 9.0, 1)]


def _frames(spark, cuts):
    return (spark.createDataFrame(INTERVALS, "id int, s double, e double, ev int"),
            spark.createDataFrame([(c,) for c in cuts], "c double"))


def _expected(cuts):
    cuts = sorted({c for c in cuts if c is not None and c == c})
    out = []
    for i, s, e, ev in INTERVALS:
        if s is None or e is None:
            out += [(i, None, x, ev if e is not None else 0) for x in (s, e) if x is not None]
            continue
        inner = [c for c in cuts if c > s and (c < e or e != e)]
        at = [s, *inner, e] if s < e or e != e else [e, s]
        out += [(i, a, b, ev if b == e or b != b else 0) for a, b in zip(at, at[1:])]
    return sorted(map(str, out))


@pytest.mark.parametrize("n_bins", [None, 1, 3, 5])
@pytest.mark.parametrize("cuts", [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.5, None, NAN], [2.0], []])
def test_odd_intervals(spark, cuts, n_bins):
    d, c = _frames(spark, cuts)
    got = cox.split_episodes_join(d, SPEC, c, keep=["id"], n_bins=n_bins).collect()
    assert sorted(str(tuple(r)) for r in got) == _expected(cuts)


def test_episodes_are_not_shuffled(spark):
    d = spark.range(300).selectExpr("id", "cast(id % 50 as double) s", "cast(id % 50 + 400 as double) e", "1 as ev")
    c = spark.range(500).selectExpr("cast(id as double) c")
    got = cox.split_episodes_join(d, SPEC, c, keep=["id"], n_bins=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("inline(")]
    assert not re.search("Exchange|Window|Sort", above)
    assert rows(got) == rows(cox.split_episodes(d, SPEC, [float(x) for x in range(500)], keep=["id"]))


def _records_shuffled(df):
    """Rows that the exchanges of df wrote in its own run."""
    df.collect()
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            total += p.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_shuffled_intervals_do_not_grow_with_cuts(spark):
    """Intervals over 40 of 50 chunks go to a bin or two, not to every chunk's task."""
    d = spark.range(1000).selectExpr("id", "cast(id % 10 as double) s", "cast(id % 10 + 80 as double) e", "cast(id % 2 as int) ev")
    c = spark.range(100).selectExpr("cast(id as double) c")
    got = cox.split_episodes_join(d, SPEC, c, keep=["id"], n_bins=50)
    assert 1000 <= _records_shuffled(got) < 10_000
    assert rows(got) == rows(cox.split_episodes(d, SPEC, [float(x) for x in range(100)], keep=["id"]))


@pytest.mark.parametrize("prepared", [False, True])
@pytest.mark.parametrize("chunks_per_bin,group_rows", [(1, 1 << 17), (3, 2), (64, 5)])
def test_bins_of_any_width(spark, monkeypatch, chunks_per_bin, group_rows, prepared):
    """Few long intervals among many short ones, some twice; bins of one chunk, of several and of all, small groups."""
    monkeypatch.setattr(cox, "CHUNKS_PER_BIN", chunks_per_bin)
    monkeypatch.setattr(cox, "GROUP_ROWS", group_rows)
    d = spark.range(120).selectExpr("cast(id % 100 as int) id", "cast(id % 100 as double) / 4 s",
                                    "cast(id % 100 as double) / 4 + if(id % 100 % 9 = 0, 60, 1.5) e", "cast(id % 2 as int) ev")
    c = spark.range(200).selectExpr("cast(id as double) / 3 c")
    got = cox.split_episodes_join(materialize(d) if prepared else d, SPEC, c, keep=["id"], n_bins=20, prepared=prepared)
    assert rows(got) == rows(cox.split_episodes(d, SPEC, [x / 3 for x in range(200)], keep=["id"]))

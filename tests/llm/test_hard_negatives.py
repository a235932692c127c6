"""Hard negatives against brute force, and the packed products against plain ones."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from survspan.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<float>, label int, score string, part long, row int, v int"


def brute(rows):
    live = []
    for vec_id, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        live.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in e]))

    def order(x):
        return -x[0], x[1] is None, x[1] or 0

    out = []
    for i, (anchor, label, v) in enumerate(live):
        if anchor is None or anchor % 50:
            continue
        others = [(sum(a * b for a, b in zip(v, w)), k, other) for j, (k, other, w) in enumerate(live) if j != i]
        positives = sorted((x for x in others if x[2] == label), key=order)[:5]
        for p, pid, _ in positives:
            inside = sorted((x for x in others if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p), key=order)[:3]
            out += [(anchor, pid, r + 1, k, p, s) for r, (s, k, _) in enumerate(inside)]
    return sorted(out, key=str)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, hn.op12_hard_negatives(df).collect()), key=str)


def hard_vectors(n=160, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        e = [float(x) for x in rng.integers(-3, 6, dims) / 4]  # many ties
        rows.append((int(rng.integers(0, 30)) * 10 if i % 3 else i, e, int(rng.integers(0, 3)) if i % 5 else 0))
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * dims, 1), (None, [1.0] * dims, 2), (50, None, 1), (100, [1.0] * dims, None), (100, [1.0, None], 1),
             (100, [nan] * dims, 1), (150, [inf] + [1.0] * (dims - 1), 1), (200, [], 1), (200, [0.5], 2), (0, [0.0] * dims, 4)]
    return rows + [rows[0], rows[3], rows[3]]


@pytest.mark.parametrize("a, v, merged, at_once", [(2048, 4096, 20_000, 1 << 21), (2, 7, 4, 64)])
def test_brute_force(spark, monkeypatch, a, v, merged, at_once):
    for name, x in (("ANCHOR_BLOCK", a), ("VECTOR_BLOCK", v), ("MERGED", merged), ("SCORES_AT_ONCE", at_once)):
        monkeypatch.setattr(hn, name, x)
    rows = hard_vectors()
    want = brute(rows)
    assert len(want) > 30 and mined(spark, rows) == want


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [], 1), (1, [], 1), (2, [], 2)]) == brute([(50, [], 1), (1, [], 1), (2, [], 2)])


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, hn.op12_hard_negatives(df).collect()), key=str) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 12), st.integers(1, 5), st.sampled_from([1, 300, 1 << 20, 1 << 28]), st.integers(1, 9), st.integers(0, 99))
def test_packed_products(n, anchors, most, dims, seed):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-most, most + 1, (anchors, dims)), rng.integers(-most, most + 1, (n, dims))
    packing = hn.Packing(int(min(a.min(), c.min(initial=0))), int(max(a.max(), c.max(initial=0))), dims)
    assert packing.doubles == (packing.fields * packing.width <= 53)
    assert (packing.scores(a, c) == a @ c.T).all()


def test_huge_components(spark):
    rows = [(50, [3e6, -2e5], 1), (1, [2e6, 1.0], 1), (2, [1.5e6, 0.0], 2), (3, [1.9e6, 5e5], 2)]
    assert mined(spark, rows) == brute(rows)

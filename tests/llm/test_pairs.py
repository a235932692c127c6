"""Near duplicates, repeated passages and nearest vectors against brute force."""

import hashlib
import re

import numpy as np
import pytest

from corpus_rows import empty, hard, small  # noqa: F401  (fixtures)
from survspan.llm import exact_topk, jaccard_join, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def near(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op3_jaccard_join(docs).collect()), key=str)


@pytest.mark.parametrize("hot", [64, 2])
def test_components_match_brute_force(hard, small, hot, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LOCAL_HOT", hot)
    for docs in (hard, small):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert near(docs) == brute_components(rows)


def test_chain_of_edits_and_hubs(spark):
    """Versions that drift apart: neighbours are similar, the ends are not."""
    words = [f"v{i}" for i in range(200)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        words = words[4:] + [f"n{k}_{j}" for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert near(docs) == brute_components(rows)


def test_join_on_nothing(empty):
    assert near(empty) == []


def test_one_row_of_every_component_stays(spark):
    """Components without any doc_id, rows that share the smallest doc_id, rows without words, clashing columns."""
    def text(k, tail="same end"):
        return " ".join(f"{k}{i}" for i in range(60)) + " " + tail

    names = ["_row", "row", "kept", "tie", "component", "key", "d.e"]
    rows = [(None, text("a")), (None, text("a", "other end")), (3, text("b")), (3, text("b", "other end")), (3, text("b", "a third end")),
            (5, text("b")), (None, text("b")), (7, text("c")), (7, text("c")), (8, "one two"), (9, "one two"), (10, ""), (11, None),
            (None, None), (None, None), (12, text("d"))]
    docs = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names]).repartition(3)
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns
    out = got.collect()
    assert all(list(r)[2:] == names for r in out)
    groups = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:2]) for r in out)
    assert groups == [(-1, ""), (-1, "a0"), (3, "b0"), (7, "c0"), (8, "on"), (10, ""), (11, ""), (12, "d0")]
    assert sorted(map(str, out)) == sorted(map(str, jaccard_join.keep_one(docs.repartition(7)).collect()))


def brute_repeats(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first = {}
    raw = [(t or "").encode() for _, t in rows]
    for i in order:
        for s in range(len(raw[i]) - length + 1):
            at = (rows[i][0] is not None, rows[i][0] or 0, s)
            k = raw[i][s:s + length]
            first[k] = min(first.get(k, at), at)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        gone = np.zeros(len(raw[i]) + 1, bool)
        for s in range(len(raw[i]) - length + 1):
            if first[raw[i][s:s + length]] < (doc_id is not None, doc_id or 0, s):
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(raw[i], gone) if not g)
        out.append((doc_id, len(raw[i]), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(docs):
    return sorted((tuple(r) for r in suffix_dedup.op9_suffix_dedup(docs).collect()), key=str)


@pytest.mark.parametrize("hot,buffer", [(64, 23), (1, 12)])
def test_repeats_match_brute_force(hard, small, hot, buffer, monkeypatch):
    for name, value in (("LOCAL_HOT", hot), ("HOT_PIECES", 4096 if hot > 1 else 2), ("POSITION_BITS", buffer)):
        monkeypatch.setattr(suffix_dedup, name, value)
    for docs in (hard, small) if hot > 1 else (hard,):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert repeats(docs) == brute_repeats(rows)


@pytest.mark.parametrize("hot", [64, 1])
def test_repeats_are_cut_from_their_own_row(spark, hot, monkeypatch):
    """Rows that share a doc_id, or have none, with different texts: what one repeats stays in the other."""
    for name, value in (("LOCAL_HOT", hot), ("HOT_PIECES", 4096 if hot > 1 else 2)):
        monkeypatch.setattr(suffix_dedup, name, value)
    def prose(k):
        return " ".join(f"{k}w{i * i % 89}x{i}" for i in range(120))

    rows = [(None, prose("a")), (None, prose("b")[:400] + prose("a")[50:500] + prose("c")), (None, prose("d")),
            (None, "zz " + prose("e")), (None, "yy " + prose("e")[:600]), (None, "ww " + prose("e")[:600]),
            (3, prose("f")), (7, prose("f")[:700] + prose("g")), (7, prose("h")), (7, prose("f")[:700] + prose("i")), (7, prose("h")),
            (8, prose("e")[200:] + prose("j")), (8, prose("k")), (9, prose("h")[100:600] + prose("k")[:400])]
    for parts in (1, 5):
        assert repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == brute_repeats(rows)


def test_anchors_spread_evenly_over_fragments():
    """Anchors are the smallest hashes of their windows; no fragment may gather them."""
    raw = np.random.default_rng(5).integers(32, 127, 200_000).astype(np.uint8)
    *_, gram, _ = suffix_dedup.pieces_of(raw, np.array([0, len(raw)]))
    for fragments in (8, 64, 256):
        held = np.bincount(suffix_dedup._fragment(gram, fragments).astype(np.int64), minlength=fragments)
        assert held.min() > 0 and held.max() < 2.5 * held.mean()


def test_repeats_of_nothing(empty):
    assert repeats(empty) == []


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)).round(1).astype("float32")
    rows = [(i, [float(x) for x in v[i]], "other") for i in range(700)]
    rows += [(700, None, ""), (701, [1.0, float("nan")], ""), (800, [float("inf")], ""), (900, [1.0, None], ""),
             (1000, [], ""), (1100, [0.5, 0.25], ""), rows[5], rows[100], (None, rows[7][1], ""), (300, rows[8][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    good = [(i, np.floor(1024 * np.pad(np.array(e, float), (0, 12 - len(e)))).astype(int))
            for i, e, _ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for at, (q, e) in enumerate(good):
        if q is not None and q % 100 == 0:  # each row of a repeated id asks, and is found by the others
            best = sorted((-int(e @ c), i is None, i or 0) for k, (i, c) in enumerate(good) if k != at)[:10]
            want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(best)]
    assert sorted(map(tuple, exact_topk.op6_exact_topk(df).collect()), key=str) == sorted(want, key=str)
    assert exact_topk.op6_exact_topk(df.limit(0)).count() == 0

"""Phrase collocations against brute force; passes, windows and filters forced small."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_rows import empty, hard, hard_rows, small  # noqa: F401  (fixtures)
from survspan.llm import collocations as co

ROWS = "doc_id long, text string, lang string, phrase string, words int, hash string, raw string"


def grams(text, k):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
        w = re.findall("[^\x20\x09]+", piece)
        yield from (" ".join(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(rows, least=10, share=50, longest=3, top=2000):
    f = {}
    for text, lang in rows:
        for k in range(1, longest + 1):
            f.setdefault((lang or "und", k), Counter()).update(grams(text, k))
    out = []
    for lang in {name for name, _ in f}:
        n = sum(f[lang, 1].values())
        all_ = {p: c for k in range(1, longest + 1) for p, c in f[lang, k].items()}
        candidates = {p: c for p, c in all_.items() if " " in p and c >= least}
        kept = []
        for p, a in candidates.items():
            if any(f" {p} " in f" {q} " and q != p and 100 * c >= share * a for q, c in candidates.items()):
                continue
            w = p.split(" ")
            score, _, l, r = min((10**6 * a * a // (all_[x] * all_[y]), i, all_[x], all_[y]) for i in range(1, len(w))
                                 for x, y in [(" ".join(w[:i]), " ".join(w[i:]))])
            kept.append((-score, -a, p.encode(), p, l, r))
        out += [(lang, i + 1, p, -a, l, r, n, -s) for i, (s, a, _, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(docs, **kw):
    return sorted(map(tuple, co.collocations(docs, **kw).collect()))


def phrase_rows(seed=5, n=500):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "São", "x'y", "#", "end"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", ", "\x0b", " "])
                       for _ in range(rng.randrange(40)))
        rows.append((i, text, [None, "en", "und", "fr"][i % 4], "clash", 1, "clash", "clash"))
    return rows + rows[:3] + [(None, None, "en", None, None, None, None), (1, "", "zz", "", 0, "", ""), (2, " .\t", "zz", "", 0, "", "")]


@pytest.mark.parametrize("sampling", [{}, {"window": 50}, {"percent": 0}, {"percent": 5, "sample_count": 6},
                                      {"percent": 100, "sample_count": 1}, {"bits": 7, "percent": 10}])
def test_brute_force(spark, sampling):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    want = brute([(r[1], r[2]) for r in rows])
    assert len(want) > 40 and found(docs, **sampling) == want


def test_passes_until_closed(spark):
    """Without a sample every level is a failure of the border, found one pass at a time; a full sample needs one pass."""
    docs = co.read(spark.createDataFrame(phrase_rows(), ROWS))
    none, passes = co.frequent_phrases(docs, percent=0)
    whole, one = co.frequent_phrases(docs, percent=100)
    assert (passes, one) == (3, 1)
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, whole.collect()))


def test_longer_phrases_and_few(spark):
    rows = phrase_rows(9, 200)
    docs = spark.createDataFrame(rows, ROWS).repartition(2)
    want = brute([(r[1], r[2]) for r in rows], least=4, share=80, longest=4, top=7)
    assert found(docs, min_count=4, share=80, max_words=4, top=7) == want


def test_many_rows_ranked_in_rounds(spark, monkeypatch):
    rows = phrase_rows(7)
    docs = spark.createDataFrame(rows, ROWS)
    monkeypatch.setattr(co, "first_of_each", lambda r, top, f=co.first_of_each: f(r, top, 10))
    assert found(docs, min_count=2, top=3) == brute([(r[1], r[2]) for r in rows], least=2, top=3)


def test_hard_rows_and_tables(hard, empty, small):
    assert found(empty) == []
    assert found(hard, window=4000) == brute([(r[1], r[2]) for r in hard.collect()])
    assert found(small) == brute([(r.text, r.lang) for r in small.collect()])


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\t\n", max_size=80), st.integers(1, 20), st.integers(1, 4))
def test_windows_lose_and_repeat_nothing(text, size, longest):
    folded = text.encode().translate(co._FOLD)
    for k in range(1, longest + 1):
        got = Counter()
        for part, skip in co.windows(folded, size, longest - 1):
            pieces, at = part.decode().split("\n"), 0
            for piece in pieces:
                w = piece.split()
                got.update(" ".join(w[i:i + k]) for i in range(len(w) - k + 1) if at + i + k - 1 >= skip)
                at += len(w)
        assert got == Counter(grams(text, k))


def test_scores_past_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7), ("en", 0, "", 9 * big)]
    got = co.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long")).first()
    assert got.score == 10**6 * (big - 7) ** 2 // (big * (big - 1))

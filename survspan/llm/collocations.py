"""Phrase collocations by Toivonen's sampling method.

A hashed sample of documents proposes phrases: words, then longer phrases whose two parts one
word shorter were proposed, with at least a lowered count in the sample. One full pass then counts exactly the
proposed phrases together with their negative border, that is every phrase whose two parts one word shorter are
proposed, and every word. Border phrases that turn out frequent were missed by the sample: they
join the proposed ones, and a further pass counts the phrases that become countable by that and were
not counted before, until no border phrase fails. Every frequent phrase has then been counted, each in one pass.

The proposed phrases travel as a bit array of fixed size (2^FILTER_BITS bits, the proven bound of what is broadcast).
A phrase that it holds by accident is counted too, never left out; what counts as
proposed, border and counted before is always read from the arrays, so that passes never overlap. Inside tasks, texts are
cut into windows, their words coded by numbers, phrases coded from pairs of shorter phrases and
pre-aggregated; phrase, language and count are shuffled, never occurrences.

Defined cases: a null text is empty, a null language is `und`; texts without words add nothing; repeated rows count as often
as they occur; an empty table gives an empty result; a text longer than a window is cut between
pieces or words without losing phrases. Only text and lang are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable, release_memory

MIN_COUNT = 10
MAX_WORDS = 3
SHARE = 50  # a phrase inside a longer one that has so many hundredths of its occurrences is dropped
TOP = 2000
SAMPLE_PERCENT = 10
SAMPLE_COUNT = 2  # in the sample; a phrase of twice the least count is expected there as often
FILTER_BITS = 26
SLICE_WORDS = 1 << 14
WINDOW_BYTES = 12 << 20
SALTS = 8
RANKED = 100_000  # rows that one task ranks

COUNTS = "lang string, words int, phrase string, n long"

# Letters A to Z go to lower case, these bytes end a piece, and a tab is a blank.
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if b in _PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    bounds = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    starts = bounds[:-1] - bounds[0]
    lengths = np.diff(bounds)
    seed = sum((b + 1) * pow(0x100000001B3, i, 1 << 64) for i, b in enumerate(lang.encode())) % (1 << 64)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, lengths)]
    return _mixed(np.add.reduceat(terms, starts) + np.uint64(seed))


def _longer(hashes: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words with one word more."""
    return _mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + last + np.uint64(k))


def hashed(phrases: DataFrame) -> DataFrame:
    """hash of each (lang, words, phrase), as the passes make it."""
    ship_code(phrases.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for (lang, k), rows in batch.groupby(["lang", "words"]):
                    split = rows["phrase"].str.split(" ", expand=True)
                    names = pa.array(pd.unique(split.to_numpy().ravel()), pa.large_string()).cast(pa.large_binary())
                    known = pd.Series(_word_hashes(names, lang), index=names.cast(pa.large_string()).to_pylist())
                    out = known.loc[split[0]].to_numpy()
                    for i in range(1, int(k)):
                        out = _longer(out, known.loc[split[i]].to_numpy(), i)
                    yield pd.DataFrame({"hash": out.view(np.int64)})

    return phrases.select("lang", "words", "phrase").mapInPandas(work, "hash long")


class PhraseFilter:
    """Bit array of proposed phrases; two bits per phrase hash."""

    def __init__(self, bits: int = FILTER_BITS, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64) if words is None else words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def with_phrases(self, phrases: DataFrame) -> PhraseFilter:
        """This filter and the phrases' bits: they are joined in slices on the executors, and the slices come to the driver."""
        mask = F.lit((1 << self.bits) - 1).cast("long")
        at = hashed(phrases).select(F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(mask) for s in (0, 32)])).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))

        def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            part = np.zeros(SLICE_WORDS, np.int64)
            part[rows["word"].to_numpy(np.int64) % SLICE_WORDS] = rows["bits"].to_numpy(np.int64)
            return pd.DataFrame({"slice": [key[0]], "part": [part.tobytes()]})

        ship_code(phrases.sparkSession)
        out = self.words.copy()
        for row in (words.groupBy((F.col("word") / SLICE_WORDS).cast("long").alias("slice"))
                    .applyInPandas(joined, "slice long, part binary").collect()):  # 2^bits bits at most
            begin = row["slice"] * SLICE_WORDS
            part = np.frombuffer(row["part"], np.uint64)[:len(out) - begin]
            out[begin:begin + len(part)] |= part
        return PhraseFilter(self.bits, out)


def windows(folded: bytes, size: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """(window, words at its start that the one before has counted): cut at a piece's end, else between two words."""
    begin = 0
    while begin < len(folded):
        end = begin + size
        if end < len(folded):
            cut = folded.rfind(b"\n", begin, end)
            if cut < 0:
                cut = folded.rfind(b" ", begin, end)
            if cut < 0:  # one word fills the window: take it whole
                cut = min((x for x in (folded.find(b" ", end), folded.find(b"\n", end)) if x >= 0), default=len(folded) - 1)
            end = cut + 1
        before = []
        if begin and overlap and folded[begin - 1] != 10:
            # Words of the piece that the last cut left open; its phrases go on here.
            before = folded[folded.rfind(b"\n", 0, begin) + 1:begin].rsplit(None, overlap)[-overlap:]
        yield b" ".join([*before, folded[begin:end]]), len(before)
        begin = end


def count_window(window: bytes, skip: int, lang: str, new: PhraseFilter | None, old: PhraseFilter | None,
                 max_words: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(words, phrases, counts) of what a pass counts: at first all that `new` admits, later what `old` left out."""
    data = np.frombuffer(window, np.uint8)
    breaks = data == 10
    blank = breaks | (data == 32)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    del data, blank, breaks, edges
    code = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary
    hashes = word_hashes = _word_hashes(names, lang)
    strings = names
    n = np.bincount(code[skip:], minlength=len(names))
    seen = np.full(len(names), old is not None)
    word = code
    for k in range(1, max_words + 1):
        fresh = np.flatnonzero(~seen & (n > 0))
        if len(fresh):
            yield k, strings.take(pa.array(fresh)), n[fresh]
        if k == max_words or new is None:
            return
        held = new.holds(hashes)
        held_before = seen & old.holds(hashes) if old is not None else np.zeros(len(hashes), bool)
        ok = np.append(held, False)[code]  # code -1: the last entry, False
        left = np.flatnonzero(ok[:-1] & ok[1:] & (piece[:len(ok) - 1] == piece[k:k + len(ok) - 1]))
        if not len(left):
            return
        pairs = code[left] * len(hashes) + code[left + 1]
        which, distinct = pd.factorize(pairs)
        order = np.argsort(distinct)  # phrases of one beginning side by side: they compress better in the shuffle
        distinct = distinct[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        which = place[which]
        first, second = np.divmod(distinct, len(hashes))
        last = np.empty(len(distinct), np.int64)
        last[which] = word[left + k]
        seen = held_before[first] & held_before[second]
        strings = pc.binary_join_element_wise(strings.take(pa.array(first)), names.take(pa.array(last)),
                                              pa.scalar(b" ", pa.large_binary()))
        hashes = _longer(hashes[first], word_hashes[last], k)
        n = np.bincount(which[left + k >= skip], minlength=len(distinct))
        codes = np.full(len(code) - 1, -1, np.int64)
        codes[left] = which
        code = codes


def count_phrases(docs: DataFrame, new: PhraseFilter | None, old: PhraseFilter | None = None,
                  max_words: int = MAX_WORDS, window: int = WINDOW_BYTES):
    """((lang, words, phrase, n), what was broadcast): one pass over docs (lang, raw). A first pass also gives
    each language's words: words = 0."""
    ship_code(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((new and (new.bits, new.words), old and (old.bits, old.words)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from survspan.llm.collocations import PhraseFilter, counted_batches

        filters = [x and PhraseFilter(*x) for x in sent.value]
        yield from counted_batches(batches, *filters, max_words, window)

    key = ["lang", "words", "phrase"]
    # Windows are aggregated already: a second aggregate before the shuffle would only fill memory.
    return docs.mapInArrow(work, COUNTS).repartition(*key).groupBy(*key).agg(F.sum("n").alias("n")), sent


def counted_batches(batches, new, old, max_words, window) -> Iterator[pa.RecordBatch]:
    texts: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("raw")):
            raw = raw.as_py()
            texts.setdefault(lang, []).append(raw)
            size += len(raw) + 1
            if size >= window:
                yield from _counted(texts, new, old, max_words, window)
                texts, size = {}, 0
                release_memory()
    yield from _counted(texts, new, old, max_words, window)
    release_memory()


def _counted(texts: dict[str, list[bytes]], new, old, max_words, window) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for lang in [*texts]:
            folded, total = b"\n".join(texts.pop(lang)).translate(_FOLD), 0
            for part, skip in windows(folded, window, max_words - 1):
                for k, phrases, n in count_window(part, skip, lang, new, old, max_words):
                    total += int(n.sum()) if k == 1 else 0
                    yield _rows(lang, k, phrases.cast(pa.binary()).cast(pa.string()), n)
            if total:
                yield _rows(lang, 0, pa.array([""]), np.array([total]))


def _rows(lang: str, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([lang])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [same, pa.array(np.full(len(n), k, np.int32)), phrases, pa.array(n.astype(np.int64))],
        names=["lang", "words", "phrase", "n"])


def read(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, raw) of the rows with a text."""
    return (docs.where(F.col(f"`{text}`").isNotNull())
            .select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("raw")))


def proposed(docs: DataFrame, percent: int = SAMPLE_PERCENT, count: int = SAMPLE_COUNT, max_words: int = MAX_WORDS,
             bits: int = FILTER_BITS, window: int = WINDOW_BYTES) -> PhraseFilter:
    """Phrases with at least `count` occurrences in a sample of documents, by length."""
    sample = docs.where(F.pmod(F.xxhash64("raw"), F.lit(100)) < percent)
    found, before = PhraseFilter(bits), None
    for k in range(1, max_words):
        counts, sent = count_phrases(sample, found, before, k, window)
        before, found = found, found.with_phrases(counts.where(f"words = {k} and n >= {count}"))
        sent.unpersist()
    return found


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, percent: int = SAMPLE_PERCENT,
                     sample_count: int = SAMPLE_COUNT, bits: int = FILTER_BITS, window: int = WINDOW_BYTES) -> tuple[DataFrame, int]:
    """(lang, words, phrase, n) of every phrase with at least min_count occurrences, and each language's number of words
    (words = 0); and the number of full passes. docs: (lang, raw) by read()."""
    new, old, found = proposed(docs, percent, sample_count, max_words, bits, window), None, []
    while True:
        counts, sent = count_phrases(docs, new, old, max_words, window)
        got = durable(counts.where((F.col("n") >= min_count) | (F.col("words") == 0)))
        sent.unpersist()
        found.append(got)
        wider = new.with_phrases(got.where((F.col("words") > 0) & (F.col("words") < max_words)))
        if (wider.words == new.words).all():
            break  # no border phrase is frequent
        old, new = new, wider
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, len(found)


def scored(phrases: DataFrame, share: int = SHARE, max_words: int = MAX_WORDS, salts: int = SALTS) -> DataFrame:
    """lang, phrase, a, l, r, score: the lowest-scoring cut of each phrase of two words or more; parts of longer ones dropped."""
    several = phrases.where("words >= 2").withColumn("w", F.split("phrase", " ")).withColumnRenamed("n", "a")

    def joined(begin, length):
        return F.array_join(F.slice("w", begin, length), " ")

    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    cuts = (several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"),
                    joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"), salt.alias("salt")))
    # A frequent word begins many phrases: its row is there once per salt.
    part = phrases.where(f"words > 0 and words < {max_words}").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", "salt", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", "salt", side])
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(a as {wide}) * a * 1000000) div (cast(l as {wide}) * r)")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase")
            .agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))))
    longer = (several.where("words > 2").select("lang", "a", F.explode(inside).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    return (best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def first_of_each(rows: DataFrame, top: int = TOP, ranked: int = RANKED) -> DataFrame:
    """rank per language by score, a (both descending) and phrase; groups too large for one task lose their tails first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = durable(rows)
    left = rows.count()
    while left > ranked:
        group = F.pmod(F.xxhash64("phrase"), F.lit(blocks(left, ranked)))
        few = Window.partitionBy("lang", "_g").orderBy(*order)
        rows = durable(rows.withColumn("_g", group).withColumn("_r", F.row_number().over(few))
                       .where(F.col("_r") <= top).drop("_g", "_r"))
        was, left = left, rows.count()
        if 2 * left > was:
            break  # many languages, each of few rows
    return (rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP, **sampling) -> DataFrame:
    phrases, _passes = frequent_phrases(read(docs, text, lang), min_count, max_words, **sampling)
    total = phrases.where("words = 0").select("lang", F.col("n"))
    return (first_of_each(scored(phrases, share, max_words), top).join(total, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11_collocations(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
  FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
s AS (
  SELECT cuts.*, l.n AS l, r.n AS r, (1000000 * a * a) // (l.n * r.n) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) t WHERE i = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) t
  GROUP BY lang, phrase),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON best.lang = longer.lang AND best.phrase = longer.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, total.n AS n,
       CAST(score AS BIGINT) AS score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM kept) kept
JOIN total ON total.lang = kept.lang WHERE rank <= 2000"""

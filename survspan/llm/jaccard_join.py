"""Exact n-gram Jaccard self-join by vertical partitioning, and its components.

A document's set is its distinct word n-grams, as 64-bit hashes. Documents with
equal sets form a class; classes are joined.

1. The hash range, which is the global n-gram order, is cut into fragments, as many as the number of
   n-grams needs. Every class sends each fragment its segment. A fragment holds all
   occurrences of its n-grams, so it knows how many classes hold each one.
2. n-grams of one class only cannot overlap. Per class, the others come
   back with their frequency. A class whose own n-grams exceed what two similar sets can
   differ in is done; this drops nearly all of the corpus.
3. The rest take the prefix filter in the order (frequency, hash): two similar
   sets share an n-gram among the first n - ceil(t n) + 1. Classes that share a prefix n-gram are
   first compared with one hub per n-gram. Members that a component already holds need no
   further comparison; the others meet all members outside their component.
4. Pairs are verified by fragments: partial overlaps are counted per fragment and summed per pair.

An n-gram that many documents of one batch hold does not travel to its fragment
with each of them, but once with a mark; it takes the last places of the order, and
the documents that hold it keep it in their own lists. So no fragment gathers
the documents of a frequent passage.

Defined cases: null texts and texts without words have an empty set, n_shingles 0, and are
their own component; shorter texts than n words have one n-gram, the whole sequence;
repeated rows have equal sets, so share a component; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable
from .components import components

SHINGLE = 5
PERCENT = 75
PER_FRAGMENT = 3_000_000      # n-grams in a fragment
PER_BUCKET = 2_000_000        # shared n-grams in a bucket of classes
LOCAL_HOT = 64                # holders in one batch that make an n-gram frequent
VERIFY_FRAGMENTS = 16
KEY = 12                      # bytes of a class key
SKETCH_WORDS = 8
HOT = 255                     # frequency mark of the frequent n-grams

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    joined = b"\n".join(texts).translate(_LOWER) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, long = starts[order], lengths[order]
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64)
    longer = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    for j, m in enumerate(longer):  # byte j of the words that have one
        h[:m] = (h[:m] ^ raw[at[:m] + j]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = _mix(h ^ long.astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return out, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every text, and their bounds."""
    w, at = word_hashes(texts)
    seeds = _mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    grams = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        grams += w[j:j + len(grams)] * seeds[j]
    grams = _mix(grams)
    parts = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            parts.append(s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = (w[a:b] * seeds[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            parts.append(_mix(np.array([whole], np.uint64)))
        else:
            parts.append(np.zeros(0, np.uint64))
    bounds = np.cumsum([0] + [len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def _sets_of(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Pieces of a batch of near 8 MB of text, with the sets of their rows."""
    texts = [b"" if t is None else t.encode() for t in batch["text"]]
    size, begin = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 8 << 20 or i == len(texts) - 1:
            yield batch.iloc[begin:i + 1], *shingle_sets(texts[begin:i + 1])
            begin, size = i + 1, 0


def _keys(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=KEY).digest() if b > a else None
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def classes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, n): class key and set size of every document."""
    def measure(batches):
        for batch in batches:
            for part, hashes, bounds in _sets_of(batch):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "row": part["row"],
                                    "key": _keys(hashes, bounds), "n": np.diff(bounds)})

    ship_code(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInPandas(measure, "doc_id long, row long, key binary, n long")


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _named(low: np.ndarray, frag) -> np.ndarray:
    """One number per n-gram, from its fragment and the six bytes that travel."""
    return _mix(low + np.asarray(frag, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


SEGMENTS = "frag long, keys binary, sizes binary, counts binary, grams binary, hot binary"


def segments(docs: DataFrame, fragments: int) -> DataFrame:
    """Rows for the fragments: keys, set sizes and segments of a batch's classes, and its frequent n-grams.

    Rows with a fragment number past the last carry, per class, the frequent
    n-grams that did not travel.
    """
    def cut(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for _part, hashes, bounds in _sets_of(batch):
                keys = _keys(hashes, bounds)
                new = [i for i, k in enumerate(keys) if k is not None and not (k in seen or seen.add(k))]
                if new:
                    yield _cut(hashes, bounds, keys, new, fragments)

    return docs.select("text").mapInPandas(cut, SEGMENTS)


def _cut(hashes, bounds, keys, new, fragments) -> pd.DataFrame:
    parts = [hashes[bounds[i]:bounds[i + 1]] for i in new]
    sizes = np.array([len(p) for p in parts], np.uint32)
    grams, owner = np.concatenate(parts), np.repeat(np.arange(len(new)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    held = np.diff(np.append(first, len(grams)))
    is_hot = np.repeat(held > LOCAL_HOT, held)
    hot = grams[first[held > LOCAL_HOT]]
    rows = []

    def row(frag, own, own_grams, marked):
        """Rows are by class: own must be grouped, in any order of classes."""
        by = np.argsort(own, kind="stable")
        who, counts = np.unique(own[by], return_counts=True)
        rows.append((frag, b"".join(keys[new[i]] for i in who.tolist()), sizes[who].tobytes(),
                     counts.astype(np.uint32).tobytes(), _six(own_grams[by]), _six(marked)))

    place = _fragment(grams, fragments)
    hot_place = _fragment(hot, fragments)
    cuts, hot_cuts = (np.searchsorted(p, np.arange(fragments + 1)) for p in (place, hot_place))
    for f in range(fragments):
        a, b = cuts[f], cuts[f + 1]
        if b > a:
            cold = ~is_hot[a:b]
            row(f, owner[a:b][cold], grams[a:b][cold], hot[hot_cuts[f]:hot_cuts[f + 1]])
    if len(hot):
        by = np.argsort(owner[is_hot], kind="stable")
        who, counts = np.unique(owner[is_hot], return_counts=True)
        own = _named(grams[is_hot] & np.uint64((1 << 48) - 1), place[is_hot])[by]
        rows.append((fragments + int(hot[0] % np.uint64(fragments)), b"".join(keys[new[i]] for i in who.tolist()),
                     sizes[who].tobytes(), counts.astype(np.uint32).tobytes(), own.astype("<u8").tobytes(), b""))
    return pd.DataFrame(rows, columns=["frag", "keys", "sizes", "counts", "grams", "hot"])


def _key_array(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY)


SHARED = "bucket long, keys binary, sizes binary, counts binary, grams binary, freqs binary"


def shared(cut: DataFrame, fragments: int, buckets: int) -> DataFrame:
    """n-grams that several classes hold, with log2 of their frequency, dealt into buckets of classes."""
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frag = int(key[0])
        keys = _key_array(rows["keys"])
        sizes, counts = (np.frombuffer(b"".join(rows[c]), np.uint32) for c in ("sizes", "counts"))
        if frag >= fragments:
            grams = np.frombuffer(b"".join(rows["grams"]), "<u8")
            return _deal(keys, sizes, np.repeat(np.arange(len(keys)), counts), grams, np.full(len(grams), HOT, np.uint8), buckets)
        grams = _from_six(b"".join(rows["grams"]))
        hot = np.unique(_from_six(b"".join(rows["hot"])))
        # A class may come from several batches; one of them counts.
        words = np.zeros((len(keys), 16), np.uint8)
        words[:, :KEY] = keys
        k1, k2 = words.view("<u8").T
        order = np.lexsort((k2, k1))
        once = np.zeros(len(keys), bool)
        if len(keys):
            once[order] = np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
        owner = np.repeat(np.arange(len(keys)), counts)
        keep = once[owner]
        grams, owner = grams[keep], owner[keep]
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
        held = np.diff(np.append(first, len(grams)))
        freq = np.minimum(np.ceil(np.log2(np.maximum(held, 1))), HOT - 1).astype(np.uint8)
        freq[np.isin(grams[first], hot)] = HOT
        freq = np.repeat(freq, held)
        some = freq > 0
        return _deal(keys, sizes, owner[some], _named(grams[some], frag), freq[some], buckets)

    return cut.groupBy("frag").applyInPandas(count, SHARED)


def _deal(keys, sizes, owner, grams, freqs, buckets) -> pd.DataFrame:
    bucket = keys[:, :4].copy().view("<u4").ravel().astype(np.int64) % buckets if len(keys) else np.zeros(0, np.int64)
    order = np.lexsort((owner, bucket[owner]))
    owner, grams, freqs = owner[order], grams[order], freqs[order]
    cuts = np.searchsorted(bucket[owner], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        i, j = cuts[b], cuts[b + 1]
        if j > i:
            who, counts = np.unique(owner[i:j], return_counts=True)
            rows.append((b, keys[who].tobytes(), sizes[who].tobytes(), counts.astype(np.uint32).tobytes(),
                         grams[i:j].astype("<u8").tobytes(), freqs[i:j].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "keys", "sizes", "counts", "grams", "freqs"])


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


ALIKE = "key binary, n long, held array<long>, prefix array<long>, sketch array<long>"


def survivors(dealt: DataFrame) -> DataFrame:
    """Classes that may have partners: their shared n-grams and the part of their prefix that lies in these."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        keys = _key_array(rows["keys"])
        sizes, counts = (np.frombuffer(b"".join(rows[c]), np.uint32).astype(np.int64) for c in ("sizes", "counts"))
        grams = np.frombuffer(b"".join(rows["grams"]), "<u8")
        freqs = np.frombuffer(b"".join(rows["freqs"]), np.uint8)
        names = keys.copy().view(f"V{KEY}").ravel()
        who, index = np.unique(names, return_inverse=True)
        n = np.zeros(len(who), np.int64)
        n[index] = sizes
        owner = np.repeat(index, counts)
        order = np.lexsort((255 - freqs.astype(np.int16), grams, owner))  # a gram named twice keeps its larger mark
        owner, grams, freqs = owner[order], grams[order], freqs[order]
        keep = np.concatenate([[True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])])
        owner, grams, freqs = owner[keep], grams[keep], freqs[keep]
        bounds = np.searchsorted(owner, np.arange(len(who) + 1))
        listed = np.diff(bounds)
        need = prefix_length(n) - (n - listed)
        out = []
        for i in np.flatnonzero(need > 0):
            a, b = bounds[i], bounds[i + 1]
            g = grams[a:b]
            prefix = g[np.lexsort((g, freqs[a:b]))[:need[i]]]
            bits = np.zeros(64 * SKETCH_WORDS, bool)
            bits[(g % np.uint64(len(bits))).astype(np.int64)] = True
            out.append((who[i].tobytes(), n[i], g.view("<i8"), prefix.view("<i8"), np.packbits(bits).view("<i8")))
        return pd.DataFrame(out, columns=["key", "n", "held", "prefix", "sketch"])

    return dealt.groupBy("bucket").applyInPandas(merge, ALIKE)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that are similar: partial overlaps per fragment, summed per pair."""
    parts = sets.select("key", "n", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1)), lambda f: F.struct(f.alias("f"), F.filter(
            "held", lambda h: F.pmod(h, F.lit(VERIFY_FRAGMENTS)) == f).alias("seg")))).alias("p")
        ).select("key", "n", "p.f", "p.seg").where(F.size("seg") > 0)
    left = parts.select(F.col("key").alias("b"), F.col("n").alias("n_b"), "f", F.col("seg").alias("seg_b"))
    right = parts.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "f", F.col("seg").alias("seg_a"))
    partial = pairs.join(left, "b").join(right, ["a", "f"]).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("seg_a", "seg_b")).cast("long").alias("part"))
    return (partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("both"))
            .where(F.col("both") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
            .select("a", "b"))


def _reaches(overlap, percent: int):
    """Whether an overlap of sets a and b would make them similar."""
    return overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _possible(percent: int):
    """Bounds that every similar pair meets: sizes, and the shared parts."""
    return ((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            & _reaches(F.least("h_a", "h_b"), percent))


def _not_ruled_out(percent: int):
    """More bounds on the overlap: of a pair that meets at its first common n-gram, and by the bits of only one side."""
    first = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))

    def own(x, y):  # n-grams that x has and y cannot have
        bits = [F.bit_count(F.get(f"sketch_{x}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"sketch_{y}", F.lit(i)))))
                for i in range(SKETCH_WORDS)]
        return F.col(f"n_{x}") - F.col(f"h_{x}") + sum(bits[1:], bits[0])

    return (_possible(percent) & _reaches(first, percent)
            & _reaches(F.least(F.col("n_a") - own("a", "b"), F.col("n_b") - own("b", "a")), percent))


def _named_as(df: DataFrame, side: str) -> DataFrame:
    return df.select("g", F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "h", "at", "root", "sketch")])


def linked(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, root) of the classes that have a similar partner; root is the component's smallest key."""
    posts = sets.select(F.posexplode("prefix").alias("r", "g"), "key", "n", F.size("held").cast("long").alias("h")).withColumn(
        "at", F.col("n") - F.col("h") + F.col("r") + 1).drop("r")
    posts = durable(posts)
    # The hub is the member with the least n-grams of its own: of edited copies, the original.
    central = F.max(F.struct((F.col("h") / F.col("n")).alias("c"), "n", "h", "key")).alias("hub")
    many = posts.groupBy("g").agg(F.count(F.lit(1)).alias("m"), central).where("m > 1").drop("m")
    posts = durable(posts.join(many, "g"))
    first = posts.where(F.col("key") != F.col("hub.key")).select(
        F.col("hub.key").alias("a"), F.col("hub.n").alias("n_a"), F.col("hub.h").alias("h_a"),
        F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("h").alias("h_b"))
    first = durable(first.where(_possible(percent)).select("a", "b").distinct())
    links = durable(verified(first, sets, percent))
    roots = components(links)
    placed = durable(posts.drop("hub").join(roots, posts["key"] == roots["node"], "left").select(
        "g", "key", "n", "h", "at", F.coalesce("root", "key").alias("root")))
    # In each group, all but the members of its largest component meet the members outside their own.
    held = placed.groupBy("g", "root").agg(F.count(F.lit(1)).alias("m"))
    giant = held.groupBy("g").agg(F.max(F.struct("m", "root")).alias("giant"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    open_ = durable(placed.join(giant.select("g", F.col("giant.root").alias("giant")), "g").join(sets.select("key", "sketch"), "key"))
    # a is the smaller set; it is met at one of its first n-grams only.
    early = F.col("at") * (100 + percent) <= F.col("n") * (100 - percent) + (100 + percent)
    outside = F.col("root") != F.col("giant")
    ordered = F.struct("n_a", "a") < F.struct("n_b", "b")
    met = [_named_as(open_.where(early & x), "a").join(_named_as(open_.where(y), "b"), "g").where(
        ordered & (F.col("root_a") != F.col("root_b")) & _not_ruled_out(percent))
        for x, y in ((outside, F.lit(True)), (~outside, outside))]
    second = met[0].union(met[1]).select("a", "b").distinct()
    done = first.union(first.select("b", "a"))
    more = durable(verified(second.join(done, ["a", "b"], "left_anti"), sets, percent))
    return components(links.union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, component_id and component of every row.

    `component` tells components apart where no member has a doc_id; a row without a set has none.
    """
    rows = durable(classes_of(docs))
    total = rows.agg(F.sum("n")).first()[0] or 0
    fragments, buckets = max(8, blocks(total, PER_FRAGMENT)), max(8, blocks(total, PER_BUCKET))
    sets = durable(survivors(shared(segments(docs, fragments), fragments, buckets)))
    roots = linked(sets).select(F.col("node").alias("key"), "root")
    first = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"))
    joined = first.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of_key = joined.join(least, "root").select("key", F.col("root").alias("component"), "component_id")
    return rows.join(of_key, "key", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def op3_jaccard_join(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of every component one row stays, that of the smallest doc_id (nulls last, ties by a hash of the text).

    Rows without words are linked with nothing and stay; of rows equal in doc_id and text, one. Columns of any
    name pass through.
    """
    alone = F.when(F.col("component").isNull(), F.col("row")).alias("alone")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = near_duplicates(docs).groupBy("component", alone).agg(first).select("first.row")
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*every).alias("kept"),
                       F.xxhash64(*every).alias("tie")).join(kept, "row", "left_semi")
    return rows.groupBy("row").agg(F.min_by("kept", "tie").alias("kept")).select("kept.*")

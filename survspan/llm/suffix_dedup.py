"""Removal of repeated byte passages with longest-previous-factor arrays.

A byte goes if a string of `length` bytes that covers it also starts earlier in
the corpus (smaller doc_id, or earlier in the same document).

1. Every string of `length` bytes has one anchor: the smallest hash among its
   `GRAM`-byte grams, so equal strings have equal anchors at the same place. Runs of starts with one
   anchor form a piece, about one per 40 bytes. Anchors are dealt by hash into fragments; an
   anchor of one piece only repeats nothing. A piece equal to an earlier one repeats
   wholly. Only the first of each kind of different pieces with a common anchor are
   undecided: the edges of repeats.
2. Undecided pieces send their text to buckets. A bucket sorts the suffixes at all
   starts of its pieces; the previous and next smaller text positions in suffix order give the
   longest previous factor of each start, and starts with one of `length` or more repeat.
3. Documents drop the bytes that their repeated starts cover.

An anchor with many different pieces in one batch is marked frequent: its fragment
gets the mark once, and its pieces meet by the content of their single strings, of which a batch sends
each once; so no task gathers the surroundings of a frequent passage.

Defined cases: null texts are empty; texts shorter than `length` keep all bytes; rows
that share a doc_id count as one place in the order and do not remove each other at equal starts, a null doc_id is the
smallest; what repeats in one row is cut from that row only (`row`, a hash of the text, tells rows of one doc_id apart); an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable, release_memory
from .jaccard_join import _mix

LENGTH = 100
GRAM = 24
POSITION_BITS = 18            # a buffer holds less than 2^18 bytes: some 40 MB of arrays
ANCHORS_PER_FRAGMENT = 200_000
PIECES_PER_BUCKET = 20_000
LOCAL_HOT = 64
HOT_PIECES = 4096
WHOLE, EDGE, HOT = 0, 1, 2

_P = [np.uint64(pow(0xD1342543DE82EF95, 1 << i, 1 << 64)) for i in range(7)]
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def block_hashes(raw: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the blocks of the given sizes (sums of two powers of two at most) at every position."""
    at = {1: _BYTES[raw]}
    parts = {s: (1 << (s.bit_length() - 1), s - (1 << (s.bit_length() - 1))) for s in sizes}
    kept = {p for pair in parts.values() for p in pair}
    size, i = 1, 0
    while size * 2 <= max(sizes):
        h = at[size] if size in kept else at.pop(size)
        at[size * 2] = h[:max(0, len(h) - size)] * _P[i] + h[size:]
        size, i = size * 2, i + 1
    for s, (big, small) in parts.items():
        if small:
            n = max(0, len(raw) - s + 1)
            at[s] = at[big][:n] * _P[small.bit_length() - 1] + at[small][big:big + n]
    return [at[s] for s in sizes]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def pieces_of(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """Pieces of the texts in one buffer: text number, first start (in the buffer), starts, anchor hash, content hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams, halves = block_hashes(raw, (GRAM, 64))
    grams = _mix(grams)
    low = np.uint64((1 << POSITION_BITS) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    anchor = (window_minima((grams & ~low) | place, length - GRAM + 1) & low).astype(np.int64)
    starts = np.arange(len(raw) - length + 1)
    text = np.searchsorted(bounds, starts, side="right") - 1
    valid = starts + length <= bounds[text + 1]
    starts, text, anchor = starts[valid], text[valid], anchor[valid]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.append(new, len(starts)))
    lo, a = starts[new], anchor[new]
    end = lo + count - 1 + length
    content = (halves[lo] * _P[3] + halves[np.minimum(lo + 64, end - 64)] * _P[5] + halves[end - 64]
               + (count + 256 * (a - lo)).astype(np.uint64) * _BYTES[7])
    # Anchors are minima, so small hashes; mixed again they spread evenly over the fragments.
    return text[new], lo, count, _mix(grams[a]), _mix(content)


def _buffers(ids: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in buffers: bytes, bounds, ids and the texts' offsets. A text too long for one buffer continues in the next."""
    most = (1 << POSITION_BITS) - 1
    parts, own, base, size = [], [], [], 0
    for i, t in zip(ids.tolist(), texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), most - LENGTH):
            part = t[at:at + most - 1]
            if parts and size + len(part) > most:
                yield _buffer(parts, own, base)
                parts, own, base, size = [], [], [], 0
            parts.append(part)
            own.append(i)
            base.append(at)
            size += len(part)
    if parts:
        yield _buffer(parts, own, base)


def _buffer(parts, own, base):
    return (np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]),
            np.array(own, np.int64), np.array(base, np.int64))


ANCHORS = "frag long, did binary, row binary, lo binary, n binary, gram binary, content binary, hot binary"
ANCHOR_SCHEMA = pa.schema([("frag", pa.int64()), *((c, pa.binary()) for c in ("did", "row", "lo", "n", "gram", "content", "hot"))])
REPEATS = "did long, row long, lo long, n long, gram long, kind int"


def _texts(column: pa.Array) -> Iterator[bytes]:
    """One text at a time: a batch is held once, as it came."""
    return (t.as_py() or b"" for t in column)


def anchors(docs: DataFrame, fragments: int) -> DataFrame:
    """Anchors for the fragments. Rows past the last fragment hold decisions that a batch could make by itself."""
    def find(batches):
        for batch in batches:
            dids, keys = batch.column("did").to_numpy(), batch.column("row").to_numpy()
            for raw, bounds, own, base in _buffers(np.arange(batch.num_rows), _texts(batch.column("text"))):
                yield pa.RecordBatch.from_pandas(_batch_anchors(raw, bounds, dids[own], keys[own], base, fragments),
                                                 schema=ANCHOR_SCHEMA, preserve_index=False)
            del batch
            release_memory()

    return docs.select("did", "row", F.col("text").cast("binary").alias("text")).mapInArrow(find, ANCHORS)


def _ordered(did, row, lo, n, gram, content):
    """Pieces by anchor, content and place; which have the anchor of the one before, are new in content, equal an
    earlier one, or come twice from one row."""
    order = np.lexsort((row, lo, did, content, gram))
    did, row, lo, n, gram, content = (x[order] for x in (did, row, lo, n, gram, content))

    def same(*columns):
        return np.concatenate([[False], np.logical_and.reduce([x[1:] == x[:-1] for x in columns])])[:len(gram)]

    later = same(gram, content)
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(gram))))
    # The same place of rows that share a doc_id is one place.
    whole = later & ((did != did[first]) | (lo != lo[first]))
    return (did, row, lo, n, gram, content), same(gram), ~later, whole, same(gram, content, did, lo, row)


def _batch_anchors(raw, bounds, own, keys, base, fragments):
    text, lo, n, gram, content = pieces_of(raw, bounds)
    # Equal pieces of a batch: the first stands for all.
    (did, row, lo, n, gram, content), same_gram, fresh, whole, copy = _ordered(
        own[text], keys[text], lo - bounds[text] + base[text], n, gram, content)
    group = np.cumsum(~same_gram) - 1
    kinds = np.bincount(group[fresh], minlength=int(group[-1]) + 1 if len(group) else 0)
    hot = (kinds > LOCAL_HOT)[group] if len(group) else np.zeros(0, bool)
    rows = []
    decided = (whole | hot) & ~copy
    if decided.any():
        kind = np.where(whole, WHOLE, HOT).astype(np.uint8)[decided]
        rows.append((fragments + int(did[0]) % fragments, did[decided].tobytes(), row[decided].tobytes(), lo[decided].astype(np.uint64).tobytes(),
                     n[decided].astype(np.uint8).tobytes(), gram[decided].tobytes(), kind.tobytes(), b""))
    sent = ~whole & ~hot & ~copy
    marks = np.unique(gram[hot])
    frag, mark_frag = _fragment(gram[sent], fragments), _fragment(marks, fragments)
    cuts, mark_cuts = (np.searchsorted(f, np.arange(fragments + 1)) for f in (frag, mark_frag))
    columns = [did[sent], row[sent], lo[sent].astype(np.uint32 if lo.max(initial=0) < 1 << 32 else np.uint64), n[sent].astype(np.uint8),
               gram[sent], content[sent]]
    for f in range(fragments):
        a, b = cuts[f], cuts[f + 1]
        marked = marks[mark_cuts[f]:mark_cuts[f + 1]]
        if b > a or len(marked):
            d, key, start, count, g, c = (x[a:b] for x in columns)
            rows.append((f, d.tobytes(), key.tobytes(), start.astype(np.uint64).tobytes() if start.dtype.itemsize == 8 else start.tobytes(),
                         count.tobytes(), g.tobytes(), c.tobytes(), marked.tobytes()))
    return pd.DataFrame(rows, columns=["frag", "did", "row", "lo", "n", "gram", "content", "hot"])


def _fragment(gram: np.ndarray, fragments: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _column(blobs, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Starts, four bytes each where a batch has no longer text."""
    return np.concatenate([np.frombuffer(lo, np.uint32 if len(lo) == 4 * len(n) else np.uint64).astype(np.int64)
                           for lo, n in zip(rows["lo"], rows["n"])]) if len(rows) else np.zeros(0, np.int64)


def decisions(found: DataFrame, fragments: int) -> DataFrame:
    """Pieces that repeat wholly, and the undecided ones."""
    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        did, row, lo, n = _column(rows["did"], np.int64), _column(rows["row"], np.int64), _starts(rows), _column(rows["n"], np.uint8)
        gram = _column(rows["gram"], np.uint64)
        if int(key[0]) >= fragments:
            return _decided(did, row, lo, n, gram, _column(rows["content"], np.uint8))
        content, marks = _column(rows["content"], np.uint64), np.unique(_column(rows["hot"], np.uint64))
        if not len(gram):
            return _decided(did, row, lo, n, gram, np.zeros(0, np.uint8))
        (did, row, lo, n, gram, content), same_gram, fresh, whole, copy = _ordered(did, row, lo, n, gram, content)
        group = np.cumsum(~same_gram) - 1
        kinds = np.bincount(group[fresh])[group]
        hot = np.isin(gram, marks) | (kinds > HOT_PIECES)
        kind = np.where(whole, WHOLE, np.where(hot, HOT, EDGE)).astype(np.uint8)
        told = ~copy & (whole | hot | (kinds > 1))
        return _decided(did[told], row[told], lo[told], n[told], gram[told], kind[told])

    return found.groupBy("frag").applyInPandas(decide, REPEATS)


def _decided(did, row, lo, n, gram, kind) -> pd.DataFrame:
    return pd.DataFrame({"did": did, "row": row, "lo": lo.astype(np.int64), "n": n.astype(np.int64), "gram": gram.view(np.int64),
                         "kind": kind.astype(np.int32)})


PIECES = "bucket long, did binary, row binary, lo binary, n binary, text binary"


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, did, row, z): texts compressed, for the two shuffles that carry them."""
    def squeeze(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([z.compress(t.as_py()) if t.is_valid else None for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["doc_id", "did", "row", "z"])

    return docs.select("doc_id", "did", "row", F.col("text").cast("binary").alias("text")).mapInArrow(squeeze, "doc_id long, did long, row long, z binary")


def _unpacked(z):
    import zstandard

    return b"" if z is None else zstandard.ZstdDecompressor().decompress(z)


def undecided_texts(docs: DataFrame, told: DataFrame, buckets: int) -> DataFrame:
    """Texts of the undecided pieces by bucket: of the anchor, or of the content of single strings where it is frequent."""
    asked = (told.where(F.col("kind") != WHOLE).groupBy("did", "row").agg(F.collect_list(F.struct("lo", "n", "gram", "kind")).alias("p"))
             .select("did", "row", *[F.col(f"p.{c}").alias(c) for c in ("lo", "n", "gram", "kind")]))

    def cut(batches):
        for batch in batches:
            rows: dict[int, list] = {}
            strings: dict[bytes, tuple[int, int, tuple]] = {}
            for did, key, z, los, ns, grams, kinds in batch.itertuples(index=False):
                raw = _unpacked(z)
                for lo, n, gram, kind in zip(los.tolist(), ns.tolist(), grams.tolist(), kinds.tolist()):
                    if kind == EDGE:
                        rows.setdefault(gram % buckets, []).append((did, key, lo, n, raw[lo:lo + n - 1 + LENGTH]))
                        continue
                    for s in range(lo, lo + n):
                        string = raw[s:s + LENGTH]
                        d, at, keys = strings.setdefault(string, (did, s, (key,)))
                        if (d, at) == (did, s):  # rows that share a doc_id: all are told with the first
                            if key not in keys:
                                strings[string] = (d, at, (*keys, key))
                        elif (d, at) < (did, s):  # both are told; the earlier one may be the first of the corpus
                            rows.setdefault(-1, []).append((did, key, s, 1, b""))
                        else:
                            strings[string] = (did, s, (key,))
                            rows.setdefault(-1, []).extend((d, k, at, 1, b"") for k in keys)
            for string, (did, s, keys) in strings.items():
                b = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") % buckets
                rows.setdefault(b, []).extend((did, k, s, 1, string) for k in keys)
            yield pd.DataFrame([(b if b >= 0 else buckets + r[0][0] % buckets, *[np.array([x[i] for x in r], np.int64).tobytes() for i in range(3)],
                                 np.array([x[3] for x in r], np.uint8).tobytes(), b"".join(x[4] for x in r)) for b, r in rows.items()],
                               columns=["bucket", "did", "row", "lo", "n", "text"])

    rows = _packed_texts(docs).select("did", "row", "z").join(asked, ["did", "row"]).select("did", "row", "z", "lo", "n", "gram", "kind")
    return rows.mapInPandas(cut, PIECES)


def repeated_starts(raw: np.ndarray, start: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which starts have a longest previous factor of `length` or more.

    Suffixes are sorted to a depth of `length`. Within a run of suffixes that agree so
    far, the previous or the next smaller text position exists where the minimum
    before or after a suffix is smaller than its own.
    """
    head, = block_hashes(raw, (64,))
    both = _mix(head[start] * _P[4] + head[start + length - 64])
    order = np.argsort(both, kind="stable")
    equal = both[order][1:] == both[order][:-1]
    several = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    idx = order[several[:len(order)]] if len(order) else order
    out = np.zeros(len(start), bool)
    if not len(idx):
        return out
    suffix = np.lib.stride_tricks.sliding_window_view(raw, length)[start[idx]].copy().view(f"S{length}").ravel()
    by = np.argsort(suffix, kind="stable")
    idx, suffix = idx[by], suffix[by]
    run = np.cumsum(np.concatenate([[False], suffix[1:] != suffix[:-1]]))
    pos = rank[idx]
    span = int(rank.max()) + 1 if len(rank) else 1
    before = np.minimum.accumulate(pos - run * span) + run * span       # runs descend, so each starts its own minimum
    after = (np.minimum.accumulate((pos + run * span)[::-1]))[::-1] - run * span
    out[idx] = (before < pos) | (after < pos)
    return out


def decided_pieces(texts: DataFrame, buckets: int) -> DataFrame:
    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        did, row, lo = (_column(rows[c], np.int64) for c in ("did", "row", "lo"))
        n = _column(rows["n"], np.uint8).astype(np.int64)
        none = np.zeros(len(did), np.uint64)
        if int(key[0]) >= buckets:
            return _decided(did, row, lo, n, none, np.zeros(len(did), np.uint8))
        raw = np.frombuffer(b"".join(rows["text"]), np.uint8)
        begin = np.cumsum(np.concatenate([[0], n - 1 + LENGTH]))[:-1]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, start = np.repeat(did, n), np.repeat(lo, n) + inside
        order = np.lexsort((start, own))
        new = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (start[order][1:] != start[order][:-1])])
        rank = np.empty(len(own), np.int64)
        rank[order] = np.cumsum(new) - 1
        again = repeated_starts(raw, np.repeat(begin, n) + inside, rank)
        # Runs of repeated starts, by row.
        key, order = np.repeat(row, n), np.flatnonzero(again)
        order = order[np.lexsort((start[order], key[order], own[order]))]
        own, key, start = own[order], key[order], start[order]
        same = np.concatenate([[False], (own[1:] == own[:-1]) & (key[1:] == key[:-1])])[:len(own)]
        new = ~(same & np.concatenate([[False], start[1:] == start[:-1]])[:len(own)])
        own, key, start, same = own[new], key[new], start[new], same[new]
        first = np.flatnonzero(~(same & np.concatenate([[False], start[1:] == start[:-1] + 1])[:len(own)]))
        count = np.diff(np.append(first, len(own)))
        return _decided(own[first], key[first], start[first], count, np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint8))

    return texts.groupBy("bucket").applyInPandas(decide, REPEATS)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut_out(text: bytes, los, ns) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and their maximal runs."""
    if los is None or not len(los):
        return text, 0, 0
    los, ends = np.asarray(los, np.int64), np.asarray(los, np.int64) + np.asarray(ns, np.int64) - 1 + LENGTH
    fits = ends <= len(text)
    order = np.argsort(los[fits], kind="stable")
    los, ends = los[fits][order], np.maximum.accumulate(ends[fits][order])
    if not len(los):
        return text, 0, 0
    new = np.flatnonzero(np.concatenate([[True], los[1:] > ends[:-1]]))
    begin, stop = los[new], ends[np.append(new[1:], len(los)) - 1]
    kept = b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*begin.tolist(), len(text)]))
    return kept, len(text) - len(kept), len(new)


def deduplicated(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, the digest of what is left, and (with_text) the bytes left."""
    ship_code(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("row"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, blocks(size // 40, ANCHORS_PER_FRAGMENT))
    told = durable(decisions(anchors(rows, fragments), fragments))
    weight = F.when(F.col("kind") == HOT, F.col("n")).otherwise(F.when(F.col("kind") == EDGE, 1).otherwise(0))
    buckets = max(8, blocks(told.agg(F.sum(weight)).first()[0] or 0, PIECES_PER_BUCKET))
    edges = durable(decided_pieces(undecided_texts(rows, told, buckets), buckets))
    repeats = (told.where(F.col("kind") == WHOLE).select("did", "row", "lo", "n").union(edges.select("did", "row", "lo", "n"))
               .groupBy("did", "row").agg(F.collect_list(F.struct("lo", "n")).alias("r")).select("did", "row", F.col("r.lo").alias("lo"), F.col("r.n").alias("n")))

    def finish(batches):
        for batch in batches:
            out = []
            for doc_id, z, los, ns in batch.itertuples(index=False):
                raw = _unpacked(z)
                kept, removed, spans = _cut_out(raw, los, ns)
                out.append((doc_id, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return _packed_texts(rows).join(repeats, ["did", "row"], "left").select("doc_id", "z", "lo", "n").mapInPandas(finish, KEPT)


def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, with_text=False).drop("kept")

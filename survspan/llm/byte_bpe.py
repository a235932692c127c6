"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is split into pre-tokens by the vocabulary's pattern. The distinct
pre-tokens of a slice of texts first meet a minimal perfect hash over the whole
vocabulary (a displacement per bucket sends each of the n tokens to a slot of its own
among n, all pre-tokens of a slice at once); the token stored there is compared byte by byte, and
an equal one is the id. Misses are merged: their bytes form a linked list, a
heap holds the adjacent pairs that are tokens by (rank, position), and the lowest rank, leftmost
first, is joined until no pair is a token. The merged pre-tokens seen last are remembered.

Documents are coded inside the tasks that read them; nothing is shuffled. Slices hold a few MB of
text, and a text longer than that is split into pre-tokens piece by piece.

Defined cases: a null or empty text has no ids and decodes to the empty string; repeated rows stay
rows of their own; an empty table gives an empty result; other columns are kept as they are (`encoded`, `decoded`)
or not read (`op13_byte_bpe`). Bytes that are no UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ..session import ship_code

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SLICE_CHARS = 1 << 21
SLICE_PIECES = 1 << 19
REMEMBERED = 400_000

_LOW = (1 << 32) - 1


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    return h ^ (h >> np.uint64(29))


class MinimalPerfectHash:
    """Sends each of n distinct byte strings to a slot of its own in 0 to n - 1; others go to any slot.

    A string's bucket picks a displacement d, its slot is a hash of the string and d, mod n. Buckets
    are placed largest first, each with the first d that sends its strings to free slots
    of their own; buckets of one string take the slots left over.
    """

    KEYS_PER_BUCKET = 2
    TRIES = 256

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.longest = max(map(len, keys), default=0)
        data = np.frombuffer(b"".join(keys), np.uint8)
        lengths = np.fromiter(map(len, keys), np.int64, self.n)
        base = 0x9E3779B97F4A7C15
        while True:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(self.longest + 1, base, np.uint64))
            hashes = self._hashes(data, np.cumsum(lengths) - lengths, lengths)
            if len(np.unique(hashes)) == self.n:
                break
            base += 2
        self.shift = np.zeros(max(1, self.n // self.KEYS_PER_BUCKET), np.int64)
        self._place(hashes)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One number per string data[start:start + length]; none is empty or longer than the longest key."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        ends = np.cumsum(lengths)
        within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        with np.errstate(over="ignore"):
            terms = (data[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)) * self.powers[within]
            return np.add.reduceat(terms, ends - lengths)

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mixed(hashes, 0xBF58476D1CE4E5B9) % np.uint64(len(self.shift))).astype(np.int64)

    def _slot(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            moved = hashes + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            return (_mixed(moved, 0x94D049BB133111EB) % np.uint64(max(1, self.n))).astype(np.int64)

    def _place(self, hashes: np.ndarray):
        bucket = self._bucket(hashes)
        members = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=len(self.shift))
        begin = np.cumsum(size) - size
        free = np.ones(self.n, bool)
        order = np.argsort(-size, kind="stable")
        for k in order[size[order] > 1].tolist():
            own = members[begin[k]:begin[k] + size[k]]
            d = np.arange(self.TRIES)[:, None]
            while True:
                slots = self._slot(hashes[own], d)
                apart = np.sort(slots, 1)
                good = free[slots].all(1) & (apart[:, 1:] != apart[:, :-1]).all(1)
                if good.any():
                    break
                d = d + self.TRIES
            i = int(good.argmax())
            free[slots[i]] = False
            self.shift[k] = d[i, 0]
        alone = order[size[order] == 1]
        self.shift[alone] = -1 - np.flatnonzero(free)[:len(alone)]

    def slots(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        hashes = self._hashes(data, starts, lengths)
        d = self.shift[self._bucket(hashes)]
        return np.where(d < 0, -1 - d, self._slot(hashes, d))


class ByteBPE:
    """Encoder and decoder for the ranks of a file with one base64 token and its rank per line."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        names = [*self.ranks]
        self.hash = MinimalPerfectHash(names)
        data, starts, lengths = _laid_out(pa.array(names, pa.large_binary()))
        slots = self.hash.slots(data, starts, lengths)
        self.slot_token, self.slot_rank = np.empty(len(names), object), np.zeros(len(names), np.int32)
        self.slot_length = np.zeros(len(names), np.int64)
        self.slot_token[slots], self.slot_rank[slots] = names, [*self.ranks.values()]
        self.slot_length[slots] = lengths
        self.remembered, self.known = remembered, {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by joining the pair of lowest rank, leftmost first."""
        n, rank = len(piece), self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pair = [rank(piece[i:i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & _LOW
            if pair[i] != top >> 32:
                continue  # one of its two parts has since been joined to another
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            if end < n:
                before[end] = i
                r = pair[i] = rank(piece[i:after[end]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            left = before[i]
            if left >= 0:
                r = pair[left] = rank(piece[left:end], -1)
                if r >= 0:
                    heappush(heap, r << 32 | left)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return ids

    def _lookup(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens one after another, how many of each)."""
        data, starts, lengths = _laid_out(distinct)
        fits = np.flatnonzero(lengths <= self.hash.longest)
        slots = self.hash.slots(data, starts[fits], lengths[fits])
        same = self.slot_length[slots] == lengths[fits]
        fits, slots = fits[same], slots[same]
        raw = data.tobytes()
        equal = np.fromiter((raw[s:s + n] == t for s, n, t in zip(
            starts[fits].tolist(), lengths[fits].tolist(), self.slot_token[slots].tolist())), bool, len(fits))
        hit, slots = fits[equal], slots[equal]
        missed = np.ones(len(distinct), bool)
        missed[hit] = False
        if len(self.known) > self.remembered:
            self.known.clear()
        known, count = self.known, np.ones(len(distinct), np.int64)
        found = []
        for s, n in zip(starts[missed].tolist(), lengths[missed].tolist()):
            piece = raw[s:s + n]
            ids = known.get(piece)
            if ids is None:
                ids = self.merged(piece)
                if n <= 64:
                    known[piece] = ids
            found.append(ids)
        count[missed] = [*map(len, found)]
        flat = np.empty(int(count.sum()), np.int32)
        at_hit = np.zeros(len(flat), bool)
        at_hit[(np.cumsum(count) - count)[hit]] = True
        flat[at_hit] = self.slot_rank[slots]
        flat[~at_hit] = np.fromiter(chain.from_iterable(found), np.int32)
        return flat, count

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pre-tokens one after another, where each one's ids begin and the last ones end)."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        flat, count = self._lookup(coded.dictionary)
        which = coded.indices.to_numpy()
        sizes = count[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        begin = (np.cumsum(count) - count)[which]
        return flat[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def _encode_long(self, text: str) -> np.ndarray:
        found, out = self.split.finditer(text), [np.zeros(0, np.int32)]
        while pieces := [m.group() for m in islice(found, SLICE_PIECES)]:
            out.append(self._ids_of(pieces)[0])
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > SLICE_CHARS:
                yield self._encode_long(texts[at])
                at += 1
                continue
            size, end = 0, at
            while end < len(texts) and size + len(texts[end]) <= SLICE_CHARS:
                size += len(texts[end])
                end += 1
            pieces = [self.split.findall(t) for t in texts[at:end]]
            ids, bounds = self._ids_of([*chain.from_iterable(pieces)])
            ends = bounds[np.cumsum([*map(len, pieces)])].tolist()
            del pieces
            yield from (ids[a:b] for a, b in zip([0, *ends], ends))
            at = end

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _laid_out(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of a large string or binary array."""
    _valid, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, bounds[:-1], np.diff(bounds)


_CODECS: dict[tuple[str, str], ByteBPE] = {}  # one per worker process, vocabulary and pattern


def codec(vocabulary: str = VOCABULARY, pattern: str | None = None) -> ByteBPE:
    """vocabulary: a file name of the public tokenizers, or a path; pattern: theirs, unless given."""
    import os

    import public_tokenizers

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    key = (path, pattern or public_tokenizers.PATTERN)
    if key not in _CODECS:
        _CODECS[key] = ByteBPE(*key)
    return _CODECS[key]


def _texts(values) -> list[str]:
    return [b.decode("utf-8", "replace") if b is not None else "" for b in values]


def encoded(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with a column of token ids (array<int>) for the text column; it replaces a column of that name."""
    ship_code(docs.sparkSession)
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != ids]).alias("row"),
                       F.col(f"`{text}`").cast("binary").alias("raw"))
    schema = StructType([rest.schema["row"], StructField("ids", ArrayType(IntegerType(), False), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from survspan.llm.byte_bpe import _texts, codec

        bpe = codec(vocabulary)
        for batch in batches:
            got = [*bpe.encode(_texts(batch.column("raw").to_pylist()))]
            bounds = np.concatenate([[0], np.cumsum([*map(len, got)])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *got])
            column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("row"), column], names=["row", "ids"])

    out = rest.mapInArrow(work, schema)
    return out.select("row.*", F.col("ids").alias(ids))


def decoded(rows: DataFrame, ids: str = "ids", raw: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the bytes (binary) that a column of token ids stands for; null ids give no bytes."""
    ship_code(rows.sparkSession)
    rest = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != raw]).alias("row"),
                       F.col(f"`{ids}`").alias("ids"))
    schema = StructType([rest.schema["row"], StructField("raw", BinaryType(), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from survspan.llm.byte_bpe import codec

        bpe = codec(vocabulary)
        for batch in batches:
            back = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(back, pa.binary())], names=["row", "raw"])

    return rest.mapInArrow(work, schema).select("row.*", F.col("raw").alias(raw))


def op13_byte_bpe(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of every document's ids and of what they decode to; both stay inside the task."""
    ship_code(docs.sparkSession)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from survspan.llm.byte_bpe import _texts, codec

        bpe = codec(vocabulary)
        names = [str(i) for i in range(len(bpe.tokens))]
        for batch in batches:
            rows = []
            for ids in map(np.ndarray.tolist, bpe.encode(_texts(batch["raw"]))):
                listed = ",".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInPandas(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

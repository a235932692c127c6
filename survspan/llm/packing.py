"""Packing token sequences by first-fit decreasing over a tournament tree.

Texts are tokenised inside the tasks and cut into pieces of at most `capacity`
ids: full pieces, and one remainder per document. Documents are dealt into
randomised groups of about `docs_per_group`; each group packs its remainders by
first-fit decreasing, where a tournament tree over the bins' free room gives the
first bin that fits in log(bins) steps. Only lengths and checksums reach the
groups, never ids.

Defined cases: a null or empty text is its end id alone; repeated rows are packed as
rows of their own; an empty table gives no piece. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import blocks, durable, text_or_empty

CAPACITY = 2048
END_ID = 1
DOCS_PER_GROUP = 4096
TOKENIZER = "word_bpe_49k.json"
MARKS = ".,;:!?"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ChunkedTokenizer:
    """Ids of whole texts, tokenising every distinct chunk between blanks once.

    White space never becomes part of an id in this vocabulary, so that ids of
    chunks between ASCII blanks concatenate to the ids of the text.
    """

    def __init__(self, path: str, memory: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = memory
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, "<u4")
        self.ends = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]):
        """Give every chunk a number; its ids are flat[ends[number - 1]:ends[number]]."""
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > self.memory and self.known:
            self.clear()
            new = chunks
        if not new:
            return
        # A mark after a letter is always split off, so that "word" and "word," share their ids.
        # (Letters past U+024F, and those whose lower case ends in a combining mark, are left alone.)
        stems = {c: c[:-1] if len(c) > 1 and c[-1] in MARKS and c[-2] < "\u0250" and c[-2].lower()[-1].isalpha() else c
                 for c in new}
        ids = self._ids_of([*dict.fromkeys([*stems.values(), *MARKS])])
        made = [ids[s] if len(s) == len(c) else ids[s] + ids[c[-1]] for c, s in stems.items()]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in made for i in x), "<u4")])
        self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum([len(x) for x in made])])

    def _ids_of(self, stems: list[str]) -> dict[str, list[int]]:
        """A run of ASCII letters is one piece for the model; others pass the whole tokenizer."""
        out, others, known, flat, ends = {}, [], self.known, self.flat, self.ends
        for s in stems:
            at = known.get(s)
            if at is not None:
                out[s] = flat[ends[at - 1] if at else 0:ends[at]].tolist()
            elif s.isascii() and s.isalpha():
                out[s] = [t.id for t in self.model.tokenize(s.lower())]
            else:
                others.append(s)
        out.update(zip(others, (e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False))))
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.learn(names)
        number = np.array([self.known[c] for c in names], np.int64)[coded.indices.to_numpy()]
        begin = np.concatenate([[0], self.ends])[number]
        count = self.ends[number] - begin
        after = np.cumsum(count)
        at = np.repeat(begin - after + count, count) + np.arange(after[-1] if len(after) else 0)
        bounds = np.concatenate([[0], after])[split.offsets.to_numpy()]
        ids = self.flat[at]
        return [np.append(ids[i:j], np.uint32(END_ID)).astype("<u4") for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_TOKENIZERS: dict[str, ChunkedTokenizer] = {}  # one per worker process and vocabulary


def _tokenizer(vocabulary: str) -> ChunkedTokenizer:
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkedTokenizer(path)
    return _TOKENIZERS[path]


def _slices(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > most or i == len(texts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def tokenised(docs: DataFrame, vocabulary: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; `deal` is the same random number for all pieces of a document."""
    ship_code(docs.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from survspan.llm.packing import _tokenizer  # the worker's own, kept between tasks

        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            texts, doc_ids, deals = batch["text"].tolist(), batch["doc_id"].tolist(), batch["deal"].tolist()
            for a, b in _slices(texts):
                rows = []
                for doc_id, deal, ids in zip(doc_ids[a:b], deals[a:b], tokenizer.ids(texts[a:b])):
                    for start in range(0, len(ids), capacity):
                        piece = ids[start:start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece), len(ids), deal))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"]).astype(
                    {"doc_id": "Int64"})

    dealt = docs.select("doc_id", text_or_empty().alias("text")).withColumn("deal", F.xxhash64("doc_id", "text"))
    return dealt.mapInPandas(pieces, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items longest first, each into the first bin with room.

    The tree's leaves hold the free room of the bins in order, its inner nodes
    the larger of their two children. Going left where the left child fits finds
    the first bin.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable"):
        need = int(lengths[item])
        node = 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    def pack_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns=["group", "deal"])

    ship_code(pieces.sparkSession)
    return (pieces.withColumn("group", F.pmod("deal", F.lit(groups)))
            .groupBy("group").applyInPandas(pack_group, PACKED))


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their places. Sequences are padded to the capacity, unless their length is a power of two."""
    pieces = durable(tokenised(docs, capacity=capacity))
    return pack(pieces, blocks(pieces.where("start = 0").count(), DOCS_PER_GROUP), capacity)


def op7_packing(docs: DataFrame) -> DataFrame:
    return packed(docs)

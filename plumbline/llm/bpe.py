"""Byte-level BPE over whole corpora.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is itself a
token, for all distinct pre-tokens of an Arrow batch at once in numpy. The rest are merged over a
linked list of bytes with a heap that yields the pair of the lowest rank. Distinct pre-tokens that
were resolved stay in a bounded memo, which only saves time.

Texts are encoded whole, beside the scan: no shuffle, and memory is that of one slice of a batch.
Null and empty texts have the empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import spread

#: Where the vocabulary file of byte_bpe_50k lies; a parameter of every function here.
DEFAULT_RANKS = os.environ.get("PLUMBLINE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public pattern that splits text before the merges. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Memo entries per Python worker, and bytes of text handled at a time; bounds on memory only.
MEMO_ENTRIES, SLICE_BYTES = 300_000, 8 << 20
#: Longer pre-tokens are not kept in the memo.
_MEMO_KEY_CHARS = 256


class MinimalPerfectHash:
    """Maps each of n distinct 64-bit hashes to its own slot of n, with about 4 bits a key besides the check values.

    Each level holds a bit for every place that exactly one remaining key falls on; keys that
    collide go on to the next level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, hashes: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        remaining, before = np.asarray(hashes, np.uint64), 0
        if len(np.unique(remaining)) != len(remaining):
            raise ValueError("two keys have the same 64-bit hash")
        while len(remaining):
            size = max(64, int(len(remaining) * room))
            at = self._place(remaining, len(self.levels), size)
            count = np.bincount(at, minlength=size)
            bits = count == 1
            ranks = np.cumsum(bits) - 1 + before
            self.levels.append((bits, ranks, size))
            before += int(bits.sum())
            remaining = remaining[count[at] > 1]
        self.checks = np.zeros(before, np.uint64)
        self.checks[self.slots(np.asarray(hashes, np.uint64), verify=False)] = hashes

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, h: np.ndarray, verify: bool = True) -> np.ndarray:
        """The slot of each hash, or -1 where no key has it."""
        h = np.asarray(h, np.uint64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, (bits, ranks, size) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._place(h[todo], level, size)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        if verify and len(self.checks):
            out[(out >= 0) & (self.checks[out] != h)] = -1
        return out


class Encoder:
    """Encodes texts with one rank file."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.find = regex.compile(PATTERN).findall
        words = list(self.ranks)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        self.mph = MinimalPerfectHash(hashes)
        slots = self.mph.slots(hashes)
        self.slot_word: list[bytes] = [b""] * len(words)
        self.slot_id = np.zeros(len(words), np.int64)
        for s, w in zip(slots.tolist(), words):
            self.slot_word[s], self.slot_id[s] = w, self.ranks[w]
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of a pre-token by merging bytes: second tier."""
        n, get = len(word), self.ranks.get
        if n < 2:
            return tuple(self.ranks[word[i : i + 1]] for i in range(n))
        end = list(range(1, n + 1))  # where the symbol that starts at i ends; its end is the next one's start
        prev = list(range(-1, n))
        rank = [-1] * n  # the rank of the symbol at i with its right neighbour, while both stand
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                rank[i] = r
                heap.append((r << 40) | i)
        heapify(heap)
        mask = (1 << 40) - 1
        while heap:
            x = heappop(heap)
            i = x & mask
            if rank[i] != x >> 40:
                continue
            j = end[i]
            k = end[j]
            end[i], rank[j] = k, -1
            rank[i] = -1
            if k < n:
                prev[k] = i
                r = get(word[i : end[k]])
                if r is not None:
                    rank[i] = r
                    heappush(heap, (r << 40) | i)
            p = prev[i]
            if p >= 0:
                r = get(word[p:k])
                if r is None:
                    rank[p] = -1
                elif r != rank[p]:
                    rank[p] = r
                    heappush(heap, (r << 40) | p)
                else:
                    rank[p] = r
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _resolve(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens: the hash for those in the vocabulary, merging for the others."""
        texts = list(words)
        raw = [t.encode("utf-8") for t in texts]
        slots = self.mph.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)))
        ids = self.slot_id[slots].tolist()
        out = {}
        for t, w, s, i in zip(texts, raw, slots.tolist(), ids):
            out[t] = (i,) if s >= 0 and self.slot_word[s] == w else self.merge(w)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        cut = [self.find(t) if t else [] for t in texts]
        new = self._resolve(set(chain.from_iterable(cut)).difference(self.memo))
        self.memo.update(new)
        get = self.memo.__getitem__
        out = [list(chain.from_iterable(map(get, c))) for c in cut]
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        for long in [w for w in new if len(w) > _MEMO_KEY_CHARS]:
            self.memo.pop(long, None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str = DEFAULT_RANKS) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(read_vocabulary(path))


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes) -> Encoder:
    """The same from the file's content."""
    return Encoder(vocabulary)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file; one of more than 64 MB is refused, so it may be sent along with every job."""
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path}: too large for a vocabulary")
    with open(path, "rb") as f:
        return f.read()


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t or "") * 3
    if start < len(texts):
        yield start, len(texts)


def encode_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str = DEFAULT_RANKS, counts_only: bool = False) -> DataFrame:
    """(doc_id, ids) of every row, or (doc_id, text_key, n_tokens) with ``counts_only``.

    One row out for each row in, repeated rows included; null and empty texts have the empty list
    and 0 tokens; an empty table gives no rows; other columns are not read. ``text_key`` is a
    64-bit hash that tells different texts of one doc_id apart.
    """
    kind = documents.schema[doc_id].dataType
    if counts_only:
        columns = [F.col(doc_id), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text")]
        schema = T.StructType([T.StructField(doc_id, kind), T.StructField("text_key", T.LongType()), T.StructField("n_tokens", T.LongType())])
    else:
        columns = [F.col(doc_id), F.col(text).alias("text")]
        schema = T.StructType([T.StructField(doc_id, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    n_keys, names = len(columns) - 1, schema.names
    # Broadcast, so that executors need no file of their own.
    vocabulary = documents.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(vocabulary.value)
        for batch in batches:
            texts = batch.column(n_keys).to_pylist()
            for a, b in _slices(texts):
                ids = e.encode_batch(texts[a:b])
                lengths = np.fromiter(map(len, ids), np.int64, b - a)
                keys = [batch.column(i).slice(a, b - a) for i in range(n_keys)]
                if counts_only:
                    value = pa.array(lengths)
                else:
                    offsets = np.zeros(b - a + 1, np.int32)
                    np.cumsum(lengths, out=offsets[1:])
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*keys, value], names=names)

    return spread(documents.select(*columns)).mapInArrow(run, schema)

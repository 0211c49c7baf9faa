"""Byte-level BPE: encode texts to ids and decode ids to bytes.

A minimal perfect hash over the vocabulary answers whole pre-tokens; a miss goes through pair merges
ordered by a heap over a doubly linked list of its bytes.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_hash = xxhash.xxh3_64_intdigest


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file (base64 token, rank) as a list, its index the rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash of n keys to n slots by hash and displace.

    A first hash picks a bucket. A bucket of several keys stores the seed that sends them all to free
    slots, a bucket of one key stores its slot as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.shift, self.slot = n, [0] * n, [-1] * n
        buckets: dict[int, list[int]] = {}
        for i, k in enumerate(keys):
            buckets.setdefault(_hash(k) % n, []).append(i)
        single = []
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            seed = 1
            while True:
                at = [_hash(keys[i], seed) % n for i in members]
                if len({*at}) == len(at) and all(self.slot[x] < 0 for x in at):
                    break
                seed += 1
            self.shift[b] = seed
            for x, i in zip(at, members, strict=True):
                self.slot[x] = i
        free = (x for x in range(n) if self.slot[x] < 0)
        for (b, i), x in zip(single, free, strict=False):
            self.shift[b] = -1 - x
            self.slot[x] = i

    def find(self, key: bytes) -> int:
        """The number of the only key that key can be equal to; the caller compares."""
        s = self.shift[_hash(key) % self.n]
        return self.slot[-1 - s if s < 0 else _hash(key, s) % self.n]


class Bpe:
    """Encoder and decoder for one vocabulary and one splitting pattern."""

    #: Entries of the memo of pre-tokens; it starts anew when full.
    MEMO = 300_000

    def __init__(self, vocab: list[bytes], pattern: str):
        self.vocab, self.pattern, self.table = vocab, pattern, PerfectHash(vocab)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("vocab", "pattern", "table")}

    def rank(self, piece: bytes) -> int:
        """The id of piece, -1 if it isn't in the vocabulary."""
        i = self.table.find(piece)
        return i if self.vocab[i] == piece else -1

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.vocab)}

    @cached_property
    def whole(self) -> bool:
        """Whether each byte is a token, so that every text has ids."""
        return all(bytes([b]) in self.ranks for b in range(256))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that isn't a token: the pair of least rank, the leftmost first, merges until none is left.

        A node is known by its first byte; end links it to the next node (0: merged away), before to the last one.
        A heap entry packs rank, first byte and end of a pair, and is stale when the pair no longer ends there.
        """
        n, get, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        s = n.bit_length()
        mask = (1 << s) - 1
        end, before = [*range(1, n + 1), 0], [*range(-1, n)]
        heap = []
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                heap.append(((r << s) | i) << s | (i + 2))
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            stop, i = top & mask, (top >> s) & mask
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j], before[stop] = stop, 0, i
            if stop < n:
                r = get(piece[i : end[stop]])
                if r is not None:
                    push(heap, ((r << s) | i) << s | end[stop])
            p = before[i]
            if p >= 0:
                r = get(piece[p:stop])
                if r is not None:
                    push(heap, ((r << s) | p) << s | stop)
        out, i = [], 0
        while i < n:
            out.append(get(piece[i : end[i]]))
            i = end[i]
        if not self.whole and None in out:
            raise ValueError("a byte of the text is not in the vocabulary")
        return out

    def piece(self, token: str) -> list[int]:
        raw = token.encode()
        r = self.rank(raw)
        return [r] if r >= 0 else self.merge(raw)

    @cached_property
    def memo(self) -> dict[str, bytes]:
        """Ids of pre-tokens as the bytes of int32; one bounded memo for each Python worker."""
        limit, piece = self.MEMO, self.piece

        class Memo(dict):
            def __missing__(self, token: str) -> bytes:
                if len(self) >= limit:
                    self.clear()
                out = array("i", piece(token)).tobytes()
                if len(token) <= 64:
                    self[token] = out
                return out

        return Memo()

    def encoder(self):
        """A function from text to the bytes of its int32 ids."""
        get, split = self.memo.__getitem__, regex.compile(self.pattern).findall
        return lambda text: b"".join(map(get, split(text)))


def load(spark: SparkSession, path: str, pattern: str):
    """The model as a broadcast; its size is that of the vocabulary, whatever the texts."""
    return spark.sparkContext.broadcast(Bpe(read_ranks(path), pattern))


def encode(text: str | Column, model) -> Column:
    """array<int>: the ids of a text, each match of the pattern on its own, no special tokens. A null or empty text has no ids. A byte that is no token of the vocabulary raises an error."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = model.value.encoder()
        for b in batches:
            parts = [ids(x.as_py()) if x.is_valid else b"" for x in b]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def decode(ids: str | Column, model) -> Column:
    """binary: the bytes of ids joined. Null or no ids: no bytes. An id outside the vocabulary raises an error."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = model.value.vocab.__getitem__
        for b in batches:
            out, flat = [], b.values.to_numpy(zero_copy_only=False)
            starts = b.offsets.to_numpy()
            if len(flat) and flat.min() < 0:
                raise ValueError("an id outside the vocabulary")
            for i, lo, hi in zip(range(len(b)), starts[:-1], starts[1:], strict=True):
                out.append(b"".join(map(get, flat[lo:hi].tolist())) if b[i].is_valid else b"")
            yield pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(ids)


def encode_documents(df: DataFrame, model, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with ids_col and decoded_col, which replace columns of these names. Every row stays, repeated ones too; an empty table stays empty."""
    return df.withColumn(ids_col, encode(df[text_col], model)).withColumn(decoded_col, decode(F.col(ids_col), model))

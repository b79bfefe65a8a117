"""Byte-level BPE encoding and decoding of a text column.

Two tiers. A minimal perfect hash (hash and displace) maps every vocabulary entry to its own
slot of an array without gaps; a pre-token whose bytes are an entry is resolved by one probe. Any
other pre-token is merged by a heap of adjacent pairs over linked bytes: the pair of least rank
(leftmost of equals) is joined, its two new neighbours enter the heap, stale pairs are skipped.

The rank file is read once on the driver. The tables of one vocabulary (a few MB, whatever the
data) travel with the tasks, so executors need no file and a lost one costs nothing.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import slices, whole

_MASK = (1 << 64) - 1
#: Chunks and pre-tokens whose ids a worker remembers; beyond it the memory starts anew. Speed only.
MEMO_CHUNKS = 400_000
MEMO_PIECES = 400_000
#: Keys of one bucket of the perfect hash, on average.
_BUCKET = 2
#: The part of a heap entry that has the start within a pre-token.
_LOW = (1 << 40) - 1


def _slot(h: int, shift: int, n: int) -> int:
    x = (h + shift * 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash of byte strings: ``find`` gives a key's value, or -1 for any other."""

    def __init__(self, values: dict[bytes, int]):
        n = len(values)
        self.n, self.m = n, max(1, n // _BUCKET)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in values:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((h, key))
        self.shift = [0] * self.m
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        full = bytearray(n)
        free = n
        for at, bucket in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
            if len(bucket) == 1:  # the last ones take what is left: the shift names the slot
                free -= 1
                while full[free]:
                    free -= 1
                slots, self.shift[at] = [free], -free - 1
            else:
                shift = 1
                while True:
                    slots = [_slot(h, shift, n) for h, _ in bucket]
                    if len(set(slots)) == len(slots) and not any(full[s] for s in slots):
                        break
                    shift += 1
                self.shift[at] = shift
            for slot, (_, key) in zip(slots, bucket, strict=True):
                full[slot], self.keys[slot], self.values[slot] = 1, key, values[key]

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[h % self.m]
        slot = -shift - 1 if shift < 0 else _slot(h, shift, self.n)
        return self.values[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int], single: list[int], double: list[int]) -> list[int]:
    """Ids of a pre-token outside the vocabulary: a heap of pairs over linked bytes.

    A heap entry is rank and start of a pair in one integer; it is stale when the pair that now
    starts there has another rank. ``single`` and ``double`` hold the ranks of one and two bytes, -1 for none.
    """
    n = len(piece)
    after = list(range(1, n + 2))  # the part at i is piece[i:after[i]]
    before = list(range(-1, n))
    ids = [single[b] for b in piece]  # of the part at i; -1 inside of a part
    find, push, pop = ranks.get, heapq.heappush, heapq.heappop
    pair = [double[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    pair.append(-1)
    heap = [rank << 40 | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        top = pop(heap)
        rank, i = top >> 40, top & _LOW
        if pair[i] != rank:
            continue
        j = after[i]
        stop = after[i] = after[j]
        ids[i], ids[j], pair[j] = rank, -1, -1
        if stop < n:
            before[stop] = i
            pair[i] = rank = find(piece[i : after[stop]], -1)
            if rank >= 0:
                push(heap, rank << 40 | i)
        else:
            pair[i] = -1
        left = before[i]
        if left >= 0:
            rank = find(piece[left:stop], -1)
            if rank != pair[left]:
                pair[left] = rank
                if rank >= 0:
                    push(heap, rank << 40 | left)
    return [i for i in ids if i >= 0]


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        self.table = table or PerfectHash(ranks)
        self.vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.vocabulary[rank] = piece
        self.find_all = regex.compile(pattern).findall
        self.cuts = pattern == public_tokenizers.PATTERN
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.double = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.key = xxhash.xxh3_128_hexdigest(repr((pattern, sorted(ranks.items()))))

    def __reduce__(self):
        return _codec_again, (self.key, self.ranks, self.pattern, self.table)

    def piece(self, pre_token: str) -> bytes:
        """Packed ids of a pre-token."""
        raw = pre_token.encode()
        rank = self.table.find(raw)
        return pack_ids([rank] if rank >= 0 else merge_bytes(raw, self.ranks, self.single, self.double))

    def chunk(self, chunk: str) -> bytes:
        known, out = self.pieces, []
        for pre_token in self.find_all(chunk):
            ids = known.get(pre_token)
            if ids is None:
                if len(known) >= MEMO_PIECES:
                    known.clear()
                ids = self.piece(pre_token)
                if len(pre_token) <= 32:
                    known[pre_token] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers.

        By the public pattern a single blank between two other characters always opens the pre-token after it,
        so the chunks between such blanks are independent and equal ones are encoded once. A text is one
        chunk by any other pattern.
        """
        if self.cuts:
            parts = _CUT.split(text) if _RUN.search(text) else _lead(text)
        else:
            parts = [text]
        memo, out = self.memo, []
        for part in parts:
            ids = memo.get(part)
            if ids is None:
                if len(memo) >= MEMO_CHUNKS:
                    memo.clear()
                ids = self.chunk(part)
                if len(part) <= 64:
                    memo[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


#: White space in runs, or at the ends: there a blank may belong to the run.
_RUN = regex.compile(r"\s\s|^\s|\s$")
#: A cut before a blank that follows and precedes a character other than white space.
_CUT = regex.compile(r"(?<=\S)(?= \S)")


def _lead(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *[" " + part for part in rest]]


_CODECS: dict[str, Codec] = {}


def _codec_again(key: str, ranks: dict[bytes, int], pattern: str, table: PerfectHash) -> Codec:
    """One codec a worker and vocabulary, so that its memory lasts over tasks."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern, table)
    return _CODECS[key]


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    """The codec of a rank file: a line has an entry in base 64 and its rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                entry, rank = line.split()
                ranks[base64.b64decode(entry)] = int(rank)
    return Codec(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of its whole texts (array of int) in column ``ids``, which replaces a
    column of that name. A null or empty text has no ids; every row keeps its own, also repeated ones; a text of any
    length takes n log n at most; an empty table gives an empty one."""
    codec = load(path, pattern)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for part in slices(batch):
                rows = [codec.encode(t) for t in part.to_pylist()]
                ends = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(rows))])
                parts.append(pa.ListArray.from_arrays(pa.array(ends), values))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(ids, run(whole(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids in column ``out``; null or no ids: no bytes. An id
    outside the vocabulary is an error."""
    codec = load(path, pattern)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            if len(values) and not (0 <= values.min() and values.max() < len(codec.vocabulary)):
                raise ValueError("an id is outside the vocabulary")
            yield pa.array([codec.decode(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

    return df.withColumn(out, run(F.coalesce(F.col(ids), F.array().cast("array<int>"))))

"""Order-preserving packing of documents into token windows by dynamic programming.

The documents of a task are one stream of ids in the order in which they are read. Windows are
cut out of it without gaps. Possible cuts are the ends of documents (free), the ends of sentences
(a truncation penalty) and, in a stretch of a window or more without either, every so many ids (a
larger penalty). With positions p and penalties w, the best cost up to cut j is

    f(j) = w(j) + size - p(j) + min { f(i) + p(i) : i < j, p(j) - p(i) <= size },

padding plus penalties; the minimum over the sliding range of i comes from a monotone queue, so a
run of cuts costs time in proportion to their number. The last window of a task is cut into
sequences of power-of-two lengths, which need no padding, where their cuts cost less than its
padding would.

A task works in runs of many windows and carries the ids behind its last settled cut into the next
run, so its memory does not grow with its input. Nothing is shuffled, and a task's result depends on its input rows
alone: a task repeated after a lost executor makes the same sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import slices, whole
from changemill.llm.tokens import WordIds

#: Padding ids that a cut is worth: at the end of a sentence, within one.
SENTENCE_PENALTY, INSIDE_PENALTY = 16, 256
#: Distance of cuts within a stretch that has no other.
INSIDE_STEP = 256
#: A run has at least so many windows.
RUN_WINDOWS = 64
_SEQUENCE_BITS = 34
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary()), ("ids_crc32", pa.int64())])


def possible_cuts(ends: np.ndarray, sentences: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of the possible cuts, in ascending order, from 0 to the last id.

    ``ends``: positions after documents; ``sentences``: positions after sentence ends.
    """
    total = int(ends[-1])
    places = np.union1d(np.concatenate([[0], ends]), sentences)
    wide = np.flatnonzero(np.diff(places) >= size)
    inside = [np.arange(places[i] + INSIDE_STEP, places[i + 1], INSIDE_STEP) for i in wide]
    if inside:
        places = np.union1d(places, np.concatenate(inside))
    weights = np.full(len(places), INSIDE_PENALTY)
    weights[np.searchsorted(places, sentences)] = SENTENCE_PENALTY
    weights[np.searchsorted(places, ends)] = 0
    weights[0] = 0
    assert places[-1] == total
    return places, weights


def best_cuts(places: list[int], weights: list[int], size: int, last: bool) -> list[int]:
    """The cheapest chain of cuts from the first place to the end, both included.

    ``last``: no ids follow, and the final window may be cut into powers of two.
    """
    n = len(places)
    cost, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(places[0], 0)])  # cost + place, ascending; place's index
    low = 0
    for j in range(1, n):
        at = places[j]
        while at - places[queue[0][1]] > size:
            queue.popleft()
        value, i = queue[0]
        cost[j], back[j] = weights[j] + size - at + value, i
        value = cost[j] + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    end = n - 1
    tail: list[int] = []
    if last and end:
        total = places[end]
        low = end
        found = (cost[end], back[end], False)
        while low and total - places[low - 1] <= size:
            low -= 1
            rest = total - places[low]
            found = min(found, (cost[low] + (rest.bit_count() - 1) * INSIDE_PENALTY, low, True))
        back[end] = found[1]
        if found[2]:
            at, rest = places[found[1]], total - places[found[1]]
            for bit in range(size.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    at += 1 << bit
                    tail.append(at)
            tail.pop()
    chain = []
    at = end
    while at:
        chain.append(places[at])
        at = back[at]
    chain.append(places[0])
    return sorted(chain + tail)


class _Packer:
    def __init__(self, size: int, is_end: np.ndarray, base: int):
        self.size, self.is_end, self.sequence = size, is_end, base
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # key, ids left, ids before, ids in all
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0, len(ids)))
        self.held += len(ids)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Pieces of the settled windows; the ids behind them stay for the next run."""
        flat = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        sentences = np.flatnonzero(self.is_end[np.minimum(flat, len(self.is_end) - 1)]) + 1
        places, weights = possible_cuts(ends, sentences, self.size)
        cuts = best_cuts(places.tolist(), weights.tolist(), self.size, last)
        if not last:  # what follows may move the last cuts
            cuts = cuts[: max(2, len(cuts) - 2)]
        doc, stops = 0, ends.tolist()
        for begin, stop in zip(cuts[:-1], cuts[1:], strict=True):
            at = begin
            while at < stop:
                while stops[doc] <= at:
                    doc += 1
                key, ids, before, total = self.docs[doc]
                first = stops[doc] - len(ids)
                upto = min(stop, stops[doc])
                raw = ids[at - first : upto - first].tobytes()
                yield key, before + at - first, upto - at, total, self.sequence, at - begin, raw, zlib.crc32(raw)
                at = upto
            self.sequence += 1
        done = cuts[-1]
        keep = bisect_right(stops, done)
        left = self.docs[keep:]
        if left:
            key, ids, before, total = left[0]
            cut = done - (stops[keep] - len(ids))
            left[0] = (key, ids[cut:], before + cut, total)
        self.docs, self.held = left, self.held - done


def pack(
    df: DataFrame, tokenizer: str, end_id: int, size: int = 4096, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` (a power of two) ids.

    One row a piece: doc_id, start (the document's ids before it), length, doc_tokens (the
    document's ids with ``end_id``), sequence_id, offset (in the sequence), ids (binary,
    little-endian unsigned 32-bit), ids_crc32. Each id of each row is in one piece. A null or empty text is its
    end id alone, repeated rows and equal or null keys are packed row by row, other columns are
    not read, and an empty table has no pieces. A sequence is to be padded to ``size`` unless its length is a
    power of two.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    words = WordIds.load(tokenizer, added=True)
    is_end = words.sentence_ends()
    end = np.array([end_id], dtype="<u4").tobytes()

    def made(pieces: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) if pieces else [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, is_end, TaskContext.get().partitionId() << _SEQUENCE_BITS)
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for some in slices(batch.column(1)):
                for found in words.encode(some.to_pylist()):
                    packer.add(keys[at], np.frombuffer(found + end, dtype="<u4"))
                    at += 1
                    if packer.held >= RUN_WINDOWS * size:
                        yield made(list(packer.settle(last=False)))
        if packer.docs:
            yield made(list(packer.settle(last=True)))

    return df.select(F.col(key).cast("long"), whole(text)).mapInArrow(run, _PIECE)

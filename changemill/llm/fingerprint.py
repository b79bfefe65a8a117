"""Lempel-Ziv phrase fingerprints: texts that compress alike have alike sets of phrases.

A text is parsed into dictionary phrases: the longest phrase known so far and one more character
make the next one. The dictionary holds every beginning of its phrases, so the parse may look
for a phrase's end up or down from the last one's length. The phrases' hashes go through fixed hash functions,
and the least value of each is the signature: the share of equal values of two signatures estimates the
Jaccard index of the phrase sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.llm.common import KeyRanges, fresh, slices, whole

VALUES = 64
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def phrases(text: str) -> set[str]:
    """Phrases of a text's parse; an end that repeats a phrase adds none."""
    seen: set[str] = set()
    add, at, n, k = seen.add, 0, len(text), 1
    while at < n:
        phrase = text[at : at + k]
        if phrase in seen:
            while phrase in seen and at + k < n:
                k += 1
                phrase = text[at : at + k]
        else:
            k = len(phrase)
            while k > 1 and (shorter := text[at : at + k - 1]) not in seen:
                k -= 1
                phrase = shorter
        add(phrase)
        at += k
    return seen


def signature(text: str) -> bytes:
    """Least value of each hash function over the phrases, as big-endian 32-bit integers; all
    ones for an empty text."""
    found = phrases(text)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    least = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _A + _B).min(axis=0))
    return (least >> np.uint64(32)).astype(">u4").tobytes()


@F.arrow_udf(T.BinaryType())
def _signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([signature(t) for part in slices(batch) for t in part.to_pylist()], pa.binary())


@F.arrow_udf(T.DoubleType())
def _likeness(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), ">u4").reshape(-1, VALUES) for x in (left, right))
        yield pa.array((a == b).mean(axis=1) if len(a) else np.empty(0))


def fingerprint(text: str | Column) -> Column:
    """Signature of a whole text (binary); a null counts as empty. Equal texts have equal ones."""
    return _signatures(whole(text))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal values of two signatures, 0 to 1."""
    return _likeness(a, b)


def with_next(df: DataFrame, carry: list[str], key: str = "doc_id", rows_per_range: int = 4000, most_ranges: int = 50_000) -> DataFrame:
    """``df`` with ``next_<c>`` for each column of ``carry``: its value in the next row by descending key.

    After the last row comes the first. Rows of one key follow each other by the carried columns, rows
    without key come last. Ranges of the key are sorted by themselves; the last row of a range finds
    the next one as a guest, a copy of the first row of the range below (of the top range for the
    lowest). So no task sees more than a range.
    """
    id_ = fresh(df, "id")
    rows = df.withColumn(id_, F.col(key).cast("long"))
    ids = rows.select(id_)
    n = ids.count()
    ranges = KeyRanges(ids, id_, max(rows_per_range, -(-n // most_ranges)))
    # Cuts that are keys of the table, the largest of each range: exactly these rows are guests.
    tops = ids.where(F.col(id_).isNotNull()).groupBy(ranges.index(F.col(id_)).alias("r")).agg(F.max(id_).alias("top"))
    tops = sorted(r.top for r in tops.collect())
    ranges.cuts = tops[:-1]
    place = ranges.index(F.col(id_)).cast("int")
    at = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    first = F.col(id_).eqNullSafe(F.lit(tops[-1])) if tops else F.lit(True)  # no key at all: any row may be the first
    places = F.array(
        at(place, 0),
        F.when(ranges.index(F.col(id_) + 1) != place, at(place + 1, 1)),
        F.when(first, at(F.lit(0), 1)),
    )
    spot = fresh(df, "spot")
    rows = rows.withColumn(spot, F.explode(F.filter(places, lambda p: p.isNotNull())))
    order = [F.col(spot)["guest"], F.col(id_).desc_nulls_last(), *carry]
    window = Window.partitionBy(F.col(spot)["part"]).orderBy(*order)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in carry})
    return rows.where(F.col(spot)["guest"] == 0).drop(id_, spot)

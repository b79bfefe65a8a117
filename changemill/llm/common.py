"""Small helpers of this subpackage: bounded slices of Arrow batches, row digests, key ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
WHITE = " \t\n\x0b\f\r"
WORD_GAP = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slices(array: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """An Arrow column in slices of about ``most_bytes``, so that working memory follows the
    slice and not the batch. A single longer row is a slice of its own."""
    if not len(array):
        return
    step = max(1, len(array) * most_bytes // max(1, array.nbytes))
    for at in range(0, len(array), step):
        yield array.slice(at, step)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole(text: str | Column) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs of characters other than blank and 0x09-0x0D; none for a text without."""
    none = F.array().cast("array<string>")
    return let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", none).otherwise(F.split(t, WORD_GAP, -1)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often and wherever it is used.

    A column of an earlier projection would not do: the optimizer may write its expression into a
    lambda, where it runs once an element.
    """
    return F.transform(F.array(value), use)[0]


_BLOCK = 512


def starts_of(sizes: Column) -> Column:
    """Sum of the sizes before each one. Blocks keep the appends short, so that an array of n
    sizes costs n times the block and not n squared."""

    def before(values: Column, first: Column) -> Column:
        empty = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(values, empty, step, lambda s: s["out"])

    def in_blocks(values: Column) -> Column:
        n = F.size(values)
        at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(at, lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
        total = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v)
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total), F.lit(0)), before)))

    return let(F.transform(sizes, lambda v: v.cast("long")), in_blocks)


def key128(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes: together a 128-bit key."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


class KeyRanges:
    """Cuts of a sortable integer key into ranges of about ``rows`` rows each.

    The cuts are keys of the table (quantiles within half a range). They take one light pass
    over the key alone and eight bytes a range on the driver.
    """

    def __init__(self, df: DataFrame, key: str, rows: int):
        found = df.agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        self.key, self.low, self.high = key, found.low, found.high
        parts = max(1, -(-found.n // rows))
        at = [i / parts for i in range(1, parts)]
        cuts = df.where(F.col(key).isNotNull()).approxQuantile(key, at, 0.5 / parts) if at else []
        self.cuts = sorted({int(c) for c in cuts})

    def __len__(self) -> int:
        return len(self.cuts) + 1

    def index(self, key: Column) -> Column:
        """Number of cuts below the key: range i holds cut[i-1] < key <= cut[i]; null: 0.

        Two levels of short arrays, so that a look-up costs the square root of the ranges.
        """
        if not self.cuts:
            return F.lit(0)
        width = max(1, int(len(self.cuts) ** 0.5))
        groups = [self.cuts[i : i + width] for i in range(0, len(self.cuts), width)]
        below = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda c: c < key))
        rest = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), below)
        inside = F.coalesce(F.size(F.filter(rest, lambda c: c < key)), F.lit(0))
        found = F.least(below * width + F.greatest(inside, F.lit(0)), F.lit(len(self.cuts)))
        return F.when(key.isNull(), 0).otherwise(found).cast("int")

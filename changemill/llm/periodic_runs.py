"""Periodic runs of words: stretches that repeat one block three times or more.

Dictionary of basic factors: every stretch of 1, 2, 4, 8 ... words has a name, equal stretches of one text
the same, and a name of the next length is a pair of names. At each length a stretch's successor (the next
place of its name) within that length proposes its distance as a period: a run's places with their successors
form an arithmetic progression, and neighbouring ones propose the same run, so only the first counts. A proposal
is extended to both sides by the names, longest first, until a neighbouring word breaks the period.

A run of least period q has length 3q at least, so it holds a stretch of q to 2q words again q words later,
and nothing nearer (two shorter periods of a stretch that long would leave a shorter period of all). So every run is
proposed, by its least period.

Texts of a slice of a batch are named together (a name has its text in it), and stretches that occur once
drop out at once, so the work is that of the words and not of the texts. A text of n words takes about n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import slices, whole, words

FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,kept:array<string>>"


def factors(codes: np.ndarray) -> list[np.ndarray]:
    """Names of all places by level: those of 2**level words; -1 where a stretch occurs once or reaches
    over the end. One place more than there are words ends each array."""
    n = len(codes)
    levels, places, pairs = [], np.arange(n), codes
    while True:
        names = pd.factorize(pairs)[0]
        again = np.bincount(names)[names] > 1 if len(names) else np.zeros(0, bool)
        places = places[again]
        if not len(places):
            return levels
        level = np.full(n + 1, -1, np.int32)
        level[places] = names[again]
        levels.append(level)
        ahead = places + (1 << (len(levels) - 1))
        places = places[(ahead < n) & (level[np.minimum(ahead, n)] >= 0)]
        pairs = level[places].astype(np.int64) << 32 | level[places + (1 << (len(levels) - 1))]


def _proposals(level: np.ndarray, above: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances to the successor, where it is over ``above`` and at most ``upto`` away; of
    neighbouring places with one distance the first."""
    places = np.flatnonzero(level >= 0)
    order = np.argsort(level[places], kind="stable")
    names, places = level[places][order], places[order]
    away = places[1:] - places[:-1]
    near = (names[1:] == names[:-1]) & (away > above) & (away <= upto)
    places, away = places[:-1][near], away[near]
    order = np.argsort(places)
    places, away = places[order], away[order]
    first = np.ones(len(places), bool)
    first[1:] = (places[1:] != places[:-1] + 1) | (away[1:] != away[:-1])
    return places[first], away[first]


def _extended(levels: list[np.ndarray], at: np.ndarray, away: np.ndarray, step: int) -> np.ndarray:
    """Places moved right (step 1) or left (-1) as long as the words there and ``away`` further agree.
    Equal stretches of the longest level plus one more would have a level of their own, so each level moves once."""
    n = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        level, reach = levels[k], 1 << k
        here = at if step > 0 else at - reach
        there = np.minimum(here + away, n)
        names = level[np.clip(here, 0, n)]
        same = (here >= 0) & (names >= 0) & (names == level[there])
        at = np.where(same, at + step * reach, at)
    return at


def runs(codes: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every maximal run of at least ``least`` words and ``times`` periods,
    by start, then period. Equal codes are equal words; codes of different texts differ."""
    levels = factors(codes)
    lowest = max(0, (2 * least // 3).bit_length() - 1)
    found = [np.empty((0, 3), np.int64)]
    for k in range(lowest, len(levels)):
        at, away = _proposals(levels[k], 0 if k == lowest else 1 << (k - 1), 1 << k)
        start = _extended(levels, at, away, -1)
        length = _extended(levels, at + (1 << k), away, 1) + away - start
        found.append(np.stack([start, length, away], axis=1))
    all_found = np.concatenate(found)
    long = all_found[all_found[:, 1] >= np.maximum(least, times * all_found[:, 2])]
    once = np.unique(long[:, [0, 2, 1]], axis=0)
    return once[:, 0], once[:, 2], once[:, 1]


def _of_slice(rows: pa.ListArray, least: int, times: int) -> pa.StructArray:
    flat = rows.flatten()
    ends = rows.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    text = np.repeat(np.arange(len(rows)), np.diff(ends))
    word = flat.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    start, length, period = runs(text << 32 | word, least, times)
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    of = np.searchsorted(ends, start, side="right") - 1
    run_ends = np.searchsorted(start, ends)  # runs are by start, so by text
    kept_ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    columns = [pa.array(start - ends[of]), pa.array(length), pa.array(period)]
    found = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
    as_list = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
    kept = as_list(kept_ends, flat.filter(pa.array(keep)))
    return pa.StructArray.from_arrays([as_list(run_ends, found), kept], ["runs", "kept"])


def find_runs(
    df: DataFrame, text: str = "text", out: str = "periodic", least: int = 24, times: int = 3, of_words: Column | None = None
) -> DataFrame:
    """``df`` with the periodic runs of its whole texts in column ``out``, which replaces a column of that name in
    any letter case.

    ``out`` is a struct: ``runs`` (start word from 0, length and least period in words, by start, then period)
    and ``kept``, the words that no run holds after its first period. Words are runs of characters other than
    blank and 0x09-0x0D; ``of_words`` gives an array of them instead. A null or empty text has no run and no word;
    repeated rows keep their own; a text may be of any length; other columns stay; an empty table gives an empty one.
    """
    if times < 3 or least < 3:
        raise ValueError("a run needs three words and three periods at least")

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_of_slice(part, least, times) for part in slices(batch)]
            yield pa.concat_arrays(parts or [_of_slice(batch, least, times)])

    given = words(whole(text)) if of_words is None else F.coalesce(of_words, F.array().cast("array<string>"))
    return df.withColumn(out, run(given))


def longest_repeat(runs_: Column) -> Column:
    """The run of the greatest exact length by period; of equals the one of least start, then period; null for none."""
    more = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    first = F.get(runs_, F.lit(0))
    return F.aggregate(runs_, first, lambda best, r: F.when(more(best, r), r).otherwise(best))


def as_text(runs_: Column) -> Column:
    """Runs as ``start,length,period`` and a line feed each."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    return F.array_join(F.transform(runs_, lambda r: F.concat(line(r), F.lit("\n"))), "")

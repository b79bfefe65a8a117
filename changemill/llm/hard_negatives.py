"""Hard negatives of anchors: for each positive, the best rows of other labels in a window below its score.

Slot-decomposed selection. An anchor's positives (its best rows of the same label) each open a window of scores with
an upper and a lower limit. The distinct upper limits cut the scores into disjoint slots; every row falls into one at
most, and a combiner keeps the best few of each slot. The best of a window are then the best of its own slot and
all slots below, so one descending merge over the slots answers every window of the anchor, however they overlap.

Both searches, of positives and of negatives, hold every anchor against every row, in blocks: rows are dealt into
columns and anchors into lines of a grid, each row goes to all lines of its column and each anchor to all columns of
its line. A cell has a bounded number of both and scores them by one matrix product; what leaves it is a
few rows an anchor. No side is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemill.session import cut_lineage

#: Most rows and anchors of a cell (on average), and the fewest rows that make a column of their own.
MOST_ROWS, MOST_ANCHORS, LEAST_ROWS = 65_536, 16_384, 1024
#: Rows and anchors that are scored at once inside a cell.
_ROWS, _ANCHORS = 4096, 512
_NONE = -(1 << 62)


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows with a key, a label and a vector of finite numbers."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~broken)


# ---- A cell ----


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of integers, short ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class _Cell:
    """Anchors and rows of a cell, rows by label and key."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        vectors = table["vector"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("vector").type)
        width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
        key, label = table["key"].to_numpy(), table["label"].to_numpy()
        anchor = table["anchor"].to_numpy().astype(bool)
        data = _matrix(vectors, width)
        a, r = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        r = r[np.lexsort((key[r], label[r]))]
        self.limits = table["limits"].take(pa.array(a)).to_pylist() if "limits" in table.column_names else None
        self.a_key, self.a_label, a_data = key[a], label[a], data[a]
        self.key, self.label, r_data = key[r], label[r], data[r]
        # A product of floats is exact as long as no sum can leave their integers.
        greatest = lambda m: int(max(-int(m.min(initial=0)), int(m.max(initial=0))))
        bound = greatest(a_data) * greatest(r_data) * max(1, width)
        if bound >= 1 << 62:
            raise ValueError("a score is beyond a long")
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        self.a_data, self.data = a_data.astype(kind), r_data.astype(kind)

    def scores(self, anchors: np.ndarray | slice, rows: slice) -> np.ndarray:
        return self.a_data[anchors] @ self.data[rows].T


def _best(scores: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best of each line by score, then key."""
    order = np.lexsort((keys, -scores), axis=1)[:, :most]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)


class _Kept:
    """Best ``most`` rows of each line of a table, by score, then key, as rows come in by key."""

    def __init__(self, lines: int, most: int):
        self.scores = np.full((lines, most), _NONE, np.int64)
        self.keys = np.zeros((lines, most), np.int64)
        self.most = most

    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, line: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        """Any number of rows a line."""
        order = np.lexsort((key, -score, line))
        line, score, key = line[order], score[order], key[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        place = np.arange(len(line)) - np.repeat(first, np.diff(first, append=len(line)))
        fits = place < self.most
        line, score, key, place = line[fits], score[fits], key[fits], place[fits]
        lines = np.unique(line)
        at = np.searchsorted(lines, line)
        new_scores = np.full((len(lines), self.most), _NONE, np.int64)
        new_keys = np.zeros((len(lines), self.most), np.int64)
        new_scores[at, place], new_keys[at, place] = score, key
        both = np.hstack([self.scores[lines], new_scores]), np.hstack([self.keys[lines], new_keys])
        self.scores[lines], self.keys[lines] = _best(*both, self.most)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line, place = np.nonzero(self.scores != _NONE)
        return line, self.scores[line, place], self.keys[line, place]


def _blocks(n: int, step: int) -> list[slice]:
    return [slice(at, min(n, at + step)) for at in range(0, n, step)]


def _positives(cell: _Cell, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept = _Kept(len(cell.a_key), most)
    for label in np.unique(cell.a_label):
        anchors = np.flatnonzero(cell.a_label == label)
        begin, end = np.searchsorted(cell.label, label), np.searchsorted(cell.label, label, side="right")
        for some in _blocks(len(anchors), _ANCHORS):
            lines = anchors[some]
            for rows in _blocks(end - begin, _ROWS):
                rows = slice(begin + rows.start, begin + rows.stop)
                scores = cell.scores(lines, rows)
                better = scores > kept.last()[lines][:, None]  # later rows have greater keys, so equal ones stay behind
                better &= cell.key[rows][None, :] != cell.a_key[lines][:, None]
                a, r = np.nonzero(better)
                kept.add(lines[a], scores[a, r].astype(np.int64), cell.key[rows][r])
    return kept.rows()


def _negatives(cell: _Cell, most: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, slot (its upper limit), score and key of the best rows of each slot."""
    slots = [_slots(scores or [], low, high) for scores in cell.limits]
    wide = max(map(len, slots), default=0)
    upper = np.full((len(slots), wide), _NONE, np.int64)
    lower = np.full((len(slots), wide), 1 << 61, np.int64)
    for i, found in enumerate(slots):
        for j, (top, bottom) in enumerate(found):
            upper[i, j], lower[i, j] = top, bottom
    order = np.argsort(cell.key, kind="stable")  # here rows come by key alone
    cell.key, cell.label, cell.data = cell.key[order], cell.label[order], cell.data[order]
    kept = [_Kept(len(slots), most) for _ in range(wide)]
    for some in _blocks(len(slots), _ANCHORS):
        for rows in _blocks(len(cell.key), _ROWS):
            scores = cell.scores(some, rows)
            other = cell.a_label[some][:, None] != cell.label[rows][None, :]
            for j in range(wide):
                least = np.maximum(lower[some, j], kept[j].last()[some] + 1)
                a, r = np.nonzero((scores >= least[:, None]) & (scores <= upper[some, j][:, None]) & other)
                kept[j].add(a + some.start, scores[a, r].astype(np.int64), cell.key[rows][r])
    found = [(j, *kept[j].rows()) for j in range(wide)]
    if not found:
        return (np.empty(0, np.int64),) * 4
    line = np.concatenate([f[1] for f in found])
    slot = np.concatenate([upper[f[1], f[0]] for f in found])
    return line, slot, np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])


def _slots(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Slots of an anchor's windows from the top: upper limit, and the least score that a window can use there.

    A slot ends above the next upper limit, or at the least lower limit of the windows that reach into it.
    """
    windows = sorted({(s * high // 100, -(-s * low // 100)) for s in scores}, reverse=True)
    windows = [w for w in windows if w[0] >= w[1]]
    out: list[tuple[int, int]] = []
    lowest = 1 << 61
    for i, (top, bottom) in enumerate(windows):
        lowest = min(lowest, bottom)
        below = windows[i + 1][0] if i + 1 < len(windows) else _NONE
        if below < top:
            out.append((top, max(lowest, below + 1)))
    return out


# ---- The grid ----


def _in_cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors, each in all its cells."""
    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    columns = max(-(-n_rows // MOST_ROWS), min(spread, -(-n_rows // LEAST_ROWS)), 1)
    lines = max(1, -(-n_anchors // MOST_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one_of = lambda n: F.pmod(F.xxhash64(F.lit(n), "key"), F.lit(n)).cast("int")
    rows = rows.select("*", every(lines).alias("line"), one_of(columns).alias("column"), F.lit(0).alias("anchor"))
    anchors = anchors.select("*", one_of(lines).alias("line"), every(columns).alias("column"), F.lit(1).alias("anchor"))
    return rows.unionByName(anchors, allowMissingColumns=True)


def _first(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best rows of each group; every task sends its best alone."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def mine(
    df: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "vector",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """Negatives of every anchor's positives: anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    ``vector`` has integers; a score is the integer product of two, higher ones come first, ties by the lesser key. An
    anchor's positives are its first other rows of its label, a positive's negatives the first rows of other
    labels whose score is ``low`` to ``high`` percent of the positive's (none below a score of 0). Fewer rows than asked for:
    all there are. Rows without key, label, vector, or with a null or non-finite component take no part; of rows with
    one key the least by label and vector counts; a shorter vector has zeros in the missing places; other columns are not read,
    and an empty table has no result. Components so great that a score could reach 2**62 are an error.
    """
    rows = usable(df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"),
                            F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "key", "vector", "label")
    rows = rows.withColumn("vector", F.col("vector").cast("array<bigint>"))
    rows = rows.groupBy("key").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("r")).select("key", "r.*")
    rows = cut_lineage(rows)
    size = rows.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors")).first()

    def first_cells(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        line, score, found = _positives(cell, positives)
        return pa.table({"anchor_id": cell.a_key[line], "score": score, "found": found})

    def second_cells(table: pa.Table) -> pa.Table:
        cell = _Cell(table)
        line, slot, score, found = _negatives(cell, negatives, low, high)
        return pa.table({"anchor_id": cell.a_key[line], "slot": slot, "score": score, "found": found})

    anchors = rows.where("is_anchor")
    cells = _in_cells(rows, anchors, size.rows, size.anchors).groupBy("line", "column")
    best = cells.applyInArrow(first_cells, "anchor_id long, score long, found long")
    best = cut_lineage(_first(best, ["anchor_id"], positives))

    limits = best.groupBy(F.col("anchor_id").alias("key")).agg(F.collect_list("score").alias("limits"))
    cells = _in_cells(rows, anchors.join(limits, "key"), size.rows, size.anchors).groupBy("line", "column")
    slots = cells.applyInArrow(second_cells, "anchor_id long, slot long, score long, found long")
    slots = _first(slots, ["anchor_id", "slot"], negatives)

    # Slots are disjoint, so their rows from the top slot down are in order; a window's are those from its own slot on.
    merged = slots.groupBy("anchor_id").agg(F.collect_list(F.struct((-F.col("score")).alias("order"), "found", "score", "slot")).alias("merged"))
    merged = merged.withColumn("merged", F.array_sort("merged"))
    upper = F.expr(f"score * {high} div 100")
    in_window = lambda c: (c["slot"] <= upper) & (100 * c["score"] >= low * F.col("score"))
    chosen = F.slice(F.filter("merged", in_window), 1, negatives)
    out = best.where("score >= 0").join(merged, "anchor_id")
    out = out.select("anchor_id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(chosen).alias("at", "negative"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.found").alias("negative_id"),
        "positive_score", F.col("negative.score").alias("negative_score"),
    )

"""Removal of lines that many documents share, against levelled sorted runs of line hashes.

Documents come in batches of descending key. A batch's lines are summed up as one row a line hash:
how many documents of the batch hold the line, and the largest key among them. The summary is
merge-anti-joined with the runs so far: a hash that they already count in enough documents needs
nothing more, since its largest key is known as well; the rest is added as a run of its own, sorted
by hash. Whenever a level has ``FANOUT`` runs, they are merged into one run of the next level, so
there are few runs and a row is rewritten once a level. At the end the merged runs name the lines
to drop, and the line that stays.

Runs are Parquet files in the shared folder, so an executor that is lost takes nothing with it.
Everything is built-in expressions; no line's documents are ever gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.llm.common import WHITE, KeyRanges, ascii_lower, fresh, key128, let, whole
from changemill.session import run_dir

MIN_CHARS, MIN_DOCS = 40, 5
FANOUT = 4
BATCHES = 4
_HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without blanks and 0x09-0x0D at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class Runs:
    """Levelled sorted runs of (h1, h2, n, last): documents that hold a line, largest key."""

    def __init__(self, spark, folder: str, min_docs: int):
        self.spark, self.folder, self.min_docs = spark, folder, min_docs
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.folder}/run-{self.written}"
        self.written += 1
        rows.repartition(*_HASH).sortWithinPartitions(*_HASH).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def merged(self, paths: list[str] | None = None) -> DataFrame | None:
        """One row a hash over the given runs, all by default; None without any."""
        paths = [p for level in self.levels for p in level] if paths is None else paths
        if not paths:
            return None
        runs = reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths])
        return runs.groupBy(*_HASH).agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def add(self, summary: DataFrame) -> None:
        """Anti-join a batch's summary with the settled hashes and keep the rest as a run."""
        known = self.merged()
        if known is not None:
            summary = summary.join(known.where(F.col("n") >= self.min_docs).select(*_HASH), _HASH, "left_anti")
        self._write(summary, 0)
        level = 0
        while len(self.levels[level]) >= FANOUT:
            full, self.levels[level] = self.levels[level], []
            self._write(self.merged(full), level + 1)
            level += 1


def _long_lines(rows: DataFrame, body: str, min_chars: int, *keep: str) -> DataFrame:
    """A row for each line of at least ``min_chars`` in its key: ``keep``, place, hashes."""
    found = F.transform(F.split(body, "\n", -1), lambda line, i: F.struct(i.alias("at"), line_key(line).alias("key")))
    found = F.filter(found, lambda x: F.length(x["key"]) >= min_chars)
    lines = rows.select(*keep, F.explode(found).alias("line"))
    h1, h2 = key128(F.col("line.key"))
    return lines.select(*keep, F.col("line.at").alias("at"), h1.alias("h1"), h2.alias("h2"))


def _summary(rows: DataFrame, min_chars: int, repeated: bool) -> DataFrame:
    keys = F.transform(F.split("body", "\n", -1), line_key)
    keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    lines = rows.select("id", F.explode(keys).alias("key"))
    h1, h2 = key128(F.col("key"))
    lines = lines.select("id", h1.alias("h1"), h2.alias("h2"))
    if repeated:
        lines = lines.distinct()
    return lines.groupBy(*_HASH).agg(F.count("*").alias("n"), F.max("id").alias("last"))


def dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
) -> DataFrame:
    """``df`` with the shared lines gone from its texts, and n_lines (before), n_dropped.

    A line of at least ``min_chars`` in its key that at least ``min_docs`` documents hold goes from
    all of them but the one of the largest key, where all its lines stay. Rows of one key
    are one document, rows without a key are one that comes before all others. A null or empty text
    is one empty line. Repeated rows stay, as do other columns; n_lines and n_dropped replace
    columns of those names. An empty table gives an empty one.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), whole(text).alias("body"))
    rows = docs.count()
    repeated = not docs.groupBy("id").count().where("count > 1").isEmpty()
    ranges = KeyRanges(docs, "id", max(1, -(-rows // batches)))
    runs = Runs(spark, run_dir(spark, "line-runs"), min_docs)
    edges = [None, *ranges.cuts, None]
    for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        inside = F.lit(True) if low is None else F.col("id") > low
        inside = inside if high is None else inside & (F.col("id") <= high)
        if low is None:  # the last batch also takes the rows without a key
            inside = inside | F.col("id").isNull()
        runs.add(_summary(docs.where(inside), min_chars, repeated))
    shared = runs.merged().where(F.col("n") >= min_docs).select("h1", "h2", "last")
    # The row's key and text together: rows of one key may differ in their lines.
    lines = _long_lines(docs.withColumn("th", F.xxhash64("body")), "body", min_chars, "id", "th")
    drops = lines.join(shared, _HASH).where(~F.col("id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("id", "th").agg(F.collect_set("at").alias("drops"))
    id_, th, found = (fresh(df, c) for c in ("drop_id", "drop_th", "drops"))
    drops = drops.select(F.col("id").alias(id_), F.col("th").alias(th), F.col("drops").alias(found))
    same = F.col(key).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(whole(text)) == F.col(th))
    none = F.array().cast("array<int>")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(found), none))
        return F.struct(
            F.size(lines).cast("long").alias("n"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text")
        )

    result = fresh(df, "kept_lines")
    out = df.join(drops, same, "left").withColumn(result, let(F.split(whole(text), "\n", -1), kept))
    out = out.withColumns({
        text: F.when(F.col(found).isNull(), F.col(text)).otherwise(F.col(result)["text"]),
        "n_lines": F.col(result)["n"],
        "n_dropped": F.coalesce(F.size(F.col(found)), F.lit(0)).cast("long"),
    })
    return out.drop(id_, th, found, result)

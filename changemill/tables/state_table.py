"""Current state of change feeds, kept as ordinary parquet tables of the Spark catalog.

``<name>_changes``  one partition per micro-batch: the batch folded to one row per key, plus one
                    row per truncated table. Writing a batch overwrites its own partition, so a
                    replay changes nothing and no batch is applied twice.
``<name>_base_<n>`` everything up to a batch, folded; bucketed by key, so joins on the key find
                    it already partitioned.
``<name>_versions`` one row per compaction: the base, the batch it reaches, and its schema epoch: the offset up to
                    which DDL operations are folded into its rows.

Rows compare by ``order``. By offset (the default) a truncate wipes the earlier rows of its own partition. By
source position it wipes those of its table, once every partition has come to its position; till then it is
pending. Truncates are kept until one after them is released; the base also holds the last position of each
partition, as rows of operation ``p``, since the rows that had it may be gone.

Applying a batch costs the batch, not the state. Reading folds the changes since the base and
anti-joins their keys from the base; nothing is cached, so a replayed batch is never read from files it has replaced. Where a table format with MERGE is configured,
``merge_into`` writes straight into it instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.operators.barriers import barrier_floor, position_vector, with_release
from changemill.operators.fold import LIVE_OPS, latest_per_key, latest_with_image
from changemill.operators.truncates import commit_positions
from changemill.session import delete_folder

#: Rows of a state that are not rows of its table: truncates and positions of partitions.
MARKS = ("t", "p")


class StateTable:
    def __init__(
        self,
        spark: SparkSession,
        name: str,
        keys: Sequence[str],
        location: str | None = None,
        table: str = "topic",
        order: str = "off",
        op: str = "op",
        buckets: int = 200,
        keep_images: bool = False,
        partitions: int | None = None,
    ):
        if table not in keys:
            raise ValueError(f"the keys of a state table include its table column {table!r}")
        self.spark, self.name, self.keys = spark, name, list(keys)
        self.location, self.buckets = location, buckets
        self.table, self.order, self.op = table, order, op
        self.keep_images = keep_images  # deleted rows keep the values of their last live change
        self.partitions = partitions  # of a topic; None takes those seen so far for all
        self.by_position = order != "off"

    # -- writing ---------------------------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Fold a micro-batch and write it as its own partition; False if it is in the base already."""
        if self.covers(batch_id):
            return False
        folded, changes = self._with_markers(batch), f"{self.name}_changes"
        if not self.spark.catalog.tableExists(changes):
            shape = folded.limit(0).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            self._writer(shape, "changes").partitionBy("batch_id").saveAsTable(changes)
        self._add_columns(changes, folded)
        columns = [f for f in self.spark.table(changes).schema.fields if f.name != "batch_id"]
        aligned = folded.select(
            *[
                F.col(f.name) if f.name in folded.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in columns
            ]
        )
        # A streaming batch belongs to its query's own session, where its name can be resolved.
        batch.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {changes} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{rows}}", rows=aligned
        )
        return True

    def compact(
        self,
        purge_deletes_before: int | None = None,
        evolve: Callable[[DataFrame | None], DataFrame] | None = None,
        epoch: int | None = None,
        marks: DataFrame | None = None,
    ) -> None:
        """Write a new base from the current one and all changes, then drop what it covers.

        Delete markers stay so that a replay cannot bring a row back; those below
        ``purge_deletes_before`` (older than the feed's retention) are left out. ``evolve`` rewrites the rows (None
        of a state without any), for one to the schema of ``epoch``; ``marks`` are truncates that the base then has too.
        """
        batches = self._batches()
        if not batches and evolve is None:
            return
        through, version = max([*batches, self._reach()]), self._version() + 1
        is_new = not batches and version == 1
        folded = None if is_new else self._folded()
        rows = folded if evolve is None else evolve(folded)
        for more in (None if is_new else self._lasting_marks(), marks):
            rows = rows if more is None else rows.unionByName(more, allowMissingColumns=True)
        if purge_deletes_before is not None:
            rows = rows.where((F.col(self.op) != "d") | (F.col("off") >= purge_deletes_before))
        base = f"{self.name}_base_{version}"
        # The same hash decides shuffle partition and bucket: one file per bucket.
        rows = rows.repartition(self.buckets, *self.keys)
        writer = self._writer(rows, f"base_{version}").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.mode("overwrite").saveAsTable(base)
        pointer = self.spark.range(1).select(
            F.lit(version).cast("bigint").alias("version"), F.lit(through).cast("bigint").alias("through_batch"),
            F.lit(max(self.epoch(), -1 if epoch is None else epoch)).cast("bigint").alias("epoch"),
        )
        self._writer(pointer, "versions").mode("append").saveAsTable(f"{self.name}_versions")
        covered = ", ".join(f"PARTITION (batch_id = {b})" for b in batches)
        if batches:
            self.spark.sql(f"ALTER TABLE {self.name}_changes DROP IF EXISTS {covered}")
            self._delete(*[f"changes/batch_id={b}" for b in batches])
        if version > 1:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_base_{version - 2}")
            self._delete(f"base_{version - 2}")

    def maybe_compact(self, max_batches: int) -> bool:
        """Compact once so many batches lie on top of the base, which bounds what a read folds."""
        due = len(self._batches()) >= max_batches
        if due:
            self.compact()
        return due

    def covers(self, batch_id: int) -> bool:
        """Whether a batch is part of the base already; its replay has nothing left to do."""
        return batch_id <= self._reach()

    def resync(self, reads: DataFrame | None, topic: str, position: int) -> None:
        """Replace what a topic had up to a position by the rows of its table as they were read there.

        A new base has the reads, the changes behind the position, and truncates in front of it, so nothing older
        comes back, whatever is replayed. The pointer moves last: a run that broke off is done again with the same
        outcome. Without ``reads`` the topic is empty.
        """
        order = self.order

        def replaced(rows: DataFrame | None) -> DataFrame:
            here = reads if reads is not None else rows.where(F.lit(False))
            for name, value in {self.table: F.lit(topic), "part": F.lit(0), "off": F.lit(position), order: F.lit(position), self.op: F.lit("r")}.items():
                kind = rows.schema[name].dataType if rows is not None else {"part": "int", "off": "bigint", order: "bigint"}.get(name, "string")
                here = here.withColumn(name, value.cast(kind))
            if rows is None:
                return here
            behind = rows.where((F.col(self.table) != topic) | (F.col(order) > position))
            return behind.unionByName(here.join(behind.select(*self.keys), self.keys, "left_anti"), allowMissingColumns=True)

        has_rows = self._version() > 0 or bool(self._batches())
        if reads is None and not has_rows:
            return
        parts = self.spark.range(1).select(F.lit(0).alias("part"))
        if has_rows:
            parts = parts.union(self._all().where(F.col(self.table) == topic).select("part")).distinct()
        at = {self.table: F.lit(topic), "off": F.lit(position - 1).cast("bigint"), order: F.lit(position - 1).cast("bigint"), self.op: F.lit("t")}
        self.compact(evolve=replaced, marks=parts.withColumns(at))

    def drop(self) -> None:
        for version in range(self._version() + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_base_{version}")
            self._delete(f"base_{version}")
        for part in ("changes", "versions"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")
            self._delete(part)

    # -- reading ---------------------------------------------------------------------------
    def current(self, before_batch: int | None = None) -> DataFrame:
        """Live rows: deleted and truncated ones are gone. ``before_batch`` reads the state that
        a batch found, also when the batch is replayed."""
        return self._folded(before_batch).where(F.col(self.op).isin(*LIVE_OPS))

    def with_deletes(self) -> DataFrame:
        """Live rows and delete markers; a marker holds the image that the delete carried."""
        return self._folded()

    def soft_deleted(self) -> DataFrame:
        """Live rows and deleted rows, the latter with ``__deleted = true``."""
        return self._folded().withColumn("__deleted", F.col(self.op) == "d")

    def has_rows_before(self, batch_id: int) -> bool:
        return self._version() > 0 or any(b < batch_id for b in self._batches())

    def positions(self) -> DataFrame:
        """Greatest applied offset or position per table."""
        return self.vector().groupBy(self.table).agg(F.max(self.order).alias(self.order))

    def vector(self, before_batch: int | None = None) -> DataFrame:
        """Last applied offset or position of each partition of each table."""
        return position_vector(self._all(before_batch), self.table, "part", self.order)

    def pending(self) -> DataFrame:
        """Truncates that have not taken effect: (table, part, off, order column)."""
        columns = list(dict.fromkeys([self.table, "part", "off", self.order]))
        return self._truncates().where("NOT released").select(*columns)

    def commit_positions(self) -> DataFrame:
        """Offset to commit for each partition: the next one to read, but never past a pending truncate."""
        table = F.col(self.table).alias("topic")
        reached = self._all().groupBy(table, "part").agg((F.max("off") + 1).alias("position"))
        return commit_positions(reached, self.pending().select(table, "part", "off"))

    def next_batch(self) -> int:
        """First free batch number: where a new stream over the same state starts counting."""
        return max([self._reach(), *self._batches()]) + 1

    # -- parts -----------------------------------------------------------------------------
    def _writer(self, df: DataFrame, part: str):
        writer = df.write.format("parquet")
        return writer.option("path", f"{self.location}/{self.name}_{part}") if self.location else writer

    def _delete(self, *parts: str) -> None:
        """Files of dropped tables: those at a location of their own are not deleted with the table."""
        for part in parts if self.location else ():
            delete_folder(self.spark, f"{self.location}/{self.name}_{part}")

    def _with_markers(self, batch: DataFrame) -> DataFrame:
        """The batch folded in one pass: marks have no key and are kept each, as rows of a null key."""
        if "part" not in batch.columns:
            batch = batch.withColumn("part", F.lit(0))
        if self.order not in batch.columns:
            raise ValueError(f"the rows have no column {self.order}")
        keyless = {
            key: F.when(~F.col(self.op).isin(*MARKS), F.col(key)) for key in self.keys if key != self.table
        }
        mark = F.when(F.col(self.op).isin(*MARKS), F.struct(self.op, "part", "off"))
        return self._latest(batch.withColumns({**keyless, "_mark": mark}), [*self.keys, "_mark"]).drop("_mark")

    def standing(self, topics: DataFrame, position: int) -> DataFrame:
        """Marks that every partition of the topics has come to a position, to be applied with a batch."""
        parts = topics.select(self.table, "part")
        if self.partitions is not None:
            parts = topics.select(self.table).distinct().select(self.table, F.explode(F.sequence(F.lit(0), F.lit(self.partitions - 1))).alias("part"))
        mark = {"off": F.lit(None).cast("bigint"), self.order: F.lit(position).cast("bigint"), self.op: F.lit("p")}
        return parts.distinct().withColumns(mark)

    def _latest(self, rows: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
        if self.keep_images:
            return latest_with_image(rows, keys or self.keys, self.order, self.op)
        return latest_per_key(rows, keys or self.keys, self.order)

    def _add_columns(self, table: str, df: DataFrame) -> None:
        """Basic evolution: columns a batch brings in are added to the table as nullable."""
        known = self.spark.table(table).columns
        new = [f for f in df.schema.fields if f.name not in known]
        if new:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
            self.spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")

    def _pointer(self):
        versions = f"{self.name}_versions"
        if not self.spark.catalog.tableExists(versions):
            return None
        return self.spark.table(versions).agg(F.max("version"), F.max("through_batch"), F.max("epoch")).first()

    def epoch(self) -> int:
        """Offset up to which the base has taken in DDL operations; -1 for none."""
        pointer = self._pointer()
        return pointer[2] if pointer else -1

    def _version(self) -> int:
        pointer = self._pointer()
        return pointer[0] if pointer else 0

    def _reach(self) -> int:
        pointer = self._pointer()
        return pointer[1] if pointer else -1

    def _batches(self) -> list[int]:
        """Batch numbers since the base, from the catalog's partition list."""
        changes = f"{self.name}_changes"
        if not self.spark.catalog.tableExists(changes):
            return []
        return [int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {changes}").collect()]

    def _base(self) -> DataFrame | None:
        version = self._version()
        return self.spark.table(f"{self.name}_base_{version}") if version else None

    def _recent(self, before_batch: int | None = None) -> DataFrame | None:
        changes = f"{self.name}_changes"
        if not self.spark.catalog.tableExists(changes):
            return None
        self.spark.catalog.refreshTable(changes)
        rows = self.spark.table(changes).where(F.col("batch_id") > self._reach())
        return (rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)).drop("batch_id")

    def _all(self, before_batch: int | None = None) -> DataFrame:
        """Places and operations of all rows, marks included."""
        columns = list(dict.fromkeys([self.table, "part", "off", self.order, self.op]))
        parts = [df.select(*columns) for df in (self._base(), self._recent(before_batch)) if df is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _truncates(self, before_batch: int | None = None) -> DataFrame:
        """Truncates that the state knows, with ``released``."""
        rows = self._all(before_batch).where(F.col(self.op) == "t")
        if not self.by_position:
            return rows.withColumn("released", F.lit(True))
        floor = barrier_floor(self.vector(before_batch), self.table, self.order, self.partitions)
        return with_release(rows, floor, self.table, self.order)

    def _wiped(self, before_batch: int | None = None) -> DataFrame:
        """Order up to which a table, or a partition of it, is empty: (table, part or not, ``_t_off``)."""
        released = self._truncates(before_batch).where("released")
        return released.groupBy(*self._scope).agg(F.max(self.order).alias("_t_off"))

    @property
    def _scope(self) -> list[str]:
        return [self.table] if self.by_position else [self.table, "part"]

    def _lasting_marks(self) -> DataFrame:
        """Marks of a new base: the last released truncates, the pending ones, and the last positions."""
        columns = list(dict.fromkeys([self.table, "part", "off", self.order, self.op]))
        truncates = self._truncates().join(self._wiped(), self._scope, "left")
        lasting = truncates.where((~F.col("released")) | (F.col(self.order) == F.col("_t_off"))).select(*columns)
        last = self._all().groupBy(self.table, "part").agg(*[F.max(c).alias(c) for c in dict.fromkeys(["off", self.order])])
        return lasting.distinct().unionByName(last.withColumn(self.op, F.lit("p")).select(*columns))

    def _folded(self, before_batch: int | None = None) -> DataFrame:
        """One row per key: recent changes over the base, minus what truncates wiped out."""
        base, recent = self._base(), self._recent(before_batch)
        if base is None and recent is None:
            raise ValueError(f"state table {self.name} has no data yet")
        if recent is None:
            rows = base.where(~F.col(self.op).isin(*MARKS))
        else:
            rows = self._latest(recent.where(~F.col(self.op).isin(*MARKS)))
            if base is not None:
                rows = self._over_base(base, self._typed_like(base, rows))
        marks = self._wiped(before_batch)
        kept = rows.join(marks, self._scope, "left").where(
            F.col("_t_off").isNull() | (F.col(self.order) > F.col("_t_off"))
        )
        return kept.select(*rows.columns)

    def _typed_like(self, base: DataFrame, recent: DataFrame) -> DataFrame:
        """Recent rows with the types that the base has come to have."""
        types = {f.name: f.dataType for f in base.schema.fields}
        changed = {f.name for f in recent.schema.fields if f.name in types and types[f.name] != f.dataType}
        return recent.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in changed else F.col(f"`{c}`") for c in recent.columns])

    def _over_base(self, base: DataFrame, recent: DataFrame) -> DataFrame:
        """Latest of base and recent changes per key.

        Recent changes replace their base rows, except where a replay is older than the base:
        both sides are compared by order, one row per key on each side.
        """
        newer = recent.select(*self.keys, F.col(self.order).alias("_new"))
        older = base.where(~F.col(self.op).isin(*MARKS))
        kept = older.join(newer, self.keys, "left").where(
            F.col("_new").isNull() | (F.col("_new") < F.col(self.order))
        ).drop("_new")
        if self.keep_images:
            recent = self._with_base_images(older, recent)
        stale = older.join(newer, self.keys).where(F.col("_new") < F.col(self.order)).select(*self.keys)
        return kept.unionByName(recent.join(stale, self.keys, "left_anti"), allowMissingColumns=True)


    def _with_base_images(self, older: DataFrame, recent: DataFrame) -> DataFrame:
        """Deletes whose batches saw no values of the row take those of the base."""
        values = [c for c in recent.columns if c in older.columns and c not in (*self.keys, self.order, self.op, "part", "off")]
        if not values:
            return recent
        bare = F.col(self.op) == "d"
        for value in values:
            bare = bare & F.col(value).isNull()
        images = older.select(*self.keys, F.struct(*values).alias("_image"))
        filled = recent.join(images, self.keys, "left")
        return filled.select(*[
            F.when(bare, F.col(f"_image.`{c}`")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in recent.columns
        ])


def merge_into(changes: DataFrame, target: str, keys: Sequence[str], op: str = "op") -> None:
    """Folded changes into a table whose format supports MERGE."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"{target}.{key}") == F.col(f"source.{key}"))
    deleted = F.col(f"source.{op}") == "d"
    (
        changes.alias("source").mergeInto(target, condition)
        .whenMatched(deleted).delete()
        .whenMatched().updateAll()
        .whenNotMatched(~deleted).insertAll()
        .merge()
    )

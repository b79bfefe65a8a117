"""Continuous apply: a change stream folded into state tables, batch by batch.

A micro-batch is decoded, its bad rows refused or kept as dead letters, its rows limited to
enabled tables, and each table's rows folded into its state. The checkpoint makes sure that
every feed position reaches a batch; a state table overwrites the partition of a replayed
batch; together no change is lost or applied twice. A failing batch stops the query and is
replayed after a restart, which is also how a long outage of a target is waited out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from changemill.functions.envelope import dead_rows, decode_envelope, envelope_schema, good_rows, source_position
from changemill.functions.types import conform
from changemill.operators.evolve import evolve_in_chunks, evolve_rows
from changemill.operators.fold import LIVE_OPS, split_insert_mode, update_mode_changes
from changemill.operators.keys import duplicate_keys, orphan_counts
from changemill.operators.monitor import HEARTBEAT_TOPICS
from changemill.session import cut_lineage
from changemill.sources.feed import union_feeds, with_topic_parts
from changemill.spec import FREQUENCY_MINUTES, PipelineSpec, TableSpec
from changemill.streaming.queue import TruncateQueue
from changemill.tables.dead_letters import as_dead_letters, settle_rejects
from changemill.tables.state_table import StateTable


class MetadataUnavailable(RuntimeError):
    """Raised in a batch that cannot be decoded because its schema is missing: the batch is
    not committed and comes again after the restart."""


class Paused(RuntimeError):
    """Raised in front of a batch when the control table pauses a side of the pipeline."""


def trigger_options(frequency: str) -> dict[str, object]:
    """Trigger of each schedule: realtime runs on, manual drains what is there and ends."""
    if frequency == "realtime":
        return {"processingTime": "0 seconds"}
    if frequency == "manual":
        return {"availableNow": True}
    return {"processingTime": f"{FREQUENCY_MINUTES[frequency]} minutes"}


def start(
    feed: DataFrame,
    on_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    frequency: str = "manual",
    name: str | None = None,
) -> StreamingQuery:
    writer = feed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**trigger_options(frequency)).start()


def fold_into(state: StateTable, prepare: Callable[[DataFrame], DataFrame], first_batch: int = 0) -> Callable[[DataFrame, int], None]:
    """Batch function for one state table.

    ``first_batch`` shifts the batch numbers of a stream that starts over with a new checkpoint
    on an existing state; offsets that were applied before change nothing there.
    """
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state.apply(prepare(batch), first_batch + batch_id)

    return on_batch


class Pipeline:
    """All tables of one source as one stream."""

    def __init__(
        self,
        spark: SparkSession,
        spec: PipelineSpec,
        location: str,
        name: str = "pipeline",
        current_spec: Callable[[], PipelineSpec] | None = None,
        control: Callable[[], DataFrame] | None = None,
        buckets: int = 200,
        compact_every: int | None = None,
        tables_at_once: int = 4,
    ):
        self.spark, self.spec, self.location, self.name, self.buckets = spark, spec, location, name, buckets
        self._compact_every, self._tables_at_once = compact_every, tables_at_once
        self._current_spec = current_spec or (lambda: self.spec)
        self._control = control
        self.first_batch = 0

    def plan(self) -> list[str]:
        """Problems that keep the pipeline from starting; empty when it may run."""
        return self.spec.problems()

    def state(self, table: TableSpec) -> StateTable:
        return StateTable(
            self.spark, f"{self.name}_{table.target}", ["topic", *table.keys], self.location, buckets=self.buckets,
            keep_images=self.spec.delete_mode == "soft", order=self.order, partitions=self.spec.partitions,
        )

    @property
    def order(self) -> str:
        return "pos" if self.spec.ordering == "position" else "off"

    def rows_of(self, batch: DataFrame, table: TableSpec) -> DataFrame:
        """Decoded rows of one table of a batch, with ``_error`` for those that do not fit."""
        if not table.row.fields:
            raise MetadataUnavailable(f"no row schema for {table.source_schema}.{table.source_table}")
        mine = with_topic_parts(batch).where(
            (F.col("db_id") == self.spec.db_id)
            & (F.col("source_schema") == table.source_schema)
            & (F.col("source_table") == table.source_table)
        ).select(*batch.columns)
        decoded = decode_envelope(mine, table.row, table.keys, position=self.order == "pos")
        if not table.casts:
            return decoded
        cast = conform(decoded, table.casts)
        lost = F.when(F.col("_rejects").isNotNull(), F.concat(F.lit("cast:"), "_rejects"))
        return cast.withColumn("_error", F.coalesce("_error", lost)).drop("_rejects")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """Apply one batch to every table that is enabled now: the table list is read again in
        each batch, and an empty list keeps the last one. The control table is read too: a paused
        pipeline stops in front of the batch and takes it up again when it is run."""
        if self._control is not None and not may_run(self._control(), self.name):
            raise Paused(f"pipeline {self.name} is paused")
        latest = self._current_spec()
        if latest.enabled_tables:
            self.spec = latest
        # Kept while several tables take their rows from it.
        shared = len(self.spec.enabled_tables) > 1
        batch = batch.persist() if shared else batch
        number = self.first_batch + batch_id
        beat = self._heartbeat(batch) if self.spec.heartbeats_advance else None
        try:
            # The tables' jobs are independent; a few at a time keep a cluster busy.
            with ThreadPoolExecutor(self._tables_at_once) as pool:
                list(pool.map(lambda table: self._apply_table(batch, table, number, beat), self.spec.enabled_tables))
        finally:
            if shared:
                batch.unpersist()

    def _heartbeat(self, batch: DataFrame) -> int | None:
        """Last source position that a heartbeat of this pipeline's source brings, if one does."""
        mine = batch.where(F.col("topic").rlike(HEARTBEAT_TOPICS) & F.col("topic").contains(f".{self.spec.prefix}_"))
        position = F.from_json("value", envelope_schema(T.StructType(), position=True))
        found = mine.select(position.alias("v")).select(F.coalesce(source_position("v.source"), source_position("v.payload.source")).alias("at"))
        return found.agg(F.max("at")).first()[0]

    def _apply_table(self, batch: DataFrame, table: TableSpec, number: int, beat: int | None = None) -> None:
        state = self.state(table)
        if state.covers(number):
            return
        # Decoded once for the rejects and the rows that are applied.
        rows = self.rows_of(batch, table).persist()
        try:
            self._apply_rows(rows, table, state, number, beat)
        finally:
            rows.unpersist()

    def _apply_rows(self, rows: DataFrame, table: TableSpec, state: StateTable, number: int, beat: int | None = None) -> None:
        rejects = as_dead_letters(
            dead_rows(rows).select("topic", "part", "off", "_raw_key", "_raw_value", "_error"), "decode", F.col("_error"), batch_id=number
        )
        good = good_rows(rows)
        if self.spec.delete_mode == "ignore":
            good = good.where(F.col("op") != "d")
        if self.spec.insert_mode != "upsert":
            good, refused = self._limited(good, state, number)
            if refused is not None:
                rejects = rejects.unionByName(as_dead_letters(refused, "insert", F.col("reason"), batch_id=number))
        settle_rejects(rejects, self.spec.tolerance, f"{self.location}/dead_letters/{table.target}")
        if beat is not None:
            topics = good.select("topic", "part")
            if state.has_rows_before(number):
                topics = topics.unionByName(state.vector(number).select("topic", "part"))
            # Cut off from the state's table, whose partition they go to.
            good = good.unionByName(cut_lineage(state.standing(topics, beat)), allowMissingColumns=True)
        state.apply(good, number)
        if self._compact_every:
            state.maybe_compact(self._compact_every)

    def _limited(self, rows: DataFrame, state: StateTable, number: int) -> tuple[DataFrame, DataFrame | None]:
        """Insert mode refuses keys that exist, update mode ignores keys that do not. Both compare
        with the state that the batch found, and keep the outcome, so a replay decides alike."""
        keys = state.keys
        keyed = rows.where(F.col("op") != "t")
        rest = rows.where(~F.col("op").isin(*LIVE_OPS))
        found = state.current(number).select(*keys) if state.has_rows_before(number) else rows.limit(0).select(*keys)
        if self.spec.insert_mode == "update":
            live = update_mode_changes(keyed, keys, self.order)
            return cut_lineage(live.join(found, keys, "left_semi").unionByName(rest)), None
        accepted, refused = split_insert_mode(found, keyed, keys, self.order)
        return cut_lineage(accepted.unionByName(rest)), cut_lineage(refused)

    def target_rows(self, table: TableSpec, operations: DataFrame | Sequence[Row] = ()) -> DataFrame:
        """Rows of a target as its delete mode shows them, brought to the schema that the DDL
        ``operations`` of its topic lead to. Of a table of operations those after the state's schema epoch are
        read, whatever their number; a list is taken as it is."""
        state = self.state(table)
        rows = state.soft_deleted() if self.spec.delete_mode == "soft" else state.current()
        if isinstance(operations, DataFrame):
            later = self._operations_of(table, operations).where(F.col("off") > state.epoch())
            return evolve_in_chunks(rows, later, self._fixed(table), self.order)
        columns = {f.name: f.dataType.simpleString() for f in table.row.fields if f.name not in table.keys}
        return evolve_rows(rows, operations, columns, one_table=True) if operations else rows

    def fold_schema(self, table: TableSpec, operations: DataFrame) -> int:
        """Write a new base at the schema epoch that the data has come to; gives the epoch.

        Operations beyond what every partition has reached wait: rows in front of them may still come. From
        then on only later operations are read.
        """
        state = self.state(table)
        reached = state.vector().agg(F.min(state.order)).first()[0]
        before = state.epoch()
        due = self._operations_of(table, operations).where((F.col("off") > before) & (F.col("off") <= reached))
        epoch = due.agg(F.max("off")).first()[0]
        if epoch is None:
            return before
        state.compact(evolve=lambda rows: evolve_in_chunks(rows, due, self._fixed(table), self.order), epoch=epoch)
        return epoch

    def _fixed(self, table: TableSpec) -> list[str]:
        return ["topic", *table.keys, "part", "off", "pos", "op", "__deleted"]

    def _operations_of(self, table: TableSpec, operations: DataFrame) -> DataFrame:
        topics = operations.withColumnRenamed("tbl", "topic")
        return with_topic_parts(topics).where(
            (F.col("db_id") == self.spec.db_id)
            & (F.col("source_schema") == table.source_schema)
            & (F.col("source_table") == table.source_table)
        ).select(*topics.columns)

    # -- tables that leave and join ----------------------------------------------------------
    def remove_tables(self, names: set[str], action: str = "keep", allow_empty: bool = False) -> None:
        """Take tables out of the running pipeline; the next batch goes without them.

        ``keep`` leaves their state as it is, ``truncate`` empties it, ``drop`` removes it with its files. Where a
        state was is remembered, so that rows from before do not come back, not even by a replay.
        """
        if action not in ("keep", "truncate", "drop"):
            raise ValueError(f"unknown action {action!r}")
        changed = self.spec.without_tables(names, allow_empty)
        for table in self.spec.named(names):
            state = self.state(table)
            if action == "keep" or not state.next_batch():
                continue
            left = state.vector().groupBy("topic").agg(F.max(state.order).alias("position")).collect()  # a topic a table
            if action == "truncate":
                for row in left:
                    state.resync(None, row.topic, row.position + 1)
            else:
                note = self.spark.range(1).select(F.explode(F.array(*[
                    F.struct(F.lit(table.target).alias("target_table"), F.lit(r.topic).alias("topic"), F.lit(r.position).cast("bigint").alias("position"))
                    for r in left
                ])).alias("n")).select("n.*")
                note.write.format("parquet").option("path", f"{self.location}/{self._left}").mode("append").saveAsTable(self._left)
                state.drop()
        self.spec = changed

    def add_table(self, table: TableSpec, rows: DataFrame, topic: str, position: int) -> None:
        """Let a table join, or join again, with its rows as they were read at a position of its feed.

        The rows are the base of its state; changes up to the position, replayed ones too, are behind it.
        """
        self.spec = self.spec.with_table(table)
        known = self.spec.named({f"{table.source_schema}.{table.source_table}"})[0]
        before = -1
        if self.spark.catalog.tableExists(self._left):
            found = self.spark.table(self._left).where(F.col("target_table") == known.target).agg(F.max("position")).first()[0]
            before = -1 if found is None else found
        self.state(known).resync(rows, topic, max(position, before + 1))

    @property
    def _left(self) -> str:
        return f"{self.name}_left"

    # -- truncates while paused --------------------------------------------------------------
    @property
    def queue(self) -> TruncateQueue:
        return TruncateQueue(self.spark, self.name, self.location)

    def watch_truncates(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Queue the truncates that a paused pipeline's feed brings, to be carried out on resume."""
        def on_batch(batch: DataFrame, batch_id: int) -> None:
            found = [
                good_rows(self.rows_of(batch, table)).where(F.col("op") == "t").select("topic", "off") for table in self.spec.enabled_tables
            ]
            self.queue.enqueue(union_feeds(found), batch_id)

        return start(feed, on_batch, checkpoint, self.spec.frequency)

    def resume(self, read_table: Callable[[TableSpec], tuple[DataFrame, int]]) -> list[tuple[str, int, str]]:
        """Carry out the queued truncates, if both sides run: each table is read anew from its source.

        ``read_table`` gives a table's rows and the position at which they were read. A resync can be done twice, what
        fails stays queued, and nothing happens while a side is paused.
        """
        if self._control is not None and not may_run(self._control(), self.name):
            return []

        def carry_out(topic: str, off: int) -> bool:
            parts = with_topic_parts(self.spark.range(1).select(F.lit(topic).alias("topic"))).first()
            table = self.spec.named({f"{parts.source_schema}.{parts.source_table}"})[0]
            rows, position = read_table(table)
            if position < off:
                return False  # read before the truncate
            self.state(table).resync(rows, topic, position)
            return True

        return self.queue.drain(carry_out)

    def pending_truncates(self) -> DataFrame:
        """Truncates of the enabled tables that wait for a partition: (target_table, topic, part, off, ...)."""
        return union_feeds(
            [self.state(t).pending().select(F.lit(t.target).alias("target_table"), "*") for t in self.spec.enabled_tables]
        )

    def commit_positions(self) -> DataFrame:
        """Offsets that a consumer group may commit: (topic, part, commit_position), never past a pending truncate."""
        return union_feeds([self.state(t).commit_positions() for t in self.spec.enabled_tables])

    def constraint_violations(self) -> DataFrame:
        """Declared keys and references that the targets break: (target_table, kind, columns, n)."""
        found = []
        by_name = {t.target: t for t in self.spec.enabled_tables}
        for table in self.spec.enabled_tables:
            rows = self.state(table).current()
            checks = [("unique", c, duplicate_keys(rows, list(c))) for c in table.unique]
            checks += [
                ("reference", (column,), orphan_counts(rows, self.state(by_name[parent]).current(), {column: parent_column}))
                for column, parent, parent_column in table.foreign_keys
                if parent in by_name
            ]
            found += [
                df.agg(F.count("*").alias("n")).select(
                    F.lit(table.target).alias("target_table"), F.lit(kind).alias("kind"), F.lit(",".join(columns)).alias("columns"), "n"
                )
                for kind, columns, df in checks
            ]
        return union_feeds(found).where("n > 0")

    def run(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start, or take up again, the stream of a checkpoint.

        Each checkpoint counts its batches from zero, so the number its first batch has in the
        state is kept beside the state: a restart goes on counting where it was. A checkpoint
        that the state does not know would make new batches look old, and is refused.
        """
        problems = self.plan()
        if problems:
            raise ValueError("; ".join(problems))
        first = self._first_batch_of(checkpoint)
        if first is None:
            if self._next_batch():
                raise ValueError(f"the state of {self.name} was not written from {checkpoint}; use recover() to go on with a new checkpoint")
            first = self._remember(checkpoint, 0)
        self.first_batch = first
        return start(feed, self.on_batch, checkpoint, self.spec.frequency, self.name)

    def recover(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start over with a new checkpoint on the kept state, without reading snapshots; a
        checkpoint that was recovered to before is only taken up again."""
        if self._first_batch_of(checkpoint) is None:
            self._remember(checkpoint, self._next_batch())
        return self.run(feed, checkpoint)

    def _next_batch(self) -> int:
        return max([self.state(t).next_batch() for t in self.spec.enabled_tables], default=0)

    @property
    def _runs(self) -> str:
        return f"{self.name}_checkpoints"

    def _first_batch_of(self, checkpoint: str) -> int | None:
        if not self.spark.catalog.tableExists(self._runs):
            return None
        row = self.spark.table(self._runs).where(F.col("checkpoint") == checkpoint).agg(F.max("first_batch")).first()
        return row[0]

    def _remember(self, checkpoint: str, first: int) -> int:
        row = self.spark.range(1).select(F.lit(checkpoint).alias("checkpoint"), F.lit(first).cast("bigint").alias("first_batch"))
        row.write.format("parquet").option("path", f"{self.location}/{self._runs}").mode("append").saveAsTable(self._runs)
        return first


def may_run(control: DataFrame, pipeline: str) -> bool:
    """Whether both sides of a pipeline run; a paused one is stopped and resumes from its checkpoint."""
    row = control.where(F.col("pipeline") == pipeline).select("source_state", "sink_state").first()
    return row is not None and row.source_state == "RUNNING" and row.sink_state == "RUNNING"

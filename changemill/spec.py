"""What a pipeline is: its tables, keys, modes and checks before it starts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.session import lookup
from changemill.sources.snapshot import SNAPSHOT_MODES

# Modes, frequencies in minutes and default sizes.
SYNC_TYPES = ("full", "incremental", "realtime")
INSERT_MODES = ("upsert", "insert", "update")
DELETE_MODES = ("hard", "soft", "ignore")
ORDERINGS = ("offset", "position")
KEY_MODES = ("none", "kafka", "record_key", "record_value")
FREQUENCY_MINUTES = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "hourly": 60, "daily": 1440}
SINK_BATCH_ROWS = 3000
MISSING_KEYS_SHOWN = 10


@dataclass(frozen=True)
class TableSpec:
    """One captured table: where it comes from, where it goes, and its keys."""

    source_schema: str
    source_table: str
    row: T.StructType
    keys: tuple[str, ...] = ()
    target_table: str | None = None
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    casts: dict[str, str] = field(default_factory=dict)
    is_enabled: bool = True

    @property
    def target(self) -> str:
        return self.target_table or f"{self.source_schema}_{self.source_table}"


@dataclass(frozen=True)
class PipelineSpec:
    """A source with its tables and how they are applied."""

    client_id: int
    db_id: int
    system: str
    database: str
    tables: tuple[TableSpec, ...] = ()
    insert_mode: str = "upsert"
    key_mode: str = "record_key"
    delete_mode: str = "hard"
    snapshot_mode: str = "initial"
    sync_type: str = "realtime"
    frequency: str = "realtime"
    tolerance: str = "none"
    drop_before_sync: bool = False
    auto_execute_destructive: bool = False
    #: What changes compare by: the feed's offsets, or the source's log position, which truncates of a topic
    #: of several partitions need.
    ordering: str = "offset"
    #: Partitions of a topic; None takes those seen so far for all.
    partitions: int | None = None
    #: Whether a heartbeat advances every partition to its source position. Set it where a batch that has a
    #: heartbeat has every change before it, too: one reader of all topics, batches without a limit of rows.
    heartbeats_advance: bool = False

    @property
    def prefix(self) -> str:
        return f"client_{self.client_id}_db_{self.db_id}"

    @property
    def enabled_tables(self) -> tuple[TableSpec, ...]:
        return tuple(t for t in self.tables if t.is_enabled)

    def problems(self) -> list[str]:
        """Everything that keeps the pipeline from starting."""
        found = []
        checks = [
            ("insert mode", self.insert_mode, INSERT_MODES), ("key mode", self.key_mode, KEY_MODES),
            ("delete mode", self.delete_mode, DELETE_MODES), ("snapshot mode", self.snapshot_mode, SNAPSHOT_MODES),
            ("sync type", self.sync_type, SYNC_TYPES), ("tolerance", self.tolerance, ("none", "all")),
            ("ordering", self.ordering, ORDERINGS),
            ("frequency", self.frequency, ("realtime", "manual", *FREQUENCY_MINUTES)),
        ]
        found += [f"unknown {what} {value!r}" for what, value, known in checks if value not in known]
        if self.heartbeats_advance and self.ordering != "position":
            found.append("heartbeats advance positions only under ordering by position")
        if not self.enabled_tables:
            found.append("no enabled table")
        if self.insert_mode in ("upsert", "update") and self.key_mode == "none":
            found.append(f"{self.insert_mode} needs a key, key mode is none")
        if self.delete_mode == "hard" and self.key_mode != "record_key":
            found.append("hard deletes need the key mode record_key")
        missing = sorted(f"{t.source_schema}.{t.source_table}" for t in self.enabled_tables if not t.keys)
        if missing:
            found.append(missing_key_message(missing))
        targets = [t.target for t in self.enabled_tables]
        found += [f"target {t} is used twice" for t in sorted({t for t in targets if targets.count(t) > 1})]
        return found

    def mapping(self, spark: SparkSession) -> DataFrame:
        rows = [(self.db_id, self.database, t.source_schema, t.source_table, t.target, t.is_enabled) for t in self.tables]
        return lookup(
            spark, rows,
            "db_id int,database string,source_schema string,source_table string,target_table string,is_enabled boolean",
        )

    def with_table(self, table: TableSpec) -> PipelineSpec:
        """Add a table, or enable it again when it is known; a given target name wins."""
        same = lambda t: (t.source_schema, t.source_table) == (table.source_schema, table.source_table)
        known = [t for t in self.tables if same(t)]
        if known:
            again = replace(known[0], is_enabled=True, target_table=table.target_table or known[0].target_table)
            return replace(self, tables=tuple(again if same(t) else t for t in self.tables))
        return replace(self, tables=(*self.tables, table))

    def named(self, names: set[str]) -> tuple[TableSpec, ...]:
        """Tables by ``schema.table``, or by a bare table name that only one schema has."""
        found = []
        for name in sorted(names):
            fit = [t for t in self.tables if name in (f"{t.source_schema}.{t.source_table}", t.source_table)]
            if len(fit) > 1:
                raise ValueError(f"several schemas have a table {name}; name it with its schema")
            found += fit
        return tuple(found)

    def without_tables(self, names: set[str], allow_empty: bool = False) -> PipelineSpec:
        """Disable tables; the last enabled table only goes when ``allow_empty``."""
        going = self.named(names)
        tables = tuple(replace(t, is_enabled=False) if t in going else t for t in self.tables)
        if not allow_empty and not any(t.is_enabled for t in tables):
            raise ValueError("removing these tables would leave the pipeline empty")
        return replace(self, tables=tables)


def missing_key_message(tables: list[str]) -> str:
    shown = ", ".join(tables[:MISSING_KEYS_SHOWN])
    more = len(tables) - MISSING_KEYS_SHOWN
    return f"tables without a primary key: {shown}" + (f" and {more} more" if more > 0 else "")


def tables_without_keys(catalog: DataFrame) -> DataFrame:
    """Tables of a column catalog (tbl, name, is_key) that have no key column, sorted."""
    keyed = catalog.groupBy("tbl").agg(F.bool_or("is_key").alias("has_key"), F.count("*").alias("columns"))
    return keyed.where("NOT has_key").select("tbl", "columns").orderBy("tbl")


def missing_key_report(catalog: DataFrame) -> DataFrame:
    """One row: how many tables lack a key, and the first ten of them by name."""
    missing = tables_without_keys(catalog)
    first = missing.limit(MISSING_KEYS_SHOWN).agg(F.array_join(F.array_sort(F.collect_list("tbl")), ", ").alias("shown"))
    more = F.greatest(F.col("n") - MISSING_KEYS_SHOWN, F.lit(0))
    text = F.concat(first.scalar(), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))
    return missing.agg(F.count("*").alias("n")).select("n", text.alias("message"))

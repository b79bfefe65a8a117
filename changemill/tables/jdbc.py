"""Relational targets: folded rows out through Spark's JDBC writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.operators.fold import LIVE_OPS, fold_changes
from changemill.spec import SINK_BATCH_ROWS


def writer_options(url: str, table: str, properties: dict[str, str], batch_rows: int = SINK_BATCH_ROWS, connections: int | None = None) -> dict[str, str]:
    options = {**properties, "url": url, "dbtable": table, "batchsize": str(batch_rows), "truncate": "true"}
    return options if connections is None else {**options, "numPartitions": str(connections)}


def write_state(state: DataFrame, options: dict[str, str]) -> None:
    """Replace the rows of a target table, keeping the table itself and its keys."""
    state.write.format("jdbc").options(**options).mode("overwrite").save()


def stage_changes(folded: DataFrame, upserts: dict[str, str], deletes: dict[str, str], keys: list[str], op: str = "op") -> None:
    """Write a folded batch to two staging tables: rows to upsert, and keys to delete.

    Each key is in exactly one of them once, so the target's own MERGE and DELETE from the
    staging tables, run after this in one transaction, apply the batch; replays converge.
    """
    live = folded.where(F.col(op).isin(*LIVE_OPS)).drop(op)
    gone = folded.where(F.col(op) == "d").select(*keys)
    live.write.format("jdbc").options(**upserts).mode("overwrite").save()
    gone.write.format("jdbc").options(**deletes).mode("overwrite").save()


def stage_batches(prepare: Callable[[DataFrame], DataFrame], keys: list[str], upserts: dict[str, str], deletes: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """Batch function of a stream: decode, fold to one row per key, write the staging tables."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        stage_changes(fold_changes(prepare(batch), keys), upserts, deletes, keys)

    return on_batch

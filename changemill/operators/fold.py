"""The two folds: a change feed in, the current state of its tables out.

Every feed row carries a table name, a key, an operation and an offset that orders the
changes of its table. Operations: c(reate), u(pdate), r(ead by a snapshot), d(elete),
t(runcate). Both folds keep the last change per key with ``max_by``, which combines before
the shuffle: a key, or a table, holding a third of the feed leaves each map task as one row
per key. Both are associative, so folding micro-batches gives the batch answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.operators.ordering import nearest_in_group
from changemill.session import join_spread, measured

LIVE_OPS = ("c", "u", "r")
#: Offsets of a slice in which previous changes of a key are looked up.
_SLICE = 1 << 16


def by_key(df: DataFrame, keys: Sequence[str]):
    """Group by the keys for an aggregate that Spark has to sort.

    ``max_by`` over rows sorts each task's rows by the grouping columns. Several columns
    compare slowly one after the other, so their hash goes first and decides nearly always.
    """
    return df.groupBy(*keys) if len(keys) == 1 else df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)


def latest_per_key(
    feed: DataFrame, keys: Sequence[str], order: str | Sequence[str] = "off"
) -> DataFrame:
    """The change with the greatest order value for each key; columns keep their order."""
    order_cols = [order] if isinstance(order, str) else list(order)
    carried = [c for c in feed.columns if c not in keys]
    rank = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    last = by_key(feed, keys).agg(F.max_by(F.struct(*carried), rank).alias("_last"))
    return last.select(
        *[F.col(c) if c in keys else F.col(f"_last.`{c}`").alias(c) for c in feed.columns]
    )


def latest_with_image(feed: DataFrame, keys: Sequence[str], order: str = "off", op: str = "op") -> DataFrame:
    """Like :func:`latest_per_key`, but a delete without values keeps those of the key's last
    change that had some. Associative as well: a delete that was folded holds its image."""
    carried = [c for c in feed.columns if c not in keys]
    values = [c for c in carried if c not in (order, op, "part", "off")]
    if not values:
        return latest_per_key(feed, keys, order)
    has_image = F.col(op).isin(*LIVE_OPS)
    for value in values:
        has_image = has_image | F.col(value).isNotNull()
    folded = by_key(feed, keys).agg(
        F.max_by(F.struct(*carried), F.col(order)).alias("_last"),
        F.max_by(F.when(has_image, F.struct(*values)), F.when(has_image, F.col(order))).alias("_image"),
    )
    dead = F.col(f"_last.`{op}`") == "d"
    return folded.select(*[
        F.col(c) if c in keys
        else F.when(dead, F.col(f"_image.`{c}`")).otherwise(F.col(f"_last.`{c}`")).alias(c) if c in values
        else F.col(f"_last.`{c}`").alias(c)
        for c in feed.columns
    ])


def last_truncates(feed: DataFrame, table: str = "topic", order: str = "off", op: str = "op") -> DataFrame:
    """Greatest truncate offset per table: one row per truncated table."""
    return feed.where(F.col(op) == "t").groupBy(table).agg(F.max(order).alias("_t_off"))


def fold_changes(
    feed: DataFrame,
    keys: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Latest change per key, delete markers kept, truncates ignored."""
    return latest_per_key(feed.where(F.col(op) != "t"), keys, order)


def current_state(feed: DataFrame, keys: Sequence[str], order: str = "off", op: str = "op") -> DataFrame:
    """A row exists exactly when the last change of its key is a create, update or read."""
    return fold_changes(feed, keys, order, op).where(F.col(op).isin(*LIVE_OPS))


def drop_truncated(
    changes: DataFrame, truncates: DataFrame, table: str = "topic", order: str = "off"
) -> DataFrame:
    """Remove changes that precede the last truncate of their table."""
    return (
        changes.join(truncates, table, "left")
        .where(F.col("_t_off").isNull() | (F.col(order) > F.col("_t_off")))
        .drop("_t_off")
        .select(*changes.columns)
    )


def truncate_aware_changes(
    feed: DataFrame,
    keys: Sequence[str],
    table: str = "topic",
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Latest change per key that no later truncate wiped out, delete markers kept.

    The truncate test runs after the fold: only the winning change of a key can survive its
    table's truncate, so the join sees one row per key instead of the whole feed, and the
    other side holds one row per truncated table. That side reads the truncates' three columns
    alone; nothing runs before the result is asked for, and adaptive execution picks the join.
    """
    folded = fold_changes(feed, keys, order, op)
    return drop_truncated(folded, last_truncates(feed, table, order, op), table, order)


def truncate_aware_state(
    feed: DataFrame,
    keys: Sequence[str],
    table: str = "topic",
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    return truncate_aware_changes(feed, keys, table, order, op).where(F.col(op).isin(*LIVE_OPS))


def soft_delete_state(
    feed: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Deleted keys stay with ``__deleted = true`` and the values of their last live image.

    A delete carries no new image, so the values come from the last non-delete change; both
    are taken in one aggregate over the key.
    """
    is_live = F.col(op).isin(*LIVE_OPS)
    image = F.max_by(
        F.when(is_live, F.struct(*values)), F.when(is_live, F.col(order))
    ).alias("_image")
    last = by_key(feed.where(F.col(op) != "t"), keys).agg(
        image,
        F.max_by(F.col(op), F.col(order)).alias("_op"),
        F.max(order).alias(order),
    )
    return last.select(
        *keys,
        *[F.col(f"_image.`{v}`").alias(v) for v in values],
        order,
        (F.col("_op") == "d").alias("__deleted"),
    )


def merge_changes(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Upsert and delete a batch of changes into a state table that has no offsets.

    The batch is folded to one row per key first; its keys are measured, so a small batch is
    broadcast against the state, which then is neither shuffled nor sorted.
    """
    batch = measured(fold_changes(changes, keys, order, op))
    untouched = state.join(batch.select(*keys), list(keys), "left_anti")
    live = batch.where(F.col(op).isin(*LIVE_OPS)).select(*state.columns)
    return untouched.unionByName(live)


def split_insert_mode(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> tuple[DataFrame, DataFrame]:
    """Insert-only sink: (rows that can be inserted, rows that would break the key).

    Each key's changes are replayed in order: a live row breaks the key when the row before it in the
    batch is live too, or when the state has the key and no delete came in between; a delete makes
    room again. So the answer does not depend on where a batch was cut. Previous changes are
    looked up slice by slice, and the state's verdict is spread over the rows of a key.
    """
    existing = state.select(*keys).distinct().withColumn("_exists", F.lit(True))
    before = {"_before": F.col(op), "_deleted": F.when(F.col(op) == "d", F.col(order))}
    marked = nearest_in_group(changes, list(keys), [order], before, F.floor(F.col(order) / _SLICE))
    marked = join_spread(marked.where(F.col(op).isin(*LIVE_OPS)), existing, list(keys), "left", changes, large=True)
    reason = F.when(F.col("_exists") & F.col("_deleted").isNull(), F.lit("key_exists")).when(
        F.col("_before").isin(*LIVE_OPS), F.lit("duplicate_in_batch")
    )
    marked = marked.withColumn("reason", reason).select(*changes.columns, "reason")
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def insert_mode_state(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Rows of an insert-only sink after a batch: deleted keys are gone, accepted rows are there
    unless a delete of their key followed."""
    accepted, _ = split_insert_mode(state, changes, keys, order, op)
    deletes = changes.where(F.col(op) == "d").groupBy(*keys).agg(F.max(order).alias("_deleted"))
    left = state.join(deletes.select(*keys), list(keys), "left_anti")
    lasting = join_spread(accepted, deletes, list(keys), "left", changes).where(
        F.col("_deleted").isNull() | (F.col(order) > F.col("_deleted"))
    )
    return left.unionByName(lasting.select(*state.columns))


def update_mode_changes(changes: DataFrame, keys: Sequence[str], order: str = "off", op: str = "op") -> DataFrame:
    """Live rows that an update-only sink may apply: those before the first delete of their key,
    since a key that is gone is unknown from then on."""
    gone = changes.where(F.col(op) == "d").groupBy(*keys).agg(F.min(order).alias("_gone"))
    live = join_spread(changes.where(F.col(op).isin(*LIVE_OPS)), gone, list(keys), "left")
    return live.where(F.col("_gone").isNull() | (F.col(order) < F.col("_gone"))).drop("_gone")


def update_mode_state(
    state: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: str = "off",
    op: str = "op",
) -> DataFrame:
    """Update-only sink: existing keys take the last live image, nulls included, or go with a
    delete; unknown keys are ignored."""
    values = [c for c in state.columns if c not in keys]
    new = latest_per_key(changes.where(F.col(op).isin(*LIVE_OPS)), keys, order)
    new = new.select(*keys, F.struct(*values).alias("_new"))
    gone = changes.where(F.col(op) == "d").select(*keys).distinct()
    rows = state.join(gone, list(keys), "left_anti").join(new, list(keys), "left")
    return rows.select(
        *[
            F.col(c)
            if c in keys
            else F.when(F.col("_new").isNotNull(), F.col(f"_new.`{c}`")).otherwise(F.col(c)).alias(c)
            for c in state.columns
        ]
    )


def key_columns(
    mode: str, key_fields: Sequence[str] = (), value_fields: Sequence[str] = ()
) -> dict[str, Column]:
    """Sink key for each key mode; upsert and update need a mode other than ``none``.

    ``kafka`` keys rows by their feed coordinates, ``record_key`` by the message key and
    ``record_value`` by named value fields.
    """
    if mode == "none":
        return {}
    if mode == "kafka":
        return {"__topic": F.col("topic"), "__partition": F.col("part"), "__offset": F.col("off")}
    if mode == "record_key":
        if not key_fields:
            raise ValueError("record_key mode needs the primary-key fields of the message key")
        return {name: F.col(f"key.`{name}`") for name in key_fields}
    if mode == "record_value":
        if not value_fields:
            raise ValueError("record_value mode needs at least one named field")
        return {name: F.col(name) for name in value_fields}
    raise ValueError(f"unknown key mode {mode!r}")

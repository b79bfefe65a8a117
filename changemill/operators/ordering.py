"""Order-dependent operators without one task per group: global ranks, previous rows, last n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemill.session import cut_lineage, measured

_INDEX_BITS = 33


def global_rank(df: DataFrame, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """Zero-based position of each row in the total order of ``order``.

    Rows are range-partitioned and sorted, which Spark spreads over its shuffle partitions
    whatever the distribution; a row's rank is its index in its partition plus the rows of
    the partitions before. The sorted rows are checkpointed, so that index and counts come
    from one and the same partitioning even when an executor is lost between the two uses.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_pid", F.shiftright("_at", _INDEX_BITS))
    sizes = ordered.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition: the only frame without a partition key, and a tiny one.
    starts = measured(sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    index = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return ordered.join(starts, "_pid").select(*df.columns, (F.col("_start") + index).alias(rank))


def nearest_in_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    slice_by: Column,
    following: bool = False,
) -> DataFrame:
    """Add, for each output name, the nearest non-null value before (or after) the row in its
    group, also for groups that hold much of the data.

    Each group is cut into slices that follow its order (an hour, an offset range). Inside a
    slice this is a running ``last``; a row without one takes the last value of the nearest
    slice before it, which a second window over one row per slice supplies. No task ever sorts
    more than one slice of a group, and all values share the one sort.
    """
    # The hash leads the sort keys of the slices, where it decides most comparisons.
    keys = ["_hash", *group, "_slice"]
    step = [F.col(c).desc() if following else F.col(c) for c in order]
    edge = F.min_by if following else F.max_by
    rows = df.withColumns({"_slice": slice_by, **{f"_v_{n}": v for n, v in values.items()}})
    rows = rows.withColumn("_hash", F.xxhash64(*group, "_slice"))
    at = F.struct(*order)
    edges = rows.groupBy(*keys).agg(
        *[edge(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}") for n in values]
    )
    across = (
        Window.partitionBy(*group)
        .orderBy(F.col("_slice").desc() if following else F.col("_slice"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edges = edges.select(*keys, *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values])
    within = Window.partitionBy(*keys).orderBy(*step).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_p_{n}": F.last(f"_v_{n}", ignorenulls=True).over(within) for n in values})
    found = [F.coalesce(f"_p_{n}", f"_c_{n}").alias(n) for n in values]
    return rows.join(edges, keys, "left").select(*df.columns, *found)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 3, group: Sequence[str] = ()) -> DataFrame:
    """Last n rows by the order, overall or per group: the report of a table's newest rows.

    Spark keeps n rows per task (and per group and task) before it shuffles anything.
    """
    newest = [F.col(c).desc() for c in order]
    if not group:
        return df.orderBy(*newest).limit(n)
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*newest)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")

"""Small session helpers: shared folder, lineage cuts, measured join sides, lookup tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    A local session without that setting (tests, laptops) gets a temporary folder; a
    cluster session without it is an error, since a driver-local folder is not shared.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="changemill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive executor loss and are computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> DataFrame:
    """Cache a side that ought to be small and count it, so its true size is in the plan.

    Nothing is forced: with the measured size Spark's own broadcast threshold decides, and
    a side that turns out large is joined by shuffle. The cache is lineage-backed, so losing
    an executor only recomputes it.
    """
    cached = df.persist()
    cached.count()
    return cached


#: Rows of one key that a task may get; those of a key with more go to ``SALTS`` places.
HOT, SALTS = 1 << 16, 16


def spread(rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and verdicts with the ``_salt`` they meet on, see :func:`join_spread`."""
    hot = (rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n"))
    # At most one in ``HOT`` of the rows.
    hot = F.broadcast(hot.where(F.col("_n") > HOT).select(*keys, F.lit(True).alias("_hot")))
    place = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    # Rows without a key meet nothing, wherever they go.
    free = reduce(or_, [F.col(k).isNull() for k in keys], F.col("_hot").isNotNull())
    salted = rows.join(hot, list(keys), "left").withColumn("_salt", F.when(free, place).otherwise(0)).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted, verdicts.join(hot, list(keys), "left").withColumn("_salt", F.explode(places)).drop("_hot")


def join_spread(
    rows: DataFrame, verdicts: DataFrame, keys: Sequence[str], how: str = "inner", counted: DataFrame | None = None, large: bool = False
) -> DataFrame:
    """Join rows with one verdict a key, hot keys included.

    Verdicts that come from an aggregate over the keys lie partitioned by them, and a join would send all rows of a
    key to that one place. Here the rows of a hot key go to one of ``SALTS`` places by the task they come from, and its verdict
    to all of them; every other verdict stays one row, so the size Spark sees is the size a broadcast takes.

    ``counted`` holds the rows, or more of them, where counting ``rows`` would repeat work. ``large`` verdicts grow
    with a table: they are never broadcast, whatever the size of compressed files makes Spark expect.
    """
    salted, everywhere = spread(rows, verdicts, keys, counted)
    return salted.join(everywhere.hint("merge") if large else everywhere, [*keys, "_salt"], how).drop("_salt")


def lookup(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """Driver-side metadata (a mapping, a type table) as a DataFrame of known size."""
    names = [field.split()[0] for field in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    arrays = [
        pa.array([row[i] for row in rows], type=kinds[field.split()[1]])
        for i, field in enumerate(schema.split(","))
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=names))

"""Truncates of a paused pipeline: a durable queue, each table at most once, drained when both sides run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TruncateQueue:
    """``<name>_queue``: queued truncates, a partition a batch, so that a replay overwrites its own.
    ``<name>_queue_done``: per topic the offset up to which truncates have been carried out."""

    def __init__(self, spark: SparkSession, name: str, location: str):
        self.spark, self.name, self.location = spark, name, location

    def enqueue(self, truncates: DataFrame, batch_id: int) -> None:
        """Keep the truncates (topic, off) of a batch: one row a topic, the last."""
        rows = truncates.groupBy("topic").agg(F.max("off").alias("off"))
        queue = f"{self.name}_queue"
        if not self._exists("queue"):
            shape = rows.limit(0).withColumn("batch_id", F.lit(0).cast("bigint"))
            shape.write.format("parquet").option("path", f"{self.location}/{queue}").partitionBy("batch_id").saveAsTable(queue)
        # A streaming batch belongs to its query's own session, where its name can be resolved.
        truncates.sparkSession.sql(f"INSERT OVERWRITE TABLE {queue} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{rows}}", rows=rows)

    def pending(self) -> DataFrame:
        """(topic, off): each topic once, at its last truncate that has not been carried out."""
        if not self._exists("queue"):
            return self.spark.createDataFrame([], "topic string, off bigint")
        self.spark.catalog.refreshTable(f"{self.name}_queue")
        queued = self.spark.table(f"{self.name}_queue").groupBy("topic").agg(F.max("off").alias("off"))
        if not self._exists("queue_done"):
            return queued
        self.spark.catalog.refreshTable(f"{self.name}_queue_done")
        done = self.spark.table(f"{self.name}_queue_done").groupBy("topic").agg(F.max("off").alias("_done"))
        return queued.join(done, "topic", "left").where(F.col("_done").isNull() | (F.col("off") > F.col("_done"))).select("topic", "off")

    def drain(self, carry_out: Callable[[str, int], bool]) -> list[tuple[str, int, str]]:
        """Carry out what is pending, a topic at a time: (topic, off, applied or failed).

        ``carry_out`` may run again for a truncate that it has carried out, if the run broke off before that was
        noted, so it has to give the same outcome twice. What fails stays queued. One row a table of the pipeline
        comes to the driver.
        """
        outcomes = []
        for row in self.pending().orderBy("topic").collect():
            try:
                done = carry_out(row.topic, row.off)
            except Exception:  # noqa: BLE001  (a failed resync must not keep the others from theirs)
                done = False
            if done:
                noted = self.spark.range(1).select(F.lit(row.topic).alias("topic"), F.lit(row.off).cast("bigint").alias("off"))
                done_table = f"{self.name}_queue_done"
                noted.write.format("parquet").option("path", f"{self.location}/{done_table}").mode("append").saveAsTable(done_table)
            outcomes.append((row.topic, row.off, "applied" if done else "failed"))
        return outcomes

    def _exists(self, part: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_{part}")

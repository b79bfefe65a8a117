"""Incidents of a stream of status samples: a state machine a pipeline and alert kind, kept as its turns.

A batch is reduced to the samples at which a signal turns, going on from the last turns of earlier batches. The turns
of a batch are a partition of their own, so a replay overwrites them, and what is kept grows with the incidents
and not with the samples. Reading pairs openings and resolutions. Samples come in the order of their time from
batch to batch; how they are cut into batches does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.operators.fold import latest_per_key
from changemill.operators.monitor import paired_turns, signal_turns
from changemill.session import cut_lineage


class IncidentLog:
    def __init__(self, spark: SparkSession, name: str, location: str):
        self.spark, self.location, self.table = spark, location, f"{name}_turns"

    def on_batch(self, samples: DataFrame, batch_id: int) -> None:
        """Batch function of the stream of samples."""
        standing = self._turns(batch_id)
        if standing is not None:
            standing = latest_per_key(standing, ["pipeline", "event_type"], ["ts", "check_id"])
        # Few rows; cut off from the table, whose partition they go to.
        turns = cut_lineage(signal_turns(samples, standing=standing))
        if standing is None and not self.spark.catalog.tableExists(self.table):
            shape = turns.limit(0).withColumn("batch_id", F.lit(0).cast("bigint"))
            shape.write.format("parquet").option("path", f"{self.location}/{self.table}").partitionBy("batch_id").saveAsTable(self.table)
        samples.sparkSession.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch_id = {int(batch_id)}) SELECT * FROM {{turns}}", turns=turns)

    def incidents(self) -> DataFrame:
        """All incidents so far; those that are open have no time of resolution."""
        turns = self._turns()
        if turns is None:
            raise ValueError("no batch of samples has come yet")
        return paired_turns(turns)

    def _turns(self, before_batch: int | None = None) -> DataFrame | None:
        if not self.spark.catalog.tableExists(self.table):
            return None
        self.spark.catalog.refreshTable(self.table)
        turns = self.spark.table(self.table)
        return (turns if before_batch is None else turns.where(F.col("batch_id") < before_batch)).drop("batch_id")

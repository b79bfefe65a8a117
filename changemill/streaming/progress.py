"""Progress of running streams as rows for the monitoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from changemill.session import lookup

REPORT = "pipeline string,batch_id bigint,rows bigint,finished_at string"


class ProgressLog(StreamingQueryListener):
    """Keeps every progress report; attach with ``spark.streams.addListener``.

    The driver holds up to ``keep`` reports; with a ``path`` in a shared folder full ones are appended there as files, in the
    reports' order, and the driver starts anew. Without a path all stay on the driver.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None, keep: int = 1000):
        self.spark, self.path, self.keep, self.rows = spark, path, keep, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append((p.name or str(p.id), p.batchId, p.numInputRows, p.timestamp))
        if self.path and len(self.rows) >= self.keep:
            self.flush()

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def flush(self) -> None:
        """Append what the driver holds to the files."""
        full, self.rows = self.rows, []
        if full:
            lookup(self.spark, full, REPORT).coalesce(1).write.mode("append").parquet(self.path)

    def as_rows(self, spark: SparkSession) -> DataFrame:
        held = lookup(spark, self.rows, REPORT)
        if self.path is None:
            return held
        self.flush()
        return spark.read.schema(held.schema).parquet(self.path)

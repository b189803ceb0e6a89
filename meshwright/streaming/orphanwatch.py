"""Orphan references of a stream of deliveries: one period per micro-batch of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.orphans import INDEX_SCHEMA, PENDING, apply_period, grow_index
from meshwright.runtime import latest_version

LOG_SCHEMA = "period long, kind string, space string, key string, row_id long, field string"


class OrphanWatch:
    """Keeps the state of ``operators.orphans`` under a folder, a version for each batch.

    Log rows are parents (kind 'parent': space, key) or references (kind 'reference'). A version
    is written whole before the batch ends and read by the next, so a batch that is run again
    after a failure starts from the same state and overwrites its own version: each period counts
    once. Periods of a batch are applied in order.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str, version: int) -> DataFrame | None:
        if version < 0:
            return None
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={version}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.spark = spark
        state_schema = "period long, row_id long, field string, space string, key string, state string"
        index, state = (self._read(n, s, batch_id - 1) for n, s in (("index", INDEX_SCHEMA), ("state", state_schema)))
        log = f"{self.folder}/log/v={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        rows = spark.read.schema(LOG_SCHEMA).parquet(log)
        for period in sorted(r[0] for r in rows.select("period").distinct().collect()):
            now = rows.where(F.col("period") == period)
            index = grow_index(index, now.where("kind = 'parent'"), period)
            waiting = None if state is None else state.where(F.col("state") == PENDING).drop("state")
            step = apply_period(index, waiting, now.where("kind = 'reference'").select("row_id", "field", "space", "key"), period)
            state = step if state is None else state.where(F.col("state") != PENDING).unionByName(step)
        if index is None:
            index, state = spark.createDataFrame([], INDEX_SCHEMA), spark.createDataFrame([], state_schema)
        index.write.mode("overwrite").parquet(f"{self.folder}/index/v={batch_id}")
        state.write.mode("overwrite").parquet(f"{self.folder}/state/v={batch_id}")

    @property
    def version(self) -> int:
        """The last batch whose state was written whole; known after a restart too."""
        return latest_version(self.spark, f"{self.folder}/state")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def state(self) -> DataFrame:
        """Orphans so far; what still waits may resolve later."""
        return self.spark.read.parquet(f"{self.folder}/state/v={self.version}")

"""Orphan references kept up to date over a feed of single changes, deletions included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.runtime import latest_version

FEED_SCHEMA = "seq long, period long, kind string, space string, key string, row_id long, field string"
PARENT_SCHEMA = "space string, key string, alive boolean, bucket int"
REFERENCE_SCHEMA = "row_id long, field string, space string, key string, open boolean, bucket int"
EVENT_SCHEMA = "batch long, period long, row_id long, field string, space string, key string, event string"


class OrphanFeed:
    """State keyed by (space, key), cut into buckets; a batch reads and writes only its own buckets.

    Rows of the feed: a parent arrives (kind 'parent') or goes ('gone'), a reference arrives
    ('reference') or is withdrawn ('withdrawn'). A new reference probes the parents of its key and
    is 'opened' if none is alive; an arriving parent makes the open references of its key
    'resolved'; one that goes makes those it held 'reopened'. Of several rows of a key in a batch
    the greatest ``seq`` decides. Rows with a null space or key are ignored, repeated ones count
    once. Decisions are appended, a folder per batch, and never written again. A batch run again
    after a failure starts from the buckets as they were before it and overwrites its own folders.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _placed(self, version: int) -> dict[int, int]:
        """{bucket: batch that wrote it last} as of a version."""
        if version < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/manifest/v={version}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def _read(self, name: str, schema: str, placed: dict[int, int], touched: list[int]) -> DataFrame:
        paths = [f"{self.folder}/{name}/v={placed[b]}/bucket={b}" for b in touched if b in placed]
        present = [p for p in paths if self._exists(p)]
        if not present:
            return self.spark.createDataFrame([], schema)
        plain = ", ".join(c for c in schema.split(", ") if not c.startswith("bucket"))
        return self.spark.read.schema(plain).parquet(*present).withColumn("bucket", self._bucket())

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _bucket(self):
        return F.pmod(F.xxhash64("space", "key"), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.spark = spark = batch.sparkSession
        log = f"{self.folder}/log/v={batch_id}"
        known = batch.where(F.col("space").isNotNull() & F.col("key").isNotNull())
        known.select(*[c.split()[0] for c in FEED_SCHEMA.split(", ")]).withColumn("bucket", self._bucket()).write.mode("overwrite").parquet(log)
        rows = spark.read.schema(FEED_SCHEMA + ", bucket int").parquet(log)
        placed = self._placed(max(batch_id - 1, -1))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

        change = rows.where(F.col("kind").isin("parent", "gone")).groupBy("space", "key", "bucket")
        change = change.agg(F.max(F.struct("seq", (F.col("kind") == "parent").alias("now"), "period")).alias("x")).select("space", "key", "bucket", "x.now", F.col("x.period").alias("at"))
        before = self._read("parents", PARENT_SCHEMA, placed, touched)
        parents = before.join(change, ["space", "key", "bucket"], "full").select("space", "key", F.coalesce("now", "alive").alias("alive"), "bucket", "at")
        self._write(parents.select("space", "key", "alive", "bucket"), "parents", batch_id)

        told = rows.where(F.col("kind").isin("reference", "withdrawn")).groupBy("row_id", "field", "space", "key", "bucket")
        told = told.agg(F.max(F.struct("seq", (F.col("kind") == "reference").alias("there"), "period")).alias("x"))
        told = told.select("row_id", "field", "space", "key", "bucket", "x.there", F.col("x.period").alias("told_at"))
        old = self._read("references", REFERENCE_SCHEMA, placed, touched)
        both = old.join(told, ["row_id", "field", "space", "key", "bucket"], "full").where(F.coalesce("there", F.lit(True)))
        now = both.join(parents, ["space", "key", "bucket"], "left")
        now = now.select("row_id", "field", "space", "key", "bucket", "open", (~F.coalesce("alive", F.lit(False))).alias("is_open"), F.coalesce("told_at", "at").alias("period"))
        self._write(now.select("row_id", "field", "space", "key", F.col("is_open").alias("open"), "bucket"), "references", batch_id)
        event = F.when(F.col("open").isNull() & F.col("is_open"), "opened").when(F.col("open") & ~F.col("is_open"), "resolved").when(~F.col("open") & F.col("is_open"), "reopened")
        events = now.select(F.lit(batch_id).cast("long").alias("batch"), "period", "row_id", "field", "space", "key", event.alias("event")).where(F.col("event").isNotNull())
        events.write.mode("overwrite").parquet(f"{self.folder}/events/v={batch_id}")
        manifest = [(b, batch_id if b in touched else v) for b, v in (placed | dict.fromkeys(touched, batch_id)).items()]
        spark.createDataFrame(manifest, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/v={batch_id}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/v={batch_id}")

    @property
    def version(self) -> int:
        return latest_version(self.spark, f"{self.folder}/manifest")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def open_references(self) -> DataFrame:
        """Orphans as of the last batch: (row_id, field, space, key)."""
        placed = self._placed(self.version)
        return self._read("references", REFERENCE_SCHEMA, placed, sorted(placed)).where("open").drop("open", "bucket")

    def events(self) -> DataFrame:
        """All decisions so far; counts of them per period and field are the periodic report."""
        return self.spark.read.schema(EVENT_SCHEMA).parquet(f"{self.folder}/events/v=*")

"""Incremental upkeep of the graph from an append-only log of re-read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.graph import Graph
from meshwright.operators.maintain import replace_files
from meshwright.runtime import Workspace, latest_version
from meshwright.sources import pysource

LOG_SCHEMA = "snapshot int, path string, text string"
EDGE_SCHEMA = "snapshot int, src string, relation string, dst_symbol string, dst_id string, weight double, provenance string, source string, name_based boolean"
HOLE_SCHEMA = "snapshot int, src string, relation string, dst_symbol string, name_based boolean"


class GraphWatch:
    """Versions of a graph in a folder: nodes, edges and holes as Parquet, each under ``v=<n>``.

    A batch of (snapshot, path, text) rows replaces what these files held; a null text removes the
    file. The version of a batch is overwritten if the batch is run again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @property
    def version(self) -> int:
        """The last batch that was written whole: its holes are written last."""
        return latest_version(self.spark, f"{self.folder}/holes")

    def load(self, version: int) -> Graph:
        return Graph(*(self.spark.read.parquet(f"{self.folder}/{t}/v={version}") for t in ("nodes", "edges", "holes")))

    def save(self, graph: Graph, version: int) -> None:
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges), ("holes", graph.holes)):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={version}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.spark = batch.sparkSession
        ws = Workspace(self.spark, "watch")
        files = ws.write(batch, "files")
        sources = files.where(F.col("text").isNotNull())
        nodes = ws.write(pysource.definitions(sources), "nodes")
        changed = ws.write(files.select("snapshot", F.col("path").alias("file")).distinct(), "changed")
        empty = Graph(*(self.spark.createDataFrame([], s) for s in (pysource.NODE_SCHEMA, EDGE_SCHEMA, HOLE_SCHEMA)))
        before = self.load(batch_id - 1) if batch_id else empty
        kept = before.nodes.join(changed, ["snapshot", "file"], "left_anti")
        everything = ws.write(kept.unionByName(nodes.select(*kept.columns)), "all-nodes")
        edges = ws.write(pysource.resolve(everything, pysource.references(sources)), "edges")
        self.save(replace_files(before, changed, nodes, edges), batch_id)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

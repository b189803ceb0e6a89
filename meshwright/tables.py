"""The project's tables and the views that several plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation_key(column: str | Column = "relation") -> Column:
    """Relations are spelled unevenly; compared upper-case and trimmed."""
    return F.upper(F.trim(F.col(column) if isinstance(column, str) else column))


def periods(spark: SparkSession, sf_dir: str) -> list[int]:
    """Numbers of the delivered snapshots in order: one row per delivery."""
    rows = table(spark, sf_dir, "snapshots").select("snapshot").distinct().collect()
    return sorted(r[0] for r in rows if r[0] is not None)


NODE_FIELDS = ("kind", "name", "location", "end_line", "is_stub", "arity", "summary")


def node_versions(nodes: DataFrame, fields: tuple[str, ...] = (*NODE_FIELDS, "file", "roles")) -> DataFrame:
    """One row per (snapshot, id): the version with the greatest ``ingested_at``.

    A maximum over structs is combined on the map side, so a node delivered many times costs
    one row per task. Equal times are settled by the greatest content; roles come out as a set.
    """
    shown = [F.array_sort(F.array_distinct("roles")).alias("roles") if f == "roles" else F.col(f) for f in fields]
    top = F.max(F.struct(F.col("ingested_at"), *shown)).alias("v")
    return nodes.groupBy("snapshot", "id").agg(top).select("snapshot", "id", *[F.col("v")[f].alias(f) for f in fields])

"""A report of the whole in Markdown: counts, hubs, issues, stale code, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.plans import coverops, graphops

#: Rows shown of each part; the counts are of all.
SHOWN = 15


def _table(df: DataFrame, *order) -> str:
    rows = df.orderBy(*order).limit(SHOWN).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


def build_report(spark: SparkSession, sf_dir: str) -> str:
    last = lambda df: df.where(F.col("snapshot") == df.agg(F.max("snapshot")).first()[0])
    q = graphops.QUERIES
    issues = last(q["scan"](spark, sf_dir)).drop("snapshot")
    stale = last(q["find_stale"](spark, sf_dir)).drop("snapshot")
    rank = F.when(F.col("urgency") == "red", 0).when(F.col("urgency") == "orange", 1).otherwise(2)
    parts = [
        ("Nodes by kind", _table(last(q["orient"](spark, sf_dir)).drop("snapshot"), F.desc("n_nodes"))),
        ("Read first", _table(last(q["hubs"](spark, sf_dir)).drop("snapshot"), "place")),
        (f"Issues ({issues.count()})", _table(issues, rank, "issue", "id", "detail")),
        (f"Not reached from any entry point ({stale.count()})", _table(stale, "id")),
        ("Changed often and depended on", _table(coverops.QUERIES["risk"](spark, sf_dir), F.desc("risk"), "file")),
    ]
    return "\n\n".join(["# Report", *(f"## {title}\n\n{body}" for title, body in parts)])

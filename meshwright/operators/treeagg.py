"""Aggregation by a tree of merges, for keys of which a few hold most records.

Every input partition is a chunk of bounded size. Its rows are combined per key before they
leave the task, then partial states meet in groups of ``fan_in`` chunks, the groups' states in
groups of ``fan_in`` groups and so on. No task ever receives more than ``fan_in`` partial states
of one key per level, however many chunks hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial states of one key that meet in one merge.
FAN_IN = 32


@dataclass(frozen=True)
class State:
    """A mergeable aggregate: ``first`` over rows, ``merge`` over partial states."""

    name: str
    first: Column
    merge: str


def count_rows(name: str) -> State:
    return State(name, F.count(F.lit(1)), "sum")


def sum_of(name: str, column: Column) -> State:
    return State(name, F.sum(column), "sum")


def max_of(name: str, column: Column) -> State:
    return State(name, F.max(column), "max")


def min_of(name: str, column: Column) -> State:
    return State(name, F.min(column), "min")


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[State], *, fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """One row per distinct key with its merged states; a null key is a key like any other.

    ``chunks`` is the number of input partitions if it is known, else it is asked of the plan.
    Rows that come twice count twice; an empty input gives no rows.
    """
    n = chunks if chunks is not None else df.rdd.getNumPartitions()
    group = "_mw_chunk"
    cur = df.withColumn(group, F.spark_partition_id())
    merged = [s.first.alias(s.name) for s in states]
    while True:
        n = -(-n // fan_in)
        if n <= 1:
            return cur.groupBy(*keys).agg(*merged)
        cur = cur.withColumn(group, F.floor(F.col(group) / fan_in).cast("int")).groupBy(*keys, group).agg(*merged)
        merged = [F.expr(f"{s.merge}(`{s.name}`)").alias(s.name) for s in states]


def heavy_keys(edges: DataFrame, fields: Sequence[str], share: float | str, *, fan_in: int = FAN_IN) -> DataFrame:
    """(field, node_id, n_rows): values that stand in a field in at least ``share`` of all rows.

    The share is of all rows, those with a null in the field included; nulls are no values.
    """
    least, total = Fraction(str(share)), edges.count()
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("node_id")) for f in fields]))
    long = edges.select(cells.alias("x")).select("x.field", "x.node_id").where(F.col("node_id").isNotNull())
    counted = tree_aggregate(long, ["field", "node_id"], [count_rows("n_rows")], fan_in=fan_in)
    return counted.where(F.col("n_rows") * F.lit(least.denominator) >= F.lit(least.numerator * total))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst_id", *, fan_in: int = FAN_IN) -> DataFrame:
    """(node_id, n_in, n_out, n_callers, n_callees) of every id that stands in a field.

    ``n_in`` and ``n_out`` count rows, ``n_callers`` and ``n_callees`` distinct non-null partners.
    Rows are first combined per pair, which spreads a hot id over its partners; what remains of
    an id is merged as a tree. A null end has no degree, its partner keeps the row count.
    """
    pairs = edges.groupBy(F.col(src).alias("s"), F.col(dst).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    one = F.when(both, F.lit(1)).otherwise(F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    ends = F.array(
        F.struct(F.col("d").alias("node_id"), F.col("n").alias("n_in"), zero.alias("n_out"), one.alias("n_callers"), zero.alias("n_callees")),
        F.struct(F.col("s").alias("node_id"), zero.alias("n_in"), F.col("n").alias("n_out"), zero.alias("n_callers"), one.alias("n_callees")),
    )
    long = pairs.select(F.explode(ends).alias("x")).select("x.*").where(F.col("node_id").isNotNull())
    names = ("n_in", "n_out", "n_callers", "n_callees")
    chunks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tree_aggregate(long, ["node_id"], [sum_of(c, F.col(c)) for c in names], fan_in=fan_in, chunks=chunks)

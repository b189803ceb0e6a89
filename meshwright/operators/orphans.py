"""References to records that do not exist.

Keyed state is kept from period to period: an index of parents (when each was first and last
seen) and the references that wait for one. A period is applied in one step: its parents go into
the index, its references probe it, parents seen for the first time resolve waiting references.
A parent that is deleted is no longer seen, so references of later periods are orphans again.
Work per period follows the period's rows and the waiting references, not the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.runtime import Workspace

DELETED, LATER, PENDING, NEVER = "deleted", "later", "pending", "never"

INDEX_SCHEMA = "space string, key string, first_seen long, last_seen long"


@dataclass
class OrphanState:
    """``index``: (space, key, first_seen, last_seen); ``waiting``: pending references."""

    index: DataFrame
    waiting: DataFrame | None


def parent_keys(tables: Sequence[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(space, key) of all parents: each table gives a key per space; null keys are none."""
    out = None
    for df, spaces in tables:
        cells = F.array(*[F.struct(F.lit(s).alias("space"), c.cast("string").alias("key")) for s, c in spaces.items()])
        keys = df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("key").isNotNull())
        out = keys if out is None else out.unionByName(keys)
    return out


def reference_keys(df: DataFrame, row_id: str, fields: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(row_id, field, space, key): a row per (field, space, value) with a non-null value."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(s).alias("space"), c.cast("string").alias("key")) for f, s, c in fields])
    return df.select(F.col(row_id).alias("row_id"), F.explode(cells).alias("x")).select("row_id", "x.*").where(F.col("key").isNotNull())


def grow_index(index: DataFrame | None, parents: DataFrame, period: int) -> DataFrame:
    """The index after a period: parents of the period are seen now, others keep their times."""
    now = F.lit(period).cast("long")
    seen = parents.select("space", "key", now.alias("first_seen"), now.alias("last_seen"))
    both = seen if index is None else index.unionByName(seen)
    return both.groupBy("space", "key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def apply_period(index: DataFrame, waiting: DataFrame | None, references: DataFrame, period: int) -> DataFrame:
    """Orphans decided or left waiting in a period: (period, row_id, field, space, key, state).

    ``index`` already holds the period. New references without a living parent are 'deleted' if
    the index knows an earlier one and else 'pending'; waiting ones whose parent is first seen in
    the period become 'later', the others stay 'pending'.
    """
    now = F.lit(period).cast("long")
    probe = references.join(index, ["space", "key"], "left").where(F.col("last_seen").isNull() | (F.col("last_seen") != now))
    new = probe.select(
        F.lit(period).cast("long").alias("period"), "row_id", "field", "space", "key",
        F.when(F.col("last_seen").isNull(), PENDING).otherwise(DELETED).alias("state"),
    )
    if waiting is None:
        return new
    arrived = index.where(F.col("first_seen") == now).select("space", "key", F.lit(True).alias("here"))
    old = waiting.join(arrived, ["space", "key"], "left").select(
        "period", "row_id", "field", "space", "key", F.when(F.col("here"), LATER).otherwise(PENDING).alias("state")
    )
    return new.unionByName(old)


def orphans(parents_of: Callable[[int], DataFrame], references_of: Callable[[int], DataFrame], order: Sequence[int]) -> DataFrame:
    """(period, row_id, field, space, key, state) over all periods, folded one after the other.

    ``state`` is 'deleted' if an earlier period had the parent, 'later' if only a later one has
    it, else 'never'. Each reference counts as often as it comes; a null value is no reference.
    A period without parents makes every reference of it an orphan; no periods give no rows.
    """
    probe = references_of(order[0] if order else 0)
    ws = Workspace(probe.sparkSession, "orphans")
    index = waiting = None
    decided: list[DataFrame] = []
    for period in order:
        grown = ws.write(grow_index(index, parents_of(period), period), "index")
        state = ws.write(apply_period(grown, waiting, references_of(period), period), "state", partition_by=("state",))
        ws.drop(index)
        index = grown
        decided.append(state.where(F.col("state").isin(DELETED, LATER)))
        waiting = state.where(F.col("state") == PENDING).drop("state")
    if waiting is None:
        empty = probe.limit(0)
        return empty.select(F.lit(0).cast("long").alias("period"), "row_id", "field", "space", "key", F.lit(NEVER).alias("state"))
    out = waiting.withColumn("state", F.lit(NEVER))
    for part in decided:
        out = out.unionByName(part)
    return out


def period_report(found: DataFrame, table: str) -> DataFrame:
    """(table, period, field, state, n_references, n_keys): orphan counts per field and period."""
    return (
        found.groupBy("period", "field", "state", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("period", "field", "state")
        .agg(F.sum("n").alias("n_references"), F.count(F.lit(1)).alias("n_keys"))
        .select(F.lit(table).alias("tbl"), "period", "field", "state", "n_references", "n_keys")
    )

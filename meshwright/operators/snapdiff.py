"""What changed between full snapshots.

All snapshots of a table are laid out range-partitioned and sorted by key, so that the versions
of a key lie next to each other in one range. A single pass then merges the sorted runs: the row
at hand is held against the previous and the next snapshot's row of the same key, and every step
emits typed changes. The exchange by range is the only one of the wide rows; what comes before
is an aggregation that is combined on the map side and leaves one row per key and snapshot, so
neither a group of copies nor a hot key makes a long range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a presence word that are used; longer histories are taken in overlapping stretches.
WORD = 60


def _position(period: Column, order: Sequence[int]) -> Column:
    """0-based place of a period in the order of deliveries, null for one that was not delivered."""
    at = F.array_position(F.array(*[F.lit(p).cast("long") for p in order]), period.cast("long"))
    return F.when(at > 0, (at - 1).cast("int"))


def _period(at: Column, order: Sequence[int]) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("int") for p in order]), at + 1)


def record_changes(rows: DataFrame, period: str, keys: Sequence[str], values: Sequence[str], order: Sequence[int], *, version: str | None = None) -> DataFrame:
    """(period, keys..., change, fields) between consecutive deliveries in ``order``.

    ``change`` is 'added', 'removed' or 'changed'; ``fields`` names the values that differ and is
    null but for 'changed'. Values are compared exactly and null-safe: null differs from empty,
    two nulls are equal. Array values are compared as sets. Of several rows of a key in a period
    the one with the greatest ``version`` counts, then the greatest values. A null key is a key.
    Rows of periods not in ``order`` are left out; a period without rows removes everything.
    """
    arrays = {f.name for f in rows.schema if f.dataType.typeName() == "array"}
    k = [f"k{i}" for i in range(len(keys))]
    v = [f"v{i}" for i in range(len(values))]
    value = F.struct(*[(F.array_sort(F.array_distinct(F.col(c))) if c in arrays else F.col(c)).alias(n) for c, n in zip(values, v)])
    newest = F.struct(*([F.col(version)] if version else []), value.alias("v"))
    base = rows.select(_position(F.col(period), order).alias("at"), *[F.col(c).alias(n) for c, n in zip(keys, k)], newest.alias("x"))
    one = base.where(F.col("at").isNotNull()).groupBy("at", *k).agg(F.max("x").alias("x")).select("at", *k, F.col("x.v").alias("v"))

    laid = one.repartitionByRange(*k).sortWithinPartitions(*k, "at")
    run = Window.partitionBy(*k).orderBy("at")
    merged = laid.select("at", *k, "v", F.lag("at").over(run).alias("at0"), F.lag("v").over(run).alias("v0"), F.lead("at").over(run).alias("at1"))
    follows = F.col("at0") == F.col("at") - 1
    differ = F.array_compact(F.array(*[F.when(~F.col(f"v.{n}").eqNullSafe(F.col(f"v0.{n}")), F.lit(c)) for c, n in zip(values, v)]))
    came = F.when(
        F.col("at") > 0,
        F.when(~F.coalesce(follows, F.lit(False)), F.struct("at", F.lit("added").alias("change"), F.lit(None).cast("array<string>").alias("fields"))).when(
            ~F.col("v").eqNullSafe(F.col("v0")), F.struct("at", F.lit("changed").alias("change"), differ.alias("fields"))
        ),
    )
    stays = F.coalesce(F.col("at1") == F.col("at") + 1, F.lit(False))
    went = F.when(
        (F.col("at") < len(order) - 1) & ~stays,
        F.struct((F.col("at") + 1).alias("at"), F.lit("removed").alias("change"), F.lit(None).cast("array<string>").alias("fields")),
    )
    events = merged.select(*k, F.explode(F.array_compact(F.array(came, went))).alias("e"))
    return events.select(
        _period(F.col("e.at"), order).alias(period), *[F.col(n).alias(c) for c, n in zip(keys, k)], F.col("e.change").alias("change"), F.col("e.fields").alias("fields")
    )


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each entry but the first differs from the one before it; two nulls are equal."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    nulls = pc.and_(pc.is_null(now), pc.is_null(before))
    return ~pc.coalesce(pc.equal(now, before), nulls).to_numpy(zero_copy_only=False)


def _merge_runs(n_keys: int, moves: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over a range sorted by key and member: a row per key that moved or may go on in
    the next range. ``moves``: the bits that stand for a step between two deliveries."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True

        def chosen(table: pa.Table, border: list[int]) -> pa.RecordBatch:
            keep = table.column("moved").to_numpy() & moves != 0
            keep[border] = True
            return table.filter(pa.array(keep)).combine_chunks().to_batches(max_chunksize=1 << 20)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select([*range(n_keys), batch.schema.names.index("seen")])
            seen = table.column("seen").to_numpy()
            table = table.append_column("moved", pa.array(seen ^ (seen << 1)))
            if held is not None:
                table = pa.concat_tables([held, table])
            keys = [table.column(i).combine_chunks() for i in range(n_keys)]
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for key in keys:
                change |= _differs(key)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            out = table.select(list(range(n_keys))).take(pa.array(starts))
            for name in ("seen", "moved"):
                out = out.append_column(name, pa.array(np.bitwise_or.reduceat(table.column(name).to_numpy(), starts)))
            done, held = out.slice(0, out.num_rows - 1), out.slice(out.num_rows - 1)
            if done.num_rows:
                yield from chosen(done, [0] if first else [])
                first = False
        if held is not None:
            yield from chosen(held, [0])

    return merge


def set_changes(rows: DataFrame, period: str, keys: Sequence[str], members: Sequence[str], order: Sequence[int]) -> DataFrame:
    """(period, keys..., change) where a key's set of members differs between deliveries.

    A key is added or removed with its first or last member; it is changed if it stands in both
    deliveries and any member stands in one of them only. Null counts as a member, a null key is
    a key, repeated rows count once. Rows of periods not in ``order`` are left out.

    The set of a key is never gathered. Each member carries the word of deliveries it was seen
    in; words are combined before any exchange. Ranges are cut by key and member, so even a key
    with a third of all rows spreads over several; a range gives one row for it, and what the
    ranges found of a key is put together at the end, where only keys that moved still are.
    """
    k = [f"k{i}" for i in range(len(keys))]
    m = [f"m{i}" for i in range(len(members))]
    parts = []
    for start in range(0, max(1, len(order) - 1), WORD - 1):
        stretch = list(order[start : start + WORD])
        at = _position(F.col(period), stretch)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), at).alias("seen")
        base = rows.select(one, *[F.col(c).alias(n) for c, n in zip(keys, k)], *[F.col(c).alias(n) for c, n in zip(members, m)])
        words = base.where(F.col("seen").isNotNull()).groupBy(*k, *m).agg(F.bit_or("seen").alias("seen")).select(*k, *m, "seen")
        laid = words.repartitionByRange(*k, *m).sortWithinPartitions(*k, *m)
        # bit i of seen ^ (seen << 1): the member stands in exactly one of deliveries i-1 and i
        moves = (1 << len(stretch)) - 2
        kinds = ", ".join(f"{n} {base.schema[n].dataType.simpleString()}" for n in k)
        merged = laid.mapInArrow(_merge_runs(len(k), moves), f"{kinds}, seen long, moved long")
        whole = merged.groupBy(*k).agg(F.bit_or("seen").alias("seen"), F.bit_or("moved").alias("moved"))
        steps = []
        for i in range(1, len(stretch)):
            now, before = (F.getbit("seen", F.lit(i)) == 1), (F.getbit("seen", F.lit(i - 1)) == 1)
            change = F.when(now & ~before, "added").when(before & ~now, "removed").when(now & before & (F.getbit("moved", F.lit(i)) == 1), "changed")
            steps.append(F.when(change.isNotNull(), F.struct(F.lit(stretch[i]).cast("int").alias("period"), change.alias("change"))))
        none = F.lit(None).cast("struct<period:int,change:string>")
        events = whole.select(*k, F.explode(F.array_compact(F.array(*(steps or [none])))).alias("e"))
        parts.append(events.select(F.col("e.period").alias(period), *[F.col(n).alias(c) for c, n in zip(keys, k)], F.col("e.change").alias("change")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

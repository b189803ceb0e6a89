"""Items that appear together.

A blocked Gram matrix: records are taken in blocks, a block is the sparse binary matrix X of its
records and items, and X'X holds the counts of its pairs. Products of one block are summed in the
task over bounded stretches, then over all blocks by an aggregation that combines before it
shuffles, and the counts are normalised by the marginals that chance would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.itemcodes import code, safe_seed
from meshwright.runtime import Workspace

#: Products made at once, which bounds memory for records of any length.
STRETCH = 2_000_000


def gram_block(flat: np.ndarray, offsets: np.ndarray, stretch: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counts of the pairs i < j of one block of records given as sorted rows of a sparse matrix.

    Rows of X are ``flat[offsets[r]:offsets[r + 1]]``; yields (i, j, count) whose sums over all
    that is yielded are the upper triangle of X'X.
    """
    items, index = np.unique(flat, return_inverse=True)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    after = ends - np.arange(len(flat)) - 1
    upto = np.cumsum(after)
    at = 0
    while at < len(flat):
        base = upto[at] - after[at]
        stop = max(at + 1, int(np.searchsorted(upto, base + stretch, side="right")))
        n = after[at:stop]
        row = np.repeat(np.arange(at, stop), n)
        if len(row):
            column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + row + 1
            pair, count = np.unique(index[row].astype(np.int64) * len(items) + index[column], return_counts=True)
            yield items[pair // len(items)], items[pair % len(items)], count
        at = stop


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_ab", pa.int64())])
    for batch in batches:
        items = batch.column("items")
        offsets = items.offsets.to_numpy()
        flat = items.values.to_numpy()[offsets[0] : offsets[-1]]
        for a, b, n in gram_block(flat, offsets - offsets[0]):
            for at in range(0, len(a), 200_000):
                cut = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (a, b, n)], schema=schema)


def cooccurrence(
    rows: DataFrame, record: str, item: str, n_records: int, *, min_together: int = 1, min_lift: int = 0
) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, lift) for pairs of items a < b that share records.

    ``rows`` holds a row per record and item; repeated rows count once, rows with a null record
    or item do not count. ``n_records`` is the number of all records, those without items too.
    lift = n_ab * n_records / (n_a * n_b) is how much more often than chance the two appear
    together. Pairs with n_ab < ``min_together`` or lift < ``min_lift`` are left out; the bounds
    are compared in whole numbers and tell beforehand which items can't be in any pair that
    stays: an item of fewer than ``min_together`` records, and one of more than
    n_records / min_lift, since n_ab <= min(n_a, n_b). No rows give no pairs.
    """
    ws = Workspace(rows.sparkSession, "cooccur")
    long = rows.select(F.col(record).cast("string").alias("record"), F.col(item).cast("string").alias("item")).dropna()
    names = ws.write(long.groupBy("item").count(), "items")
    seed = safe_seed(names, "item")
    sets = long.groupBy("record").agg(F.collect_set(code(F.col("item"), seed)).alias("items"))
    sets = ws.write(sets.select(F.monotonically_increasing_id().alias("row"), "items"), "sets")
    each = sets.select("row", F.explode("items").alias("h"))
    marginal = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    kept = ws.write(marginal.where((F.col("n") >= min_together) & (F.col("n") * F.lit(min_lift) <= F.lit(n_records))), "marginals")
    left = each.join(kept.select("h"), "h").groupBy("row").agg(F.sort_array(F.collect_list("h")).alias("items")).where(F.size("items") > 1)
    counts = left.select("items").mapInArrow(_gram, "a long, b long, n_ab long").groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    counts = counts.where(F.col("n_ab") >= min_together)
    named = kept.join(names.select(code(F.col("item"), seed).alias("h"), "item"), "h")
    ends = [named.select(F.col("h").alias(x), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab"]
    held = counts.join(ends[0], "a").join(ends[1], "b")
    expected = F.col("n_a").cast("decimal(19,0)") * F.col("n_b").cast("decimal(19,0)")
    held = held.where(F.col("n_ab").cast("decimal(19,0)") * F.lit(n_records) >= expected * F.lit(min_lift))
    turn = F.col("item_a") > F.col("item_b")
    swap = lambda x, y, name: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name)
    lift = (F.col("n_ab") * F.lit(float(n_records)) / (F.col("n_a") * F.col("n_b").cast("double"))).alias("lift")
    return held.select(swap("item_a", "item_b", "item_a"), swap("item_b", "item_a", "item_b"), "n_ab", swap("n_a", "n_b", "n_a"), swap("n_b", "n_a", "n_b"), lift)

"""Lookups of rows by a key that many of them may share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this part of all rows is hot, so there are at most so many hot keys.
HOT_PART = 1000
#: Rows of one key that are no burden to a task.
FEW = 50_000


def look_up(rows: DataFrame, known: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``, which has one row per key; ``how`` is inner or left.

    Rows of hot keys are not moved: what is known of these keys, at most ``HOT_PART`` rows, is
    broadcast to them, and only the others are laid out by key. Hot keys are counted with sums
    that are combined before they are shuffled. ``rows`` should be a written table: it is read
    for the counts and once for each of the two parts.
    """
    keys = list(keys)
    n = rows.count()
    if n <= FEW:
        return rows.join(known, keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_of_key"))
    hot = counts.where(F.col("n_of_key") >= max(FEW, -(-n // HOT_PART))).select(*keys)
    marked = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), keys, "left")
    cold = marked.where("is_hot IS NULL").drop("is_hot").join(known, keys, how)
    warm = marked.where("is_hot").drop("is_hot").join(F.broadcast(known.join(F.broadcast(hot), keys)), keys, how)
    return cold.unionByName(warm)

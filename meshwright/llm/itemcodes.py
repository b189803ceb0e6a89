"""Items as 64-bit codes that are proven to be distinct before they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code(item: Column, seed: int) -> Column:
    """Negative 63-bit code of a string; the non-negative half is left for items named apart."""
    return F.xxhash64(F.lit(seed), item).bitwiseOR(F.lit(-(1 << 63)))


def safe_seed(items: DataFrame, item: str, first: int = 42, tries: int = 16) -> int:
    """A seed under which no two distinct items have one code, looked for over all items."""
    distinct = items.select(F.col(item).alias("item")).where(F.col("item").isNotNull()).distinct()
    for seed in range(first, first + tries):
        if distinct.groupBy(code(F.col("item"), seed).alias("h")).count().where("count > 1").isEmpty():
            return seed
    raise ValueError(f"no seed of {tries} gives distinct codes")

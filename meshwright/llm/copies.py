"""Wholly equal records told apart by a number that follows from the data alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies that are laid out by one row of an intermediate table.
STRETCH = 4096


def numbered_copies(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., copy): a row per record, equal ones numbered from 0, whatever files they are in.

    Counts are combined on the map side; a group of many copies becomes stretches that are spread
    over all partitions before their rows are made again, so no task lays out a whole group.
    """
    counted = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    few = counted.where(F.col("n") <= STRETCH).withColumn("first", F.lit(0).cast("long"))
    firsts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(STRETCH).cast("long"))
    many = counted.where(F.col("n") > STRETCH).withColumn("first", F.explode(firsts)).repartition("first", *keys)
    both = few.unionByName(many)
    last = F.least(F.col("first") + F.lit(STRETCH), F.col("n")) - 1
    return both.select(*keys, F.explode(F.sequence("first", last)).alias("copy"))

"""All queries of the core by name, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwright.operators.graph import load_graph
from meshwright.plans import coverops, dealt, graphops, sourceops, upkeepops

_MODULES = (dealt, graphops, coverops, upkeepops, sourceops)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radius of a function that much of the project calls."""
    return graphops.impact_of(load_graph(spark, sf_dir), graphops.CALLED)

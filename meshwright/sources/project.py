"""Settings, ignored paths and source files of a project."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of dependencies and builds that are never read.
SKIPPED = (
    ".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", "target", "vendor", "site-packages", ".eggs",
)


@dataclass(frozen=True)
class Settings:
    """What a project may set; a value of the wrong shape falls back to the default."""

    entry_points: tuple[str, ...] = ()
    root_modules: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    hub_metric: str = "transitive_fan_in"
    review_threshold: float = 0.7


def load_settings(path: str | Path, table: str = "meshwright") -> Settings:
    """Settings from a TOML file; an unreadable or missing file gives the defaults."""
    try:
        found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(table, {})
    except (OSError, ValueError):
        return Settings()
    given = {}
    for f in fields(Settings):
        value = found.get(f.name) if isinstance(found, dict) else None
        if isinstance(f.default, tuple) and isinstance(value, list) and all(isinstance(x, str) for x in value):
            given[f.name] = tuple(value)
        elif isinstance(f.default, float) and isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1:
            given[f.name] = float(value)
        elif isinstance(f.default, str) and isinstance(value, str):
            given[f.name] = value
    return Settings(**given)


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: anchored if it holds a slash, else for any segment;
    ``**`` spans segments, what lies below a match matches too."""
    anchored = "/" in pattern.rstrip("/")
    out = []
    for part in re.split(r"(\*\*/?|\*|\?|\[[^\]]*\])", pattern.strip("/")):
        if part in ("**", "**/"):
            out.append("(?:.*/)?" if part == "**/" else ".*")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part.startswith("[") and part.endswith("]") and len(part) > 2:
            out.append("[" + part[1:-1].replace("!", "^", 1).replace("\\", "\\\\") + "]" if part[1] == "!" else part)
        else:
            out.append(re.escape(part))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + "(?:/|$)"


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        if p.strip("/"):
            hit = hit | path.rlike(glob_regex(p))
    return hit


def read_sources(spark: SparkSession, root: str, patterns: tuple[str, ...] = (), extensions: tuple[str, ...] = ("py",)) -> DataFrame:
    """(path, text) of source files below a folder all executors can read; relative paths."""
    suffixes = "{" + ",".join(f"*.{e}" for e in extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(root)
    base = Path(root).as_posix().rstrip("/")
    relative = F.substring_index("path", base + "/", -1).alias("path")
    named = files.select(relative, F.expr("try_validate_utf8(content)").alias("text"))
    return named.where(~ignored(F.col("path"), (*SKIPPED, *patterns)) & F.col("text").isNotNull())


def file_times(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified) of the files below a folder, from their listing alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two listings: added, removed or modified."""
    both = old.withColumnRenamed("modified", "m0").join(new.withColumnRenamed("modified", "m1"), "path", "full")
    change = F.when(F.col("m0").isNull(), "added").when(F.col("m1").isNull(), "removed").when(F.col("m0") != F.col("m1"), "modified")
    return both.select("path", change.alias("change")).where(F.col("change").isNotNull())

"""Readers of recorded runs: line coverage in three formats, per-test artifacts, commit logs."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ids import start_line

#: A span of so many lines is damage, not a span.
LONGEST_SPAN = 1_000_000

_SPAN = re.compile(r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (-?\d+)\s*$")


def _from_json(text: str) -> Iterator[tuple[str, int, int]]:
    try:
        files = json.loads(text).get("files")
        items = files.items()
    except (ValueError, AttributeError, RecursionError):
        return
    for name, info in items:
        lines = info.get("executed_lines") if isinstance(info, dict) else None
        for line in lines if isinstance(lines, list) else ():
            if isinstance(line, bool) or not isinstance(line, (int, str)):
                continue
            try:
                at = int(line)
            except ValueError:
                continue
            yield name, at, at


def _from_lcov(text: str) -> Iterator[tuple[str, int, int]]:
    name = None
    for row in text.splitlines():
        key, _, value = row.partition(":")
        if key == "SF":
            name = value.strip()
        elif row.startswith("end_of_record"):
            name = None
        elif key == "DA" and name is not None:
            parts = value.split(",")
            try:
                if int(parts[1]) > 0:
                    yield name, int(parts[0]), int(parts[0])
            except (ValueError, IndexError):
                continue


def _from_go(text: str) -> Iterator[tuple[str, int, int]]:
    for row in text.splitlines():
        if (m := _SPAN.match(row)) and int(m[4]) > 0 and 0 <= int(m[3]) - int(m[2]) < LONGEST_SPAN:
            yield m[1], int(m[2]), int(m[3])


def line_spans(text: str | None) -> Iterator[tuple[str, int, int]]:
    """(file, first, last) of executed lines; a text of no known format has none."""
    head = (text or "").lstrip()
    if head.startswith("{"):
        return _from_json(head)
    if head.startswith("mode:"):
        return _from_go(head)
    return _from_lcov(head) if "SF:" in head or "TN:" in head else iter(())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("artifact", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    for batch in batches:
        rows: list[tuple] = []
        for name, text in zip(batch.column("artifact").to_pylist(), batch.column("value").to_pylist()):
            for span in line_spans(text):
                rows.append((name, *span))
                if len(rows) == 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def line_coverage(texts: DataFrame) -> DataFrame:
    """(artifact, file, first, last) of executed spans; ``texts``: (artifact, value) whole texts."""
    return texts.select("artifact", "value").mapInArrow(_parse, "artifact string, file string, first long, last long")


def read_line_coverage(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("artifact"), "value")
    return line_coverage(texts)


def executed_nodes(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(snapshot, id) of nodes of whose body a line ran; the line of a definition that spans more
    does not count. Paths must be equal; only if none is, a path that ends in a node's file of at
    least one folder counts."""
    body = nodes.where(F.col("end_line").isNotNull()).withColumn("start", start_line(F.col("location"))).where(F.col("start").isNotNull())
    body = body.select("snapshot", "id", "file", F.when(F.col("start") == F.col("end_line"), F.col("start")).otherwise(F.col("start") + 1).alias("lo"), F.col("end_line").alias("hi"))
    ran = spans.select(F.regexp_replace("file", r"^\./", "").alias("path"), "first", "last").distinct()
    overlap = (F.col("first") <= F.col("hi")) & (F.col("last") >= F.col("lo"))
    files = body.select("file").distinct()
    if not ran.join(files, F.col("path") == F.col("file"), "left_semi").isEmpty():
        return body.join(ran, (F.col("file") == F.col("path")) & overlap).select("snapshot", "id").distinct()
    # every ending of a path with a folder is a key, so this stays an equi-join
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: F.array_join(F.slice(parts, -k, k), "/"))
    tails = ran.where(F.size(parts) >= 2).select(F.explode(F.array_distinct(ends)).alias("path"), "first", "last")
    return body.join(tails, (F.col("file") == F.col("path")) & overlap).select("snapshot", "id").distinct()


def ingest_trace(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """The nodes with the role ``runtime`` on those that were seen to run."""
    hit = executed_nodes(nodes, spans).withColumn("hit", F.lit(True))
    roles = F.when(F.col("hit"), F.array_sort(F.array_union("roles", F.array(F.lit("runtime"))))).otherwise(F.col("roles"))
    return nodes.join(hit, ["snapshot", "id"], "left").withColumn("roles", roles).select(*nodes.columns)


def read_test_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(artifact, format, tests) of per-test JSON artifacts; one that can't be read has no tests."""
    shape = "format string, tests map<string, array<string>>"
    texts = spark.read.text(path, wholetext=True)
    parsed = texts.select(F.input_file_name().alias("artifact"), F.from_json("value", shape).alias("x"))
    none = F.create_map().cast("map<string, array<string>>")
    return parsed.select("artifact", "x.format", F.coalesce("x.tests", none).alias("tests"))


def read_git_log(spark: SparkSession, repository: str, extensions: tuple[str, ...] = (".py",), most: int = 2000) -> DataFrame:
    """(commit_seq, commit_id, file): source files of the last commits that are no merges."""
    command = ["git", "-C", repository, "log", f"-{int(most)}", "--no-merges", "--name-only", "--format=%x00%H"]
    try:
        said = subprocess.run(command, capture_output=True, text=True, timeout=120, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        said = ""
    rows = []
    for seq, entry in enumerate(x for x in said.split("\0") if x.strip()):
        name, *files = entry.split("\n")
        rows += [(seq, name.strip(), f) for f in files if f.endswith(extensions)]
    return spark.createDataFrame(rows, "commit_seq long, commit_id string, file string")

"""One-off import of a graph kept in an SQLite file, in pieces of bounded size."""

from __future__ import annotations

import math
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows held on the driver at a time.
PIECE = 200_000

NODES = "snapshot int, id string, kind string, name string, file string, location string, end_line int, is_stub boolean, arity int, summary string, roles array<string>, ingested_at timestamp"
EDGES = "snapshot int, seq long, src string, relation string, dst_symbol string, dst_id string, weight double, provenance string, source string, name_based boolean, ingested_at timestamp"


def _text(value):
    return value if isinstance(value, str) else None


def _whole(value):
    return value if isinstance(value, int) else None


def _columns(db: sqlite3.Connection, table: str, wanted: list[str]) -> str:
    have = {r[1] for r in db.execute(f"PRAGMA table_info({table})")}
    return ", ".join(c if c in have else f"NULL AS {c}" for c in wanted)


def _nodes(db: sqlite3.Connection, snapshot: int) -> Iterator[tuple]:
    wanted = ["id", "kind", "name", "location", "end_line", "is_stub", "arity", "summary", "roles"]
    for ident, kind, name, location, end, stub, arity, summary, roles in db.execute(f"SELECT {_columns(db, 'nodes', wanted)} FROM nodes"):
        if _text(ident) is not None and _text(name) is not None and _text(kind) is not None:
            yield snapshot, ident, kind, name, ident.split("::")[0], _text(location), _whole(end), bool(stub), _whole(arity), _text(summary), [r for r in (_text(roles) or "").split(",") if r], None


def _edges(db: sqlite3.Connection, snapshot: int) -> Iterator[tuple]:
    wanted = ["src", "relation", "dst_symbol", "dst_id", "weight", "provenance", "source", "name_based"]
    for seq, (src, relation, symbol, dst, weight, prov, source, named) in enumerate(db.execute(f"SELECT {_columns(db, 'edges', wanted)} FROM edges")):
        if _text(src) is not None and _text(relation) is not None and _text(symbol) is not None:
            w = float(weight) if isinstance(weight, (int, float)) and math.isfinite(weight) else None
            yield snapshot, seq, src, relation, symbol, _text(dst), w, _text(prov), _text(source), bool(named), None


def _write(spark: SparkSession, rows: Iterator[tuple], schema: str, path: str) -> DataFrame:
    piece, first = [], True
    for row in rows:
        piece.append(row)
        if len(piece) == PIECE:
            spark.createDataFrame(piece, schema).write.mode("overwrite" if first else "append").parquet(path)
            piece, first = [], False
    if piece or first:
        spark.createDataFrame(piece, schema).write.mode("overwrite" if first else "append").parquet(path)
    return spark.read.parquet(path)


def import_store(spark: SparkSession, database: str, out: str, snapshot: int = 1) -> tuple[DataFrame, DataFrame]:
    """Writes ``nodes.parquet`` and ``edges.parquet`` into ``out``; the database is only read.

    Rows whose id, kind, name, source, relation or symbol is no text are left out, other values of
    a wrong type are null. Columns an older file lacks are null.
    """
    db = sqlite3.connect(f"file:{database}?mode=ro", uri=True)
    try:
        return _write(spark, _nodes(db, snapshot), NODES, f"{out}/nodes.parquet"), _write(spark, _edges(db, snapshot), EDGES, f"{out}/edges.parquet")
    finally:
        db.close()

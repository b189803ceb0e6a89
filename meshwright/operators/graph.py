"""The typed graph: cleaned nodes and deduplicated edges of every snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ids import file_of, is_test_path
from meshwright.runtime import Workspace, input_state, path_exists
from meshwright.tables import node_versions, periods, relation_key, table

# Kinds of nodes.
KINDS = (
    "File", "Module", "Package", "Class", "Function", "Method", "Variable", "Route", "Endpoint", "Handler", "Template",
    "HTMLElement", "ORMModel", "DBTable", "DBColumn", "Query", "Test", "Event",
)
# Relations of edges.
RELATIONS = (
    "CALLS", "IMPORTS", "INHERITS", "READS", "WRITES", "QUERIES", "ROUTES_TO", "RENDERS", "SUBMITS_TO", "MAPS_TO", "RETURNS",
    "REFERENCES", "TESTS", "EMITS", "HANDLES", "RUNTIME_HITS",
)
# Relations along which liveness spreads, kinds of code, roles that make a root.
LIVENESS = ("CALLS", "IMPORTS", "INHERITS", "ROUTES_TO", "REFERENCES", "RENDERS", "EMITS", "HANDLES")
CODE_KINDS = ("Function", "Method", "Class")
ROOT_ROLES = ("exported", "main", "script", "route", "runtime", "callback", "test")
ROOT_KINDS = ("Route", "Endpoint", "Template")


@dataclass
class Graph:
    """``nodes``: one row per (snapshot, id); ``edges``: resolved, one row per (snapshot, src,
    relation, dst_id); ``holes``: unresolved, one row per (snapshot, src, relation, dst_symbol)."""

    nodes: DataFrame
    edges: DataFrame
    holes: DataFrame
    live: DataFrame | None = None

    def adjacency(self, relations: Sequence[str] = LIVENESS, *, confident: bool = False) -> DataFrame:
        """(snapshot, s, d) once per relation between nodes that both exist."""
        if self.live is not None and tuple(relations) == LIVENESS:
            return (self.live.where("confident") if confident else self.live).select("snapshot", "s", "d")
        e = self.edges.where(F.col("relation").isin(list(relations)))
        if confident:
            e = e.where(F.col("provenance") == "extracted")
        ids = self.nodes.select("snapshot", "id")
        e = e.select("snapshot", F.col("src").alias("s"), F.col("dst_id").alias("d"))
        e = e.join(ids.withColumnRenamed("id", "s"), ["snapshot", "s"], "left_semi")
        return e.join(ids.withColumnRenamed("id", "d"), ["snapshot", "d"], "left_semi").select("snapshot", "s", "d")


def is_test_node() -> Column:
    """Owned by the test-suite: by kind, role or path."""
    return (F.col("kind") == "Test") | F.array_contains("roles", "test") | is_test_path(F.col("id"))


def clean_nodes(nodes: DataFrame, shared: DataFrame, order: Sequence[int]) -> DataFrame:
    """Nodes of every snapshot, the shared ones in each; rows without id, name or known kind drop out."""
    columns = ("kind", "name", "location", "end_line", "is_stub", "arity", "summary", "roles")
    own = node_versions(nodes, columns).select("snapshot", "id", *columns)
    times = F.explode(F.array(*[F.lit(p).cast("int") for p in order])).alias("snapshot")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("end_line", "int"), ("is_stub", "boolean"), ("arity", "int"), ("summary", "string"))]
    common = shared.select(times, "id", "kind", "name", "location", *none[:3], none[3], F.array_sort(F.array_distinct("roles")).alias("roles"))
    both = own.unionByName(common.select(own.columns))
    known = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("kind").isin(list(KINDS))
    return both.where(known).withColumn("is_stub", F.coalesce("is_stub", F.lit(False))).withColumn("file", file_of(F.col("id")))


def clean_edges(edges: DataFrame) -> DataFrame:
    """Rows with a known relation; no usable weight counts as 1, no known provenance as ambiguous."""
    weight = F.col("weight")
    usable = weight.isNotNull() & ~F.isnan(weight) & (F.abs(weight) < F.lit(float("inf")))
    prov = F.when(F.col("provenance").isin("extracted", "inferred", "ambiguous"), F.col("provenance")).otherwise("ambiguous")
    named = edges.withColumn("relation", relation_key()).where(F.col("relation").isin(list(RELATIONS)) & F.col("src").isNotNull() & F.col("dst_symbol").isNotNull())
    return named.withColumn("weight", F.when(usable, weight).otherwise(F.lit(1.0))).withColumn("provenance", prov).withColumn("name_based", F.coalesce("name_based", F.lit(False)))


def dedup_resolved(edges: DataFrame) -> DataFrame:
    """One row per (snapshot, src, relation, dst_id): the greatest weight, then the first seen;
    ``name_based`` if any row is. A call subsumes a mere reference, a reference to itself is none."""
    rest = ("dst_symbol", "provenance", "source")
    best = F.max(F.struct("weight", (-F.col("seq")).alias("order"), *rest)).alias("x")
    one = edges.where(F.col("dst_id").isNotNull()).groupBy("snapshot", "src", "relation", "dst_id").agg(best, F.max("name_based").alias("name_based"))
    one = one.select("snapshot", "src", "relation", "dst_id", "x.weight", "x.dst_symbol", "x.provenance", "x.source", (-F.col("x.order")).alias("seq"), "name_based")
    reference = F.col("relation") == "REFERENCES"
    calls = one.where(F.col("relation") == "CALLS").select("snapshot", "src", "dst_id")
    refs = one.where(reference & (F.col("src") != F.col("dst_id"))).join(calls, ["snapshot", "src", "dst_id"], "left_anti")
    return one.where(~reference).unionByName(refs)


def dedup_holes(edges: DataFrame) -> DataFrame:
    """Unresolved references, repeated rows of one reference once."""
    holes = edges.where(F.col("dst_id").isNull())
    return holes.groupBy("snapshot", "src", "relation", "dst_symbol").agg(F.max("name_based").alias("name_based"), F.min("seq").alias("seq"))


def build_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph as plans over the tables, nothing run yet."""
    edges = clean_edges(table(spark, sf_dir, "edges"))
    nodes = clean_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "shared_nodes"), periods(spark, sf_dir))
    return Graph(nodes, dedup_resolved(edges), dedup_holes(edges))


def store_graph(graph: Graph) -> Graph:
    """The graph written to the shared folder, with the adjacency along which liveness spreads.

    Files are sorted by relation, so that a query for few relations skips most row groups.
    """
    ws = Workspace(graph.nodes.sparkSession, "graph")
    nodes = ws.write(graph.nodes, "nodes")
    edges = ws.write(graph.edges.sortWithinPartitions("relation", "src"), "edges")
    holes = ws.write(graph.holes, "holes")
    ids = nodes.select("snapshot", "id")
    live = edges.where(F.col("relation").isin(list(LIVENESS))).select("snapshot", F.col("src").alias("s"), F.col("dst_id").alias("d"), (F.col("provenance") == "extracted").alias("confident"))
    for end in ("s", "d"):
        live = live.join(ids.withColumnRenamed("id", end), ["snapshot", end], "left_semi")
    return Graph(nodes, edges, holes, ws.write(live, "live"))


def load_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored graph of some tables: built once per session and state of their files."""
    held = spark.sparkContext.__dict__.setdefault("_meshwright_graphs", {})
    key = input_state(spark, [f"{sf_dir}/{t}.parquet" for t in ("nodes", "edges", "shared_nodes", "snapshots")])
    if key not in held or not all(path_exists(spark, path) for path, _ in held[key]):
        made = store_graph(build_graph(spark, sf_dir))
        held[key] = [(df._meshwright_path, df.schema) for df in (made.nodes, made.edges, made.holes, made.live)]
    return Graph(*(spark.read.schema(schema).parquet(path) for path, schema in held[key]))


def roots(nodes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """(snapshot, id) of entry points: by role, kind or name, and the module of every file that
    owns one; where files of a directory start together, of every file in the directory."""
    kind = F.col("kind").isin(list(ROOT_KINDS))
    role = F.arrays_overlap("roles", F.array(*[F.lit(r) for r in ROOT_ROLES]))
    own = nodes.where(kind | role | F.col("id").isin(list(extra))).select("snapshot", "id", "file")
    together = F.endswith(F.col("file"), F.lit(".go"))
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    files = own.select("snapshot", "file").distinct()
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"(?<=.)\.[^.]*$", "")
    load = nodes.where((F.col("kind") == "Module") | (F.col("id") == F.concat("file", F.lit("::"), stem)))
    by_file = load.join(files, ["snapshot", "file"], "left_semi").select("snapshot", "id")
    folders = files.where(together).select("snapshot", folder.alias("folder")).distinct()
    modules = nodes.where((F.col("kind") == "Module") & together).select("snapshot", "id", folder.alias("folder"))
    by_folder = modules.join(folders, ["snapshot", "folder"], "left_semi").select("snapshot", "id")
    return own.select("snapshot", "id").unionByName(by_file).unionByName(by_folder).distinct()

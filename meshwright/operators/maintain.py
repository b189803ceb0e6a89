"""Upkeep of the graph: binding names, widening, overrides, compression, replacing a file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.ids import file_of, language_of, owner_of, set_signature
from meshwright.operators import forest
from meshwright.operators.graph import Graph
from meshwright.runtime import Workspace

EDGE_COLUMNS = ("snapshot", "src", "relation", "dst_symbol", "dst_id", "weight", "provenance", "source", "name_based")


def name_candidates(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """``references`` (snapshot, src, relation, dst_symbol, ...) joined with every node of that
    name: a module only for imports, and only nodes of the referring file's language, unless one
    of the two languages is not known. Adds ``cand`` and ``n``, the number of candidates."""
    named = nodes.select("snapshot", F.col("name").alias("dst_symbol"), F.col("id").alias("cand"), (F.col("kind") == "Module").alias("module"), language_of(F.col("id")).alias("lang_b"))
    with_lang = references.withColumn("lang_a", language_of(F.col("src")))
    fits = (F.col("lang_a").isNull() | F.col("lang_b").isNull() | (F.col("lang_a") == F.col("lang_b"))) & (~F.col("module") | (F.col("relation") == "IMPORTS"))
    hit = with_lang.join(named, ["snapshot", "dst_symbol"]).where(fits).drop("module", "lang_a", "lang_b")
    n = hit.groupBy("snapshot", "src", "relation", "dst_symbol").agg(F.count(F.lit(1)).alias("n"))
    return hit.join(n, ["snapshot", "src", "relation", "dst_symbol"])


def resolve_holes(graph: Graph) -> DataFrame:
    """Edges for the holes whose name is known by now: one match binds, several fan out."""
    hit = name_candidates(graph.nodes, graph.holes.select("snapshot", "src", "relation", "dst_symbol"))
    return hit.select(
        "snapshot", "src", "relation", "dst_symbol", F.col("cand").alias("dst_id"), F.round(F.lit(1.0) / F.col("n"), 3).alias("weight"), F.when(F.col("n") > 1, "ambiguous").otherwise("inferred").alias("provenance")
    )


def redundant_holes(graph: Graph) -> DataFrame:
    """Holes that a resolved edge of the same reference and kind already covers."""
    key = ["snapshot", "src", "relation", "dst_symbol", "name_based"]
    return graph.holes.select(*key).join(graph.edges.select(*key), key, "left_semi")


def dangling(graph: Graph) -> DataFrame:
    """Edges resolved by name whose target is gone, or is a module though nothing is imported."""
    named = graph.edges.where("name_based")
    ids = graph.nodes.select("snapshot", F.col("id").alias("dst_id"))
    modules = graph.nodes.where(F.col("kind") == "Module").select("snapshot", F.col("id").alias("dst_id"))
    lost = named.join(ids, ["snapshot", "dst_id"], "left_anti")
    wrong = named.where(F.col("relation") != "IMPORTS").join(modules, ["snapshot", "dst_id"], "left_semi")
    return lost.unionByName(wrong).select("snapshot", "src", "relation", "dst_symbol", "dst_id")


def rewiden(graph: Graph) -> DataFrame:
    """What the edges resolved by name become against the present nodes: all candidates at weight
    1/n, or the single one left, inferred. Groups that are right already are not listed."""
    group = ["snapshot", "src", "relation", "dst_symbol"]
    named = graph.edges.where("name_based").select(*group, "dst_id", "weight", "provenance")
    states = named.groupBy(*group).agg(F.count(F.lit(1)).alias("k"), F.max((F.col("provenance") == "ambiguous").cast("int")).alias("any_guess"), F.min((F.col("provenance") == "ambiguous").cast("int")).alias("all_guess"), F.min("weight").alias("w0"), F.max("weight").alias("w1"))
    cands = name_candidates(graph.nodes, states.select(*group)).select(*group, F.col("cand").alias("dst_id"), "n")
    w = F.round(F.lit(1.0) / F.col("n"), 3)
    both = cands.join(named.select(*group, "dst_id", F.lit(1).alias("there")), [*group, "dst_id"], "left")
    same = both.groupBy(*group, "n").agg(F.count("there").alias("there")).join(states, group)
    right = (F.col("there") == F.col("n")) & (F.col("k") == F.col("n")) & (F.col("all_guess") == 1) & (F.col("w0") == w) & (F.col("w1") == w)
    stays = F.when(F.col("n") > 1, right).otherwise((F.col("k") == 1) & (F.col("any_guess") == 0))
    moved = same.where(~stays).select(*group)
    out = cands.join(moved, group, "left_semi")
    return out.select(*group, "dst_id", w.alias("weight"), F.when(F.col("n") > 1, "ambiguous").otherwise("inferred").alias("provenance"))


def override_edges(graph: Graph, *, circular: bool = False) -> DataFrame:
    """Edges that a call or reference to ``Base.m`` also has to every existing ``Sub.m``, where Sub
    is below Base, however far; those that exist are left out. They are ambiguous, not by name.

    Subs whose bases lead round in a circle are told apart: ``circular`` gives their edges instead.
    """
    classes = graph.nodes.where(F.col("kind") == "Class").select("snapshot", "id")
    links = graph.edges.where((F.col("relation") == "INHERITS") & (F.col("src") != F.col("dst_id"))).select("snapshot", "src", "dst_id")
    for end in ("src", "dst_id"):
        links = links.join(classes.withColumnRenamed("id", end), ["snapshot", end], "left_semi")
    found = forest.hierarchy(links, "snapshot", "src", "dst_id", paths=not circular)
    below = forest.circular_descendants(found, "snapshot", "src", "dst_id") if circular else forest.descendants(found.nodes, "snapshot")
    uses = graph.edges.where(F.col("relation").isin("CALLS", "REFERENCES")).select("snapshot", "src", "relation", "dst_id")
    members = uses.select("snapshot", "dst_id").distinct().select("snapshot", "dst_id", owner_of(F.col("dst_id")).alias("owner"), F.substring_index("dst_id", ".", -1).alias("member"))
    pairs = members.where(F.col("owner").isNotNull()).join(below.select("snapshot", F.col("id").alias("owner"), "descendant_id"), ["snapshot", "owner"])
    pairs = pairs.select("snapshot", "dst_id", F.concat("descendant_id", F.lit("."), "member").alias("override"), "member").where("override <> dst_id")
    pairs = pairs.join(graph.nodes.select("snapshot", F.col("id").alias("override")), ["snapshot", "override"], "left_semi")
    new = uses.join(pairs, ["snapshot", "dst_id"]).select("snapshot", "src", "relation", F.col("member").alias("dst_symbol"), F.col("override").alias("dst_id")).distinct()
    return new.join(uses, ["snapshot", "src", "relation", "dst_id"], "left_anti").select("snapshot", "src", "relation", "dst_symbol", "dst_id")


@dataclass
class Compressed:
    """``flat``: edges that stay; ``groups``: one row per fan-out with its ``set_id``; ``sets``:
    (set_id, members) each set of targets once."""

    flat: DataFrame
    groups: DataFrame
    sets: DataFrame


def compress(edges: DataFrame) -> Compressed:
    """Fan-outs of two or more guesses that differ in nothing but the target, with interned sets."""
    group = ["snapshot", "src", "relation", "dst_symbol"]
    shape = edges.groupBy(*group).agg(
        F.count(F.lit(1)).alias("k"), F.min((F.col("provenance") == "ambiguous").cast("int")).alias("guess"),
        F.min("weight").alias("weight"), F.max("weight").alias("w1"), F.min("source").alias("source"), F.max("source").alias("s1"), F.count("source").alias("sn"),
        F.min("name_based").alias("name_based"), F.max("name_based").alias("n1"), F.sort_array(F.collect_set("dst_id")).alias("members"),
    )
    fits = (F.col("k") >= 2) & (F.col("guess") == 1) & (F.col("weight") == F.col("w1")) & (F.col("sn") == F.col("k")) & (F.col("source") == F.col("s1")) & (F.col("name_based") == F.col("n1")) & (F.size("members") == F.col("k"))
    made = shape.where(fits).withColumn("set_id", set_signature(F.col("members")))
    flat = edges.join(made.select(*group), group, "left_anti").select(*EDGE_COLUMNS)
    sets = made.groupBy("set_id").agg(F.first("members").alias("members"))
    return Compressed(flat, made.select(*group, "set_id", "weight", "source", "name_based"), sets)


def expand(packed: Compressed) -> DataFrame:
    """All edges again: what is flat and every group with each member of its set."""
    arms = packed.groups.join(packed.sets, "set_id").withColumn("dst_id", F.explode("members")).withColumn("provenance", F.lit("ambiguous"))
    return packed.flat.unionByName(arms.select(*EDGE_COLUMNS))


def replace_files(graph: Graph, changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The graph after some files were read again: (snapshot, file) pairs name them.

    Rows of the files go, the new ones come, edges by name that lost their target open again and
    then, like all holes, are held against the names of today. One whole pass of joins instead of a
    walk from row to row; applied to all files it is the full build.
    """
    ws = Workspace(graph.nodes.sparkSession, "replace")
    keys, group = ["snapshot", "file"], ["snapshot", "src", "relation", "dst_symbol"]
    hole = [*group, "name_based"]
    kept = graph.nodes.join(changed, keys, "left_anti")
    now = ws.write(kept.unionByName(nodes.select(*kept.columns)), "nodes")
    keep = lambda df: df.withColumn("file", file_of(F.col("src"))).join(changed, keys, "left_anti").drop("file")
    flat = ws.write(keep(graph.edges).select(*EDGE_COLUMNS).unionByName(edges.where(F.col("dst_id").isNotNull()).select(*EDGE_COLUMNS)), "edges")
    holes = keep(graph.holes).select(*hole).unionByName(edges.where(F.col("dst_id").isNull()).select(*hole))

    opened = ws.write(dangling(Graph(now, flat, holes)).distinct(), "opened")
    closed = ws.write(flat.join(opened, [*group, "dst_id"], "left_anti"), "closed")
    holes = ws.write(holes.unionByName(opened.select(*group, F.lit(True).alias("name_based"))).distinct(), "holes")
    gone = redundant_holes(Graph(now, closed, holes)).distinct()
    state = Graph(now, closed, ws.write(holes.join(gone, hole, "left_anti"), "holes"))
    bound = ws.write(resolve_holes(state), "bound")
    rest = state.holes.join(bound.select(*group), group, "left_anti")
    more = [*group, "dst_id", "weight", "provenance", F.lit("names").alias("source"), F.lit(True).alias("name_based")]
    both = ws.write(closed.unionByName(bound.select(*more).select(*EDGE_COLUMNS)), "both")
    wide = ws.write(rewiden(Graph(now, both, rest)), "wide")
    redone = wide.select(*group).distinct()
    stays = both.where(~F.col("name_based")).unionByName(both.where("name_based").join(redone, group, "left_anti").select(*EDGE_COLUMNS))
    merged = stays.unionByName(wide.select(*more).select(*EDGE_COLUMNS))
    rest_of = [c for c in EDGE_COLUMNS if c not in ("snapshot", "src", "relation", "dst_id", "weight")]
    best = F.min(F.struct((-F.col("weight")).alias("w"), *rest_of)).alias("x")
    one = merged.groupBy("snapshot", "src", "relation", "dst_id").agg(best).select("snapshot", "src", "relation", "dst_id", (-F.col("x.w")).alias("weight"), *[f"x.{c}" for c in rest_of])
    return Graph(now, one.select(*EDGE_COLUMNS), rest)


def sync_exported(nodes: DataFrame, exported: DataFrame) -> DataFrame:
    """Nodes whose role ``exported`` is just that of the (snapshot, id) rows of ``exported``."""
    marked = nodes.join(exported.select("snapshot", "id", F.lit(True).alias("mark")).distinct(), ["snapshot", "id"], "left")
    with_ = F.array_sort(F.array_union("roles", F.array(F.lit("exported"))))
    return marked.withColumn("roles", F.when(F.col("mark"), with_).otherwise(F.array_remove("roles", "exported"))).select(*nodes.columns)

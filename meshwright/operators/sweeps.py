"""Sweeps over the graph: closures, ranks, components, circles and paths, by rounds of joins.

A round writes its result to the shared folder, so plans stay short and lost executors cost one
round; the same job tells how many rows it found. Edges are laid out by their start once, so that
a round moves the frontier and not the graph. All sweeps run over all snapshots at once, keyed by
(snapshot, id). With ``local_edges``, a graph of at most so many edges is swept by the kernels
instead, one task per snapshot; but for ``lane_reach`` the default is the rounds, at every size.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.operators import kernels
from meshwright.operators.kernels import LOCAL_EDGES
from meshwright.runtime import Workspace, lay_out

#: Written frontiers after which what was seen is put together into one table.
COMPACT = 16


def _in_one_task(left: DataFrame, right: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """A kernel over each snapshot's rows of two tables."""
    kind = left.schema["snapshot"].dataType.simpleString()
    return left.groupBy("snapshot").cogroup(right.groupBy("snapshot")).applyInPandas(kernel, f"snapshot {kind}, {columns}")


def _fits(edges: DataFrame, local_edges: int) -> bool:
    return local_edges > 0 and edges.count() <= local_edges


def reverse(adj: DataFrame) -> DataFrame:
    return adj.select("snapshot", F.col("d").alias("s"), F.col("s").alias("d"))


def reach(adj: DataFrame, seeds: DataFrame, *, rounds: int | None = None, local_edges: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """(snapshot, by..., id, hops): all that can be reached from the seeds, themselves included.

    ``adj``: (snapshot, by..., s, d); ``seeds``: (snapshot, by..., id). ``by`` names what keeps
    several sweeps apart that run in the same rounds. The frontier alone is joined in a round, and
    what was seen before is taken out of it, so every edge is followed once.
    """
    ws = Workspace(adj.sparkSession, "reach")
    keys = ["snapshot", *by]
    if rounds is None and not by and _fits(adj, local_edges):
        start = seeds.select("snapshot", "id").distinct()
        return ws.write(_in_one_task(adj.distinct(), start, kernels.reach, "id string, hops int"), "reached")
    links = lay_out(adj.select(*keys, "s", "d"), *keys, "s")
    frontier, found = ws.write_counted(seeds.select(*keys, "id", F.lit(0).alias("hops")).distinct(), "frontier")
    seen, hops = [frontier], 0
    while found["n"] and (rounds is None or hops < rounds):
        hops += 1
        if len(seen) == COMPACT:
            seen = [ws.write(ws.together(seen), "seen")]
        known = ws.together(seen).select(*keys, "id")
        step = frontier.select(*keys, F.col("id").alias("s")).join(links, [*keys, "s"]).select(*keys, F.col("d").alias("id")).distinct()
        frontier, found = ws.write_counted(step.join(known, [*keys, "id"], "left_anti").select(*keys, "id", F.lit(hops).alias("hops")), "frontier")
        seen.append(frontier)
    links.unpersist()
    return ws.together(seen)


def lane_reach(adj: DataFrame, seeds: DataFrame, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(snapshot, word, id, mask): closures of many groups at once, 64 of them to a word.

    The rows follow groups times nodes, not edges, so here the kernel is the default for graphs of
    few edges; ``local_edges`` = 0 takes the rounds at every size.

    ``seeds``: (snapshot, word, id, mask), a bit for each group that starts at the id. Only bits
    that are new at a node go on to the next round.
    """
    ws = Workspace(adj.sparkSession, "lanes")
    keys = ["snapshot", "word", "id"]
    if _fits(adj, local_edges):
        return ws.write(_in_one_task(adj.distinct(), seeds.select(*keys, "mask"), kernels.lane_reach, "word long, id string, mask long"), "seen")
    links = lay_out(adj.select("snapshot", "s", "d").distinct(), "snapshot", "s")
    frontier, found = ws.write_counted(seeds.groupBy(*keys).agg(F.bit_or("mask").alias("mask")), "seen")
    seen = [frontier]

    def whole() -> DataFrame:
        return ws.together(seen).groupBy(*keys).agg(F.bit_or("mask").alias("mask"))

    while found["n"]:
        step = frontier.withColumnRenamed("id", "s").join(links, ["snapshot", "s"])
        step = step.groupBy("snapshot", "word", F.col("d").alias("id")).agg(F.bit_or("mask").alias("mask"))
        if len(seen) == COMPACT:
            seen = [ws.write(whole(), "seen")]
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new = step.join(whole().withColumnRenamed("mask", "old"), keys, "left").select(*keys, fresh.alias("mask")).where("mask <> 0")
        frontier, found = ws.write_counted(new, "frontier")
        seen.append(frontier)
    links.unpersist()
    return ws.write(whole(), "seen")


def lane_counts(adj: DataFrame, lanes: DataFrame, *, by_node: bool, chunk: int = 16_384) -> DataFrame:
    """Sizes of the closures of many lanes, without their rows (``kernels.lane_counts``).

    ``lanes``: (snapshot, lane, id, seed). Returns (snapshot, id, n, hit) by node, or (snapshot,
    lane, n, hit). A task has a snapshot's edges, with numbers for ids, and ``chunk`` lanes.
    """
    ws = Workspace(adj.sparkSession, "lane-counts")
    kind = adj.schema["snapshot"].dataType.simpleString()
    links, lanes = ws.write(adj.select("snapshot", "s", "d").distinct(), "links"), ws.write(lanes.select("snapshot", "lane", "id", "seed"), "lanes")
    ids = links.select("snapshot", F.explode(F.array("s", "d")).alias("id")).unionByName(lanes.select("snapshot", "id")).distinct()
    codes = ws.write(ids.withColumn("code", F.monotonically_increasing_id()), "codes")
    placed = lanes.join(codes, ["snapshot", "id"]).select("snapshot", F.floor(F.col("lane") / chunk).alias("chunk"), "lane", "code", "seed")
    coded = links.join(codes.withColumnsRenamed({"id": "s", "code": "a"}), ["snapshot", "s"]).join(codes.withColumnsRenamed({"id": "d", "code": "b"}), ["snapshot", "d"])
    coded = ws.write(coded.select("snapshot", F.col("a").alias("s"), F.col("b").alias("d")), "coded")
    chunks = ws.write(placed, "placed").select("snapshot", "chunk").distinct()
    left = coded.join(F.broadcast(chunks), "snapshot").groupBy("snapshot", "chunk")
    right = placed.groupBy("snapshot", "chunk")

    def run(edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = kernels.lane_counts(edges, own, by_node)
        found["snapshot"] = own["snapshot"].iloc[0]
        return found[["snapshot", "key", "n", "hit"]]

    out = ws.write(left.cogroup(right).applyInPandas(run, f"snapshot {kind}, key long, n long, hit long"), "counts")
    if not by_node:
        return out.withColumnRenamed("key", "lane")
    sums = out.groupBy("snapshot", F.col("key").alias("code")).agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return sums.join(codes, ["snapshot", "code"]).select("snapshot", "id", "n", "hit")


def lanes(groups: DataFrame, key: str = "group") -> DataFrame:
    """Numbers (snapshot, group, id) seeds by group: adds ``word`` and ``mask``.

    Numbers follow the order of groups; they are given per range, so no task sorts all groups.
    """
    spark = groups.sparkSession
    ws = Workspace(spark, "lane-numbers")
    names = ws.write(groups.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()), "names")
    counts = {r["part"]: r["count"] for r in names.groupBy("part").count().collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    if not starts:
        return groups.withColumn("number", F.lit(0).cast("long")).withColumn("word", F.lit(0).cast("long")).withColumn("mask", F.lit(0).cast("long")).limit(0)
    at = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    base = spark.createDataFrame(starts, "part int, base long")
    numbered = names.join(F.broadcast(base), "part").select(key, (F.col("base") + at).alias("number"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("number") % 64).cast("int"))
    return groups.join(numbered, key).withColumn("word", F.floor(F.col("number") / 64)).withColumn("mask", bit)


def pagerank(nodes: DataFrame, adj: DataFrame, *, damping: float = 0.85, rounds: int = 40, every: int = 4, local_edges: int = 0) -> DataFrame:
    """(snapshot, id, rank) after a fixed number of rounds from a uniform start.

    Parallel edges count as often as they come; the mass of nodes without edges out is not handed
    on. ``adj`` keeps its multiplicity. Links lie by their start and nodes by their id, so a round
    moves sums once; ranks are written every few rounds.
    """
    ws = Workspace(nodes.sparkSession, "pagerank")
    adj = adj.select("snapshot", "s", "d")
    if _fits(adj, local_edges):
        return _in_one_task(nodes.select("snapshot", "id"), adj, lambda n, a: kernels.pagerank(n, a, damping, rounds), "id string, rank double")
    size = nodes.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    base = lay_out(nodes.select("snapshot", "id").join(F.broadcast(size), "snapshot"), "snapshot", "id")
    out = adj.groupBy("snapshot", "s").agg(F.count(F.lit(1)).alias("out"))
    links = adj.groupBy("snapshot", "s", "d").agg(F.count(F.lit(1)).alias("m")).join(out, ["snapshot", "s"])
    links = lay_out(links.select("snapshot", F.col("s").alias("id"), "d", (F.col("m") / F.col("out")).alias("w")), "snapshot", "id")
    ranks = base.select("snapshot", "id", (F.lit(1.0) / F.col("n")).alias("rank"))
    for i in range(rounds):
        given = links.join(ranks, ["snapshot", "id"]).groupBy("snapshot", F.col("d").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("x"))
        ranks = base.join(given, ["snapshot", "id"], "left").select(
            "snapshot", "id", (F.lit(1 - damping) / F.col("n") + F.lit(damping) * F.coalesce("x", F.lit(0.0))).alias("rank")
        )
        if (i + 1) % every == 0 or i == rounds - 1:
            ranks = ws.write(ranks, "ranks")
    base.unpersist()
    links.unpersist()
    return ranks


def components(nodes: DataFrame, adj: DataFrame, *, local_edges: int = 0) -> DataFrame:
    """(snapshot, id, component): weak components, each named by its least id.

    A round takes the least label among neighbours and then follows the label's own label, which
    shortens long ways by half.
    """
    ws = Workspace(nodes.sparkSession, "components")
    both = adj.unionByName(reverse(adj)).where("s <> d").distinct()
    if _fits(both, local_edges):
        return _in_one_task(nodes.select("snapshot", "id"), both, kernels.components, "id string, component string")
    links = lay_out(both, "snapshot", "s")
    labels, moved = ws.write(nodes.select("snapshot", "id", F.col("id").alias("label")), "labels"), 1
    while moved:
        around = links.join(labels.withColumnRenamed("id", "s"), ["snapshot", "s"]).groupBy("snapshot", F.col("d").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(around, ["snapshot", "id"], "left").select("snapshot", "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = least.select("snapshot", F.col("id").alias("label"), F.col("label").alias("further"))
        step = least.join(jump, ["snapshot", "label"], "left").select("snapshot", "id", F.least("label", "further").alias("label"), "old")
        step, seen = ws.write_counted(step, "labels", moved=F.count_if(F.col("label") != F.col("old")))
        ws.drop(labels)
        labels, moved = step.drop("old"), seen["moved"]
        labels._meshwright_path = step._meshwright_path
    links.unpersist()
    return labels.select("snapshot", "id", F.col("label").alias("component"))


def best_paths(edges: DataFrame, seeds: DataFrame, *, local_edges: int = 0) -> DataFrame:
    """(snapshot, id, score, hops, path): the way of the greatest product of weights to each node.

    ``edges``: (snapshot, s, d, w) with 0 < w <= 1; ``seeds``: (snapshot, id). Rounds relax the
    nodes that improved; equal products keep the shorter way, then the lesser path. Products are
    taken from the seed on, so a way has one product and the rounds end.
    """
    ws = Workspace(edges.sparkSession, "paths")
    edges = ws.write(edges.groupBy("snapshot", "s", "d").agg(F.max("w").alias("w")), "edges")
    if _fits(edges, local_edges):
        return _in_one_task(edges, seeds.select("snapshot", "id").distinct(), kernels.best_paths, "id string, score double, hops int, path array<string>")
    links = lay_out(edges, "snapshot", "s")
    start = seeds.select("snapshot", "id", F.lit(-1.0).alias("k"), F.lit(0).alias("hops"), F.array("id").alias("path")).distinct()
    frontier, found = ws.write_counted(start, "frontier")
    seen = [frontier]

    def best() -> DataFrame:
        return ws.together(seen).groupBy("snapshot", "id").agg(F.min(F.struct("k", "hops", "path")).alias("x"))

    while found["n"]:
        step = frontier.withColumnRenamed("id", "s").join(links, ["snapshot", "s"]).where(~F.array_contains("path", F.col("d")))
        way = F.struct((F.col("k") * F.col("w")).alias("k"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("d")).alias("path"))
        step = step.groupBy("snapshot", F.col("d").alias("id")).agg(F.min(way).alias("y"))
        if len(seen) == COMPACT:
            seen = [ws.write(best().select("snapshot", "id", "x.*"), "best")]
        new = step.join(best(), ["snapshot", "id"], "left").where(F.col("x").isNull() | (F.col("y") < F.col("x"))).select("snapshot", "id", "y.*")
        frontier, found = ws.write_counted(new, "frontier")
        seen.append(frontier)
    links.unpersist()
    return ws.write(best().select("snapshot", "id", (-F.col("x.k")).alias("score"), "x.hops", "x.path"), "best")

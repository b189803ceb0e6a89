"""Parent-child links to full hierarchies.

Weighted disjoint-set forests, merged hierarchically. Links are cut into ranges of ids; a task
folds those of its range into a forest whose entries hold the offset to their local top. Of these
forests only the entries that are tops elsewhere go on to the next level, as links that skip what
was folded already, and there ``FAN_IN`` ranges meet in one task; so levels shrink up to one
forest. Going back down, an entry looks up its top one level above once. Where a level is still
too large for a task and no longer shrinks, doubling takes over: an open top is looked up among
all entries of the level, and a chain of length n needs log2(n) such rounds at most. Circles show
up when a link meets its own top, in the doubling when a round resolves nothing more.

Only nodes that have a parent and are one take part in merging; leaves are resolved by a single
lookup of their parent, roots are known beforehand. The hot case, a base with a third of all
classes below it, is therefore never a key of the iterated joins on its leaves, and the lookup
takes hot bases apart (``lookups``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.lookups import look_up
from meshwright.runtime import Workspace

#: Links folded by one task at most; forests of the first level at least; forests merged into one.
LINKS_PER_PARTITION, LEAST_FORESTS, FAN_IN = 400_000, 16, 4

OPEN, ROOTED, CIRCLE = "open", "rooted", "circle"


class WeightedForest:
    """Disjoint sets over links child -> parent with offsets to the top of each set.

    Every child has one parent, so a child is the top of its own set until it is linked. A link
    may stand for several: ``links`` of them, ``least`` the smallest child among these, ``passed``
    the ids from the first parent up to ``parent``.
    """

    def __init__(self) -> None:
        self.link_of: dict = {}
        self.above: dict = {}
        self.circles: dict = {}

    def find(self, x) -> tuple:
        """(top, number of links to it, smallest entry on the way without the top)."""
        trail = []
        at = x
        while (step := self.above.get(at)) is not None:
            trail.append((at, step))
            at = step[0]
        top, offset, low = at, 0, None
        for entry, (_, links, least) in reversed(trail):
            offset += links
            low = least if low is None or least < low else low
            self.above[entry] = (top, offset, low)
        return top, offset, low

    def add(self, child, parent, links: int = 1, least=None, passed: list | None = None) -> None:
        least = child if least is None else least
        self.link_of[child] = (parent, least, passed)
        top, _, _ = self.find(parent)
        if top == child:
            at = parent
            while at != child:
                at, low, _ = self.link_of[at]
                least = min(least, low)
            self.circles[child] = least
        else:
            self.above[child] = (parent, links, least)

    def close(self, child, least: str) -> None:
        """A child known to lead into the circle with this least id."""
        self.link_of[child] = (child, least, None)
        self.circles[child] = least

    def walk(self, child, top) -> list:
        """Ids from the parent of ``child`` to ``top``."""
        out, at = [], child
        while at != top:
            at, _, passed = self.link_of[at]
            out += [at] if passed is None else passed
        return out


def _fold(paths: bool):
    names = ["g", "c", "top", "off", "lo", "state"] + ["seg"] * paths
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.string())] * paths
    schema = pa.schema(list(zip(names, kinds)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = WeightedForest()
        for batch in batches:
            for g, c, top, off, lo, state, *seg in zip(*(batch.column(k).to_pylist() for k in names)):
                if state == CIRCLE:
                    forest.close((g, c), top)
                else:
                    forest.add((g, c), (g, top), off, lo, *seg)
        rows = []
        for entry in forest.link_of:
            top, off, low = forest.find(entry)
            if top in forest.circles:
                row = [*entry, forest.circles[top], -1, None, CIRCLE] + [None] * paths
            else:
                row = [*entry, top[1], off, low, OPEN]
                if paths:
                    row.append(forest.walk(entry, top))
            rows.append(row)
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], schema=schema)

    return fold


def _merge(cur: DataFrame, known: DataFrame, paths: bool) -> DataFrame:
    """Look up every open top among ``known`` entries; a top that is none of them is a root."""
    still = cur.where(F.col("state") == OPEN)
    done = cur.where(F.col("state") != OPEN)
    at = known.select("g", F.col("c").alias("top"), F.col("top").alias("top2"), *[F.col(x).alias(x + "2") for x in ("off", "lo", "state", *["seg"] * paths)])
    hit = F.col("state2").isNotNull()
    into_circle = hit & (F.col("state2") == CIRCLE)
    moved = look_up(still, at, ["g", "top"], "left").select(
        "g",
        "c",
        F.when(hit, F.col("top2")).otherwise(F.col("top")).alias("top"),
        F.when(into_circle, F.lit(-1)).when(hit, F.col("off") + F.col("off2")).otherwise(F.col("off")).cast("long").alias("off"),
        F.least("lo", "lo2").alias("lo"),
        F.when(hit, F.col("state2")).otherwise(F.lit(ROOTED)).alias("state"),
        *[F.when(into_circle, F.lit(None)).when(hit, F.concat("seg", "seg2")).otherwise(F.col("seg")).alias("seg")] * paths,
    )
    return done.unionByName(moved)


def _double(ws: Workspace, cur: DataFrame, paths: bool) -> DataFrame:
    """All entries of a level resolved by lookups among themselves."""
    left = cur.where(F.col("state") == OPEN).count()
    while left:
        step = ws.write(_merge(cur, cur, paths), "merge")
        cur, before, left = step, left, step.where(F.col("state") == OPEN).count()
        if left == before:
            return ws.write(_close_circles(ws, cur, paths), "closed")
    return cur


def _resolve(ws: Workspace, links: DataFrame, paths: bool, per_task: int) -> DataFrame:
    """Top, offset and state of every link, by levels of forests."""
    kinds = "g string, c string, top string, off long, lo string, state string" + ", seg array<string>" * paths
    n = links.count()
    parts = max(LEAST_FORESTS, math.ceil(n / per_task))
    levels: list[DataFrame] = []
    while True:
        laid = links.repartitionByRange(parts, "g", "c") if parts > 1 else links.coalesce(1)
        level = ws.write(laid.mapInArrow(_fold(paths), kinds), "forest")
        if parts == 1:
            levels.append(level.withColumn("state", F.when(F.col("state") == OPEN, F.lit(ROOTED)).otherwise(F.col("state"))))
            break
        levels.append(level)
        tops = level.where(F.col("state") == OPEN).select("g", F.col("top").alias("c")).distinct()
        links = ws.write(level.join(tops, ["g", "c"], "left_semi").select(*level.columns), "tops")
        before, n = n, links.count()
        fewer = max(math.ceil(n / per_task), math.ceil(parts / FAN_IN))
        if n == before and fewer > 1 and fewer == math.ceil(n / per_task):
            levels.append(_double(ws, links, paths))
            break
        parts = fewer if n else 1
    known = levels.pop()
    while levels:
        known = ws.write(_merge(levels.pop(), known, paths), "resolved")
    return known


def _close_circles(ws: Workspace, cur: DataFrame, paths: bool) -> DataFrame:
    """What is still open leads into circles that cross partitions.

    Doubling shrinks the set of tops until it holds entries of circles only; there the least
    entry spreads, again by doubling, until a round changes nothing: neighbouring windows then
    agree all the way round.
    """
    rest = ws.write(cur.where(F.col("state") == OPEN).select("g", "c", "top", "lo"), "unrooted")
    tops = rest.select("g", "top").distinct().count()
    while True:
        at = rest.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("top").alias("top2"), F.col("lo").alias("lo2"))
        step = rest.join(at, (rest.g == at.g2) & (rest.top == at.c2)).select("g", "c", F.col("top2").alias("top"), F.least("lo", "lo2").alias("lo"))
        step = ws.write(step, "unrooted")
        ws.drop(rest)
        rest, before, tops = step, tops, step.select("g", "top").distinct().count()
        if tops == before:
            break
    ring_ids = rest.select("g", F.col("top").alias("c")).distinct()
    ring = ws.write(rest.join(ring_ids, ["g", "c"], "left_semi"), "ring")
    while True:
        at = ring.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("top").alias("top2"), F.col("lo").alias("lo2"))
        step = ring.join(at, (ring.g == at.g2) & (ring.top == at.c2)).select(
            "g", "c", F.col("top2").alias("top"), F.least("lo", "lo2").alias("lo"), (F.col("lo2") < F.col("lo")).alias("moved")
        )
        step = ws.write(step, "ring")
        ws.drop(ring)
        ring = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    least = ring.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("lo").alias("least"))
    closed = rest.join(least, (rest.g == least.g2) & (rest.top == least.c2)).select(
        "g", "c", F.col("least").alias("top"), F.lit(-1).cast("long").alias("off"), F.lit(None).cast("string").alias("lo"), F.lit(CIRCLE).alias("state"),
        *[F.lit(None).cast("array<string>").alias("seg")] * paths,
    )
    return cur.where(F.col("state") != OPEN).unionByName(closed)


@dataclass
class Hierarchy:
    """``nodes``: (scope, id, root_id, depth[, path]); ``links``: the distinct links."""

    nodes: DataFrame
    links: DataFrame


def hierarchy(
    links: DataFrame,
    scope: str,
    child: str,
    parent: str,
    *,
    paths: bool = False,
    links_per_partition: int = LINKS_PER_PARTITION,
) -> Hierarchy:
    """Root and depth, and on request the path to the root, of every id that links name.

    One row per scope and id that is child or parent of a link. ``depth`` counts links up to
    the root, a root has depth 0 and is its own ``root_id``. If the way up never ends, depth is
    -1, ``root_id`` the least id by code point on the circle reached and ``path`` null. ``path``
    lists the ids from the parent up to the root and is empty for a root.

    Rows with a null scope, child or parent are no links. Repeated links count once; of several
    parents of one child the least is taken. A link from an id to itself is a circle of one.
    Columns besides the three named ones are ignored. No links give no rows.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "forest")
    kind = links.schema[scope].dataType
    named = links.select(F.col(scope).cast("string").alias("g"), F.col(child).cast("string").alias("c"), F.col(parent).cast("string").alias("p"))
    table = ws.write(named.dropna().groupBy("g", "c").agg(F.min("p").alias("p")), "links")
    parents = ws.write(table.select("g", F.col("p").alias("c")).distinct(), "parents")
    inner = ws.write(table.join(parents, ["g", "c"], "left_semi"), "inner")

    start = [F.lit(1).cast("long").alias("off"), F.col("c").alias("lo"), F.lit(OPEN).alias("state"), *[F.array("p").alias("seg")] * paths]
    cur = _resolve(ws, inner.select("g", "c", F.col("p").alias("top"), *start), paths, links_per_partition)

    seg = ["seg"] * paths
    roots = parents.join(table, ["g", "c"], "left_anti").select(
        "g", "c", F.col("c").alias("top"), F.lit(0).cast("long").alias("off"), *[F.array().cast("array<string>").alias("seg")] * paths
    )
    known = roots.unionByName(cur.select("g", "c", "top", "off", *seg))
    leaves = ws.write(table.join(parents, ["g", "c"], "left_anti").select("g", "c", "p"), "leaves")
    above = known.select("g", F.col("c").alias("p"), "top", "off", *seg)
    placed = look_up(leaves, above, ["g", "p"]).select(
        "g", "c", "top", F.when(F.col("off") < 0, F.lit(-1)).otherwise(F.col("off") + 1).cast("long").alias("off"),
        *[F.when(F.col("off") >= 0, F.concat(F.array("p"), "seg")).alias("seg")] * paths,
    )
    nodes = known.unionByName(placed).select(
        F.col("g").cast(kind).alias(scope), F.col("c").alias("id"), F.col("top").alias("root_id"), F.col("off").cast("int").alias("depth"),
        *[F.col("seg").alias("path")] * paths,
    )
    named = table.select(F.col("g").cast(kind).alias(scope), F.col("c").alias(child), F.col("p").alias(parent))
    return Hierarchy(nodes, named)


def descendants(nodes: DataFrame, scope: str) -> DataFrame:
    """(scope, id, descendant_id, distance): each node with every node below it whose way up ends,
    one row each; ``circular_descendants`` gives the others.

    ``nodes`` comes from ``hierarchy(paths=True)``; rows stay rows, no list grows with a tree.
    """
    return nodes.select(scope, F.col("id").alias("descendant_id"), F.posexplode("path").alias("at", "id")).select(
        scope, "id", "descendant_id", (F.col("at") + 1).alias("distance")
    )


def circular_descendants(found: Hierarchy, scope: str, child: str, parent: str) -> DataFrame:
    """(scope, id, descendant_id, distance, on_circle): each node with every other node below it
    whose way up never ends; ``on_circle`` tells descendants on the circle from those on a tail.

    The way of a node is its walk up to the first repeated id. Among the nodes that are parents it
    doubles per round until none grows, so a walk of n ids takes log2(n) rounds and one that shows
    the end; a leaf adds its parent to the way of that parent.
    """
    ws = Workspace(found.nodes.sparkSession, "circular")
    kind = found.links.schema[scope].dataType
    names = F.col(scope).cast("string").alias("g")
    astray = found.nodes.where("depth < 0").select(names, F.col("id").alias("c"))
    links = ws.write(found.links.select(names, F.col(child).alias("c"), F.col(parent).alias("p")).join(astray, ["g", "c"], "left_semi"), "links")
    parents = links.select("g", F.col("p").alias("c")).distinct()
    way = ws.write(links.join(parents, ["g", "c"], "left_semi").select("g", "c", F.col("p").alias("top"), F.array("p").alias("way")), "ways")
    while True:
        at = way.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("top").alias("top2"), F.col("way").alias("way2"))
        longer = F.array_distinct(F.concat("way", "way2"))
        step = way.join(at, (way.g == at.g2) & (way.top == at.c2)).select("g", "c", F.col("top2").alias("top"), longer.alias("way"), (F.size(longer) > F.size("way")).alias("grew"))
        step = ws.write(step, "ways")
        ws.drop(way)
        way = step.drop("grew")
        if step.where("grew").isEmpty():
            break
    above = way.select("g", F.col("c").alias("p"), "way")
    leaves = links.join(way, ["g", "c"], "left_anti").join(above, ["g", "p"]).select("g", "c", F.array_distinct(F.concat(F.array("p"), "way")).alias("way"))
    both = way.select("g", "c", "way").unionByName(leaves)
    pairs = both.select("g", F.col("c").alias("descendant_id"), F.array_contains("way", F.col("c")).alias("on_circle"), F.posexplode("way").alias("at", "id"))
    return pairs.where("id <> descendant_id").select(F.col("g").cast(kind).alias(scope), "id", "descendant_id", (F.col("at") + 1).alias("distance"), "on_circle")

"""Circles and cut vertices.

Strongly connected components: what is not on a circle is trimmed in rounds. In the rest the
greatest id spreads along the edges and, in the same rounds, against them. The node that named
both labels of another lies on circles with it: these are components. Edges between nodes with
different labels are on no circle and are cut, and what is left starts again in smaller pieces.
A piece of few edges is finished by the task that has it.

Cut vertices: partitions reduce their edges to a certificate, a breadth-first forest and a
spanning forest of the rest. Certificates of certificates keep which nodes any single removal
cuts off, so they are merged by a tree until each snapshot has at most 2(n - 1) edges left.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.operators.kernels import strong_components
from meshwright.runtime import Workspace, lay_out

#: Edges of a piece up to which one task finishes it, with numbers for ids: about 100 bytes an edge.
PIECE = 5_000_000


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """(snapshot, code, component) of coded edges; a component is named by one of its codes."""
    codes, ends = np.unique(np.concatenate([pdf["s"].to_numpy(), pdf["d"].to_numpy()]), return_inverse=True)
    s, d = ends[: len(pdf)], ends[len(pdf) :]
    start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(codes)))])
    of = np.array(strong_components(start.tolist(), d[np.argsort(s, kind="stable")].tolist()))
    held = np.bincount(of)[of] > 1
    name = np.zeros(of.max() + 1, dtype=np.int64)
    name[of] = codes
    return pd.DataFrame({"snapshot": pdf["snapshot"].iloc[0], "code": codes[held], "component": name[of][held]})


def _finished(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(snapshot, id, component) of pieces that one task each takes; ids go there as numbers."""
    kind = edges.schema["snapshot"].dataType.simpleString()
    ids = edges.select("snapshot", F.explode(F.array("s", "d")).alias("id")).distinct()
    codes = ws.write(ids.withColumn("code", F.monotonically_increasing_id()), "codes")
    coded = edges.join(codes.withColumnsRenamed({"id": "s", "code": "a"}), ["snapshot", "s"]).join(codes.withColumnsRenamed({"id": "d", "code": "b"}), ["snapshot", "d"])
    pieces = coded.select("snapshot", "piece", F.col("a").alias("s"), F.col("b").alias("d")).groupBy("snapshot", "piece")
    of = ws.write(pieces.applyInPandas(_finish, f"snapshot {kind}, code long, component long"), "of")
    named = of.join(codes, ["snapshot", "code"])
    least = named.groupBy("snapshot", "component").agg(F.min("id").alias("least"))
    return ws.write(named.join(least, ["snapshot", "component"]).select("snapshot", "id", F.col("least").alias("component")), "found")


def scc(adj: DataFrame, *, local_edges: int = PIECE, trims: int = 3) -> DataFrame:
    """(snapshot, id, component) of nodes on circles through others, named by the least id.

    Pieces of at most ``local_edges`` edges, at first the trimmed edges of a snapshot, are finished
    by one task each; 0 leaves everything to the rounds.
    """
    spark = adj.sparkSession
    ws = Workspace(spark, "scc")
    kinds = f"snapshot {adj.schema['snapshot'].dataType.simpleString()}, id string, component string"
    rest, seen = ws.write_counted(adj.where("s <> d").select("snapshot", F.lit("").alias("piece"), "s", "d").distinct(), "edges")
    found, n = [], seen["n"]
    while n:
        for _ in range(trims):
            into = rest.select("snapshot", F.col("d").alias("s")).distinct()
            out = rest.select("snapshot", F.col("s").alias("d")).distinct()
            kept = rest.join(into, ["snapshot", "s"], "left_semi").join(out, ["snapshot", "d"], "left_semi")
            cut, seen = ws.write_counted(kept.select("snapshot", "piece", "s", "d"), "edges")
            ws.drop(rest)
            rest, before, n = cut, n, seen["n"]
            if n == before:
                break
        if local_edges:
            small = rest.groupBy("snapshot", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= local_edges).select("snapshot", "piece")
            own = rest.join(small, ["snapshot", "piece"], "left_semi")
            found.append(_finished(ws, own))
            rest, seen = ws.write_counted(rest.join(small, ["snapshot", "piece"], "left_anti").select("snapshot", "piece", "s", "d"), "edges")
            n = seen["n"]
        if not n:
            break
        labels = _labels(ws, rest)
        members = labels.where("forward = backward").select("snapshot", "id", F.col("forward").alias("label"))
        least = members.groupBy("snapshot", "label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("k")).where("k > 1")
        found.append(ws.write(members.join(least, ["snapshot", "label"]).select("snapshot", "id", "component"), "found"))
        both = F.concat_ws("\x1f", "forward", "backward")
        ends = [labels.where("forward <> backward").select("snapshot", F.col("id").alias(x), both.alias(f"label_{x}")) for x in ("s", "d")]
        left = rest.join(ends[0], ["snapshot", "s"]).join(ends[1], ["snapshot", "d"]).where("label_s = label_d")
        rest, seen = ws.write_counted(left.select("snapshot", F.col("label_s").alias("piece"), "s", "d"), "edges")
        n = seen["n"]
    if not found:
        return spark.createDataFrame([], kinds)
    return ws.together(found)


def _labels(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(snapshot, id, forward, backward): the greatest id that leads to a node, and that it leads to.

    Nodes whose labels grew in a round are all that send in the next one.
    """
    there = edges.select("snapshot", "s", "d", F.lit(True).alias("along"))
    back = edges.select("snapshot", F.col("d").alias("s"), F.col("s").alias("d"), F.lit(False).alias("along"))
    links = lay_out(there.unionByName(back), "snapshot", "s")
    ids = links.select("snapshot", F.col("s").alias("id")).distinct()
    labels, seen = ws.write_counted(ids.select("snapshot", "id", F.col("id").alias("forward"), F.col("id").alias("backward"), F.lit(True).alias("f"), F.lit(True).alias("b")), "labels")
    grew = seen["n"]
    while grew:
        sent = links.join(labels.where("f OR b").withColumnRenamed("id", "s"), ["snapshot", "s"])
        sent = sent.where((F.col("along") & F.col("f")) | (~F.col("along") & F.col("b"))).groupBy("snapshot", F.col("d").alias("id"))
        came = sent.agg(F.max(F.when(F.col("along"), F.col("forward"))).alias("f2"), F.max(F.when(~F.col("along"), F.col("backward"))).alias("b2"))
        moved = [F.coalesce(F.col(new) > F.col(old), F.lit(False)).alias(flag) for new, old, flag in (("f2", "forward", "f"), ("b2", "backward", "b"))]
        step = labels.drop("f", "b").join(came, ["snapshot", "id"], "left")
        step = step.select("snapshot", "id", F.greatest("forward", "f2").alias("forward"), F.greatest("backward", "b2").alias("backward"), *moved)
        step, seen = ws.write_counted(step, "labels", grew=F.count_if(F.col("f") | F.col("b")))
        ws.drop(labels)
        labels, grew = step, seen["grew"]
    links.unpersist()
    return labels


def certificate(edges: list[tuple]) -> list[tuple]:
    """Edges that keep what any removal of one node cuts apart: at most 2(n - 1) of them."""
    around: dict = {}
    for s, d in edges:
        around.setdefault(s, []).append(d)
        around.setdefault(d, []).append(s)
    kept, used, seen = [], set(), set()
    for start in sorted(around):
        if start in seen:
            continue
        seen.add(start)
        queue = deque([start])
        while queue:
            node = queue.popleft()
            for nxt in around[node]:
                if nxt not in seen:
                    seen.add(nxt)
                    kept.append((node, nxt))
                    used.add((node, nxt))
                    queue.append(nxt)
    top: dict = {}

    def find(x):
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    for s, d in edges:
        if (s, d) in used or (d, s) in used:
            continue
        a, b = find(s), find(d)
        if a != b:
            top[a] = b
            kept.append((s, d))
    return kept


def cut_vertices(edges: list[tuple]) -> dict:
    """{node: nodes cut off from the largest piece when it is removed}, where that is any."""
    around: dict = {}
    for s, d in edges:
        if s != d:
            around.setdefault(s, set()).add(d)
            around.setdefault(d, set()).add(s)
    when: dict = {}
    out = {}
    for root in sorted(around):
        if root in when:
            continue
        order, parent = [], {root: None}
        when[root] = len(when)
        work = [(root, iter(sorted(around[root])))]
        order.append(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in when:
                    when[nxt] = len(when)
                    parent[nxt] = node
                    order.append(nxt)
                    work.append((nxt, iter(sorted(around[nxt]))))
                    break
            else:
                work.pop()
        low = {x: min([when[x], *(when[y] for y in around[x] if y != parent[x])]) for x in order}
        size = dict.fromkeys(order, 1)
        pieces: dict = {}
        for x in reversed(order):
            up = parent[x]
            if up is None:
                continue
            size[up] += size[x]
            low[up] = min(low[up], low[x])
            if low[x] >= when[up]:
                pieces.setdefault(up, []).append(size[x])
        for x, parts in pieces.items():
            above = size[root] - 1 - sum(parts)
            lost = size[root] - 1 - max([*parts, above])
            if lost > 0:
                out[x] = lost
    return out


def _reduce(pdf: pd.DataFrame) -> pd.DataFrame:
    kept = certificate(list(zip(pdf["s"], pdf["d"])))
    out = pd.DataFrame(kept, columns=["s", "d"])
    out["snapshot"], out["chunk"] = pdf["snapshot"].iloc[0], pdf["chunk"].iloc[0]
    return out[["snapshot", "s", "d", "chunk"]]


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    found = cut_vertices(certificate(list(zip(pdf["s"], pdf["d"]))))
    out = pd.DataFrame(sorted(found.items()), columns=["id", "blast_radius"])
    out["snapshot"] = pdf["snapshot"].iloc[0]
    return out[["snapshot", "id", "blast_radius"]]


def articulation(adj: DataFrame, *, edges_per_chunk: int = 200_000, fan_in: int = 8) -> DataFrame:
    """(snapshot, id, blast_radius) of the cut vertices of the undirected simple graph."""
    ws = Workspace(adj.sparkSession, "cuts")
    pair = adj.where("s <> d").select("snapshot", F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).distinct()
    kind = adj.schema["snapshot"].dataType.simpleString()
    edges = ws.write(pair, "edges")
    chunks = max(1, -(-edges.count() // edges_per_chunk))
    while chunks > 1:
        parted = edges.withColumn("chunk", F.pmod(F.xxhash64("s"), F.lit(chunks)).cast("long"))
        smaller = parted.groupBy("snapshot", "chunk").applyInPandas(_reduce, f"snapshot {kind}, s string, d string, chunk long")
        edges = ws.write(smaller.select("snapshot", "s", "d"), "edges")
        chunks = -(-chunks // fan_in)
    return edges.groupBy("snapshot").applyInPandas(_cut, f"snapshot {kind}, id string, blast_radius long")

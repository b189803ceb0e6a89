"""Operations on the graph: lookups, liveness, impact, paths, centrality, structure, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.functions.ids import file_of, is_test_path, owner_of, qual_of, under_scope
from meshwright.operators import circles, sweeps
from meshwright.operators.graph import CODE_KINDS, LIVENESS, Graph, is_test_node, load_graph, roots
from meshwright.plans.graphsql import GRAPH, ROOTS, test_path

#: Parameters of the registered queries.
SYMBOL = "emit_line"
CALLED, CALLER = "vendor/textkit/fmt.py::render_text", "vendor/bootkit/wiring.py::Wiring.assemble"
CHANGED = "vendor/corekit/base.py::BaseUnit"
SINK = "vendor/logkit/sink.py::Sink.write_out"
SUBSYSTEM = "vendor/corekit"
TOP = 10
#: Lanes that a task closes over a snapshot's edges; it holds few at a time, whatever their number.
FAN_CHUNK = 65_536


def _top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each snapshot in a total order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("snapshot").orderBy(*order))).where(F.col("place") <= n)


def top_by_count(df: DataFrame, n: int, *, count: str = "n") -> DataFrame:
    """The n greatest counts of a snapshot: cut per salt first, so no task ranks a whole snapshot."""
    order = (F.desc(count), F.asc("id"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    first = Window.partitionBy("snapshot", "salt").orderBy(*order)
    cut = df.withColumn("salt", salt).withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).drop("salt", "place")
    return _top(cut, n, *order)


# -- lookups -----------------------------------------------------------------


def find_symbol(graph: Graph, name: str) -> DataFrame:
    """Definitions of a name; several make the answer ambiguous."""
    hits = graph.nodes.where(F.col("name") == name)
    many = F.count(F.lit(1)).over(Window.partitionBy("snapshot"))
    return hits.select("snapshot", "id", "kind", "location", F.when(many > 1, 0.5).otherwise(1.0).alias("confidence"))


def resolve_target(graph: Graph, name: str) -> DataFrame:
    """(snapshot, id, n): candidates of a full id, a bare name or a ``Type.member`` suffix."""
    ids, suffix = graph.nodes, "." + name
    exact = F.col("id") == name
    named = (F.col("name") == name) | F.endswith(F.col("id"), F.lit(suffix)) | F.endswith(F.col("id"), F.lit("::" + name))
    rank = F.when(exact, 0).when(named, 1)
    hits = ids.where(rank.isNotNull()).withColumn("rank", rank)
    best = F.min("rank").over(Window.partitionBy("snapshot"))
    kept = hits.withColumn("best", best).where(F.col("rank") == F.col("best"))
    return kept.select("snapshot", "id", F.count(F.lit(1)).over(Window.partitionBy("snapshot")).alias("n"))


def callers(graph: Graph, ident: str) -> DataFrame:
    calls = graph.edges.where((F.col("relation") == "CALLS") & (F.col("dst_id") == ident))
    return calls.select("snapshot", "src", F.round("weight", 3).alias("weight"), "provenance")


def callees(graph: Graph, ident: str) -> DataFrame:
    calls = graph.edges.where((F.col("relation") == "CALLS") & (F.col("src") == ident))
    return calls.select("snapshot", "dst_id", F.round("weight", 3).alias("weight"), "provenance")


def call_confidence(graph: Graph, ident: str) -> DataFrame:
    """How sure the callers of a node are, or what uses it otherwise if it has none."""
    into = graph.edges.where(F.col("dst_id") == ident)
    call = F.col("relation") == "CALLS"
    certain = F.sum(F.when(call & (F.col("provenance") == "extracted"), 1).otherwise(0))
    total = F.sum(F.when(call, 1).otherwise(0))
    sums = into.groupBy("snapshot").agg(total.alias("calls"), certain.alias("extracted"), F.sum(F.when(call, 0).otherwise(1)).alias("other_uses"))
    share = F.when(F.col("calls") > 0, F.round(F.lit(0.4) + F.lit(0.5) * F.col("extracted") / F.when(F.col("calls") > 0, F.col("calls")), 2)).otherwise(0.6)
    return sums.select("snapshot", "calls", "extracted", "other_uses", share.alias("confidence"))


def find_holes(graph: Graph) -> DataFrame:
    """References that did not resolve or lead to a missing node, overrides aside."""
    synthetic = (F.col("provenance") == "ambiguous") & ~F.col("name_based")
    ids = graph.nodes.select("snapshot", F.col("id").alias("dst_id"))
    lost = graph.edges.where(~synthetic).join(ids, ["snapshot", "dst_id"], "left_anti")
    columns = ["snapshot", "src", "relation", F.col("dst_symbol").alias("missing")]
    return graph.holes.select(*columns).unionByName(lost.select(*columns)).distinct()


def relation_matrix(graph: Graph, scope: str, relation: str = "CALLS", limit: int | None = None) -> DataFrame:
    """Cells of the matrix of one relation between the nodes under a scope, greatest weight each.

    With ``limit``, a scope of more nodes in a snapshot is refused there: it gives no cells.
    """
    cells = graph.edges.where((F.col("relation") == relation) & under_scope(F.col("src"), scope) & under_scope(F.col("dst_id"), scope))
    ids = graph.nodes.where(under_scope(F.col("id"), scope)).select("snapshot", "id")
    for end in ("src", "dst_id"):
        cells = cells.join(ids.withColumnRenamed("id", end), ["snapshot", end], "left_semi")
    cells = cells.groupBy("snapshot", "src", "dst_id").agg(F.max(F.round("weight", 2)).alias("weight"))
    if limit is not None:
        small = ids.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit).select("snapshot")
        ids = ids.join(F.broadcast(small), "snapshot")
    place = ids.withColumn("at", F.row_number().over(Window.partitionBy("snapshot").orderBy("id")) - 1)
    cells = cells.join(place.withColumnsRenamed({"id": "src", "at": "row"}), ["snapshot", "src"])
    return cells.join(place.withColumnsRenamed({"id": "dst_id", "at": "col"}), ["snapshot", "dst_id"]).select("snapshot", "src", "dst_id", "row", "col", "weight")


# -- liveness ----------------------------------------------------------------


def live_set(graph: Graph, *, confident: bool = False) -> DataFrame:
    """(snapshot, id) that entry points reach. A C or C++ file is linked once anything of it is
    reached and its module then starts: that is repeated until no module is added."""
    adj = graph.adjacency(confident=confident)
    seeds = roots(graph.nodes)
    linked = ("c", "h", "cc", "cpp", "cxx", "hpp", "hxx")
    units = graph.nodes.where((F.col("kind") == "Module") & F.substring_index("file", ".", -1).isin(*linked)).select("snapshot", "id", "file")
    reached = sweeps.reach(adj, seeds)
    if confident or units.isEmpty():
        return reached.select("snapshot", "id")
    while True:
        files = reached.select("snapshot", file_of(F.col("id")).alias("file")).distinct()
        new = units.join(files, ["snapshot", "file"], "left_semi").join(reached, ["snapshot", "id"], "left_anti").select("snapshot", "id")
        if new.isEmpty():
            return reached.select("snapshot", "id")
        reached = sweeps.reach(adj, seeds.unionByName(new))
        seeds = seeds.unionByName(new)


def find_stale(graph: Graph) -> DataFrame:
    """Functions, methods and classes that no entry point reaches; no class with a live member."""
    live = live_set(graph)
    lost = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS))).join(live, ["snapshot", "id"], "left_anti")
    lost = lost.where(~(F.startswith(F.col("name"), F.lit("__")) & F.endswith(F.col("name"), F.lit("__"))))
    parts = F.split(qual_of(F.col("id")), r"\.")
    depth = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    owners = live.where(F.size(parts) > 1).select(
        "snapshot", F.explode(F.transform(depth, lambda k: F.concat(file_of(F.col("id")), F.lit("::"), F.array_join(F.slice(parts, F.lit(1), k), ".")))).alias("id")
    )
    owned = lost.where(F.col("kind") == "Class").join(owners.distinct(), ["snapshot", "id"], "left_semi").select("snapshot", "id")
    runtime = F.max(F.array_contains("roles", "runtime").cast("int"))
    grounded = graph.nodes.groupBy("snapshot").agg(runtime.alias("grounded"))
    out = lost.join(owned, ["snapshot", "id"], "left_anti").join(F.broadcast(grounded), "snapshot")
    return out.select("snapshot", "id", "kind", F.when(F.col("grounded") == 1, 0.78).otherwise(0.6).alias("confidence"))


def impact_of(graph: Graph, ident: str) -> DataFrame:
    """What depends on a node, nearest first: tier, hops, and whether it is a test to run."""
    seeds = graph.nodes.where(F.col("id") == ident).select("snapshot", "id")
    tiers = F.explode(F.array(F.lit("ambiguous"), F.lit("confident"))).alias("tier")
    edges = sweeps.reverse(graph.adjacency()).withColumn("tier", F.lit("ambiguous"))
    edges = edges.unionByName(sweeps.reverse(graph.adjacency(confident=True)).withColumn("tier", F.lit("confident")))
    both = sweeps.reach(edges, seeds.select("snapshot", "id", tiers), by=("tier",))
    all_ = both.where("tier = 'ambiguous'").drop("tier")
    sure = both.where("tier = 'confident'").select("snapshot", "id", "tier")
    tests = graph.nodes.where(F.array_contains("roles", "test")).select("snapshot", "id", F.lit(True).alias("is_test"))
    out = all_.where("hops > 0").join(sure, ["snapshot", "id"], "left").join(tests, ["snapshot", "id"], "left")
    return out.select("snapshot", "id", F.coalesce("tier", F.lit("ambiguous")).alias("tier"), "hops", F.coalesce("is_test", F.lit(False)).alias("is_test"))


def trace_path(graph: Graph, source: str, sink: str) -> DataFrame:
    """The most certain way between two nodes over all relations, weights clamped to (0, 1]."""
    ids = graph.nodes.select("snapshot", "id")
    e = graph.edges.join(ids.withColumnRenamed("id", "src"), ["snapshot", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst_id"), ["snapshot", "dst_id"], "left_semi")
    w = F.least(F.greatest("weight", F.lit(1e-9)), F.lit(1.0))
    best = sweeps.best_paths(e.select("snapshot", F.col("src").alias("s"), F.col("dst_id").alias("d"), w.alias("w")), ids.where(F.col("id") == source))
    return best.where(F.col("id") == sink).select("snapshot", F.round("score", 6).alias("confidence"), "hops", "path")


# -- centrality --------------------------------------------------------------


def orient(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("snapshot", "kind").agg(F.count(F.lit(1)).alias("n_nodes"))


def degrees(graph: Graph) -> DataFrame:
    """Fan-in along liveness relations and fan-out along calls, rows of parallel relations counted."""
    ids = graph.nodes.select("snapshot", "id")
    e = graph.edges.join(ids.withColumnRenamed("id", "dst_id"), ["snapshot", "dst_id"], "left_semi")
    live, call, sure = F.col("relation").isin(list(LIVENESS)), F.col("relation") == "CALLS", F.col("provenance") == "extracted"
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    names = ("fan_in", "confident_fan_in", "fan_out", "confident_fan_out")
    into = e.select("snapshot", F.col("dst_id").alias("id"), one(live).alias(names[0]), one(live & sure).alias(names[1]), zero.alias(names[2]), zero.alias(names[3]))
    out = e.select("snapshot", F.col("src").alias("id"), zero.alias(names[0]), zero.alias(names[1]), one(call).alias(names[2]), one(call & sure).alias(names[3]))
    return into.unionByName(out).groupBy("snapshot", "id").agg(*[F.sum(n).alias(n) for n in names])


def hubs(graph: Graph, n: int = TOP) -> DataFrame:
    """Code with the most certain dependents; the test-suite is neither listed nor counted."""
    tests = graph.nodes.where(is_test_node()).select("snapshot", F.col("id").alias("src"))
    e = graph.edges.where(F.col("relation").isin(list(LIVENESS)) & (F.col("provenance") == "extracted")).join(tests, ["snapshot", "src"], "left_anti")
    code = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS)) & ~is_test_node()).select("snapshot", F.col("id").alias("dst_id"))
    counts = e.join(code, ["snapshot", "dst_id"], "left_semi").groupBy("snapshot", F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return top_by_count(counts, n).select("snapshot", "id", F.col("n").alias("fan_in"), "place")


def pagerank_top(graph: Graph, n: int = TOP) -> DataFrame:
    ranks = sweeps.pagerank(graph.nodes, graph.adjacency(confident=True))
    rounded = ranks.select("snapshot", "id", F.round("rank", 8).alias("rank"))
    return top_by_count(rounded, n, count="rank").select("snapshot", "id", "rank", "place")


def transitive_fan_in(graph: Graph, samples: int = 64) -> DataFrame:
    """(snapshot, id, fan_in): distinct other nodes that lead to a node along certain edges, from
    an evenly spaced sample of each snapshot's nodes; exact where the sample holds them all."""
    pool = graph.nodes.where(~is_test_node()).select("snapshot", "id")
    size = pool.groupBy("snapshot").agg(F.count(F.lit(1)).alias("size"))
    seeds = sweeps.lanes(pool.withColumn("group", F.concat_ws("\x1f", F.col("snapshot").cast("string"), "id")))
    low = seeds.groupBy("snapshot").agg(F.min("number").alias("low"))
    seeds = seeds.join(F.broadcast(low), "snapshot").join(F.broadcast(size), "snapshot")
    step = F.greatest(F.floor(F.col("size") / samples), F.lit(1))
    chosen = seeds.where((F.col("number") - F.col("low")) % step == 0)
    # numbered without gaps in each snapshot, since every stretch of lanes takes the snapshot's edges once more
    chosen = chosen.withColumn("number", F.floor((F.col("number") - F.col("low")) / step))
    kept = chosen.groupBy("snapshot").agg(F.count(F.lit(1)).alias("kept"))
    started = chosen.select("snapshot", F.col("number").alias("lane"), "id", F.lit(True).alias("seed"))
    hits = sweeps.lane_counts(graph.adjacency(confident=True), started, by_node=True, chunk=FAN_CHUNK).select("snapshot", "id", F.col("n").alias("hits"))
    own = chosen.select("snapshot", "id", F.lit(1).alias("own"))
    out = hits.join(own, ["snapshot", "id"], "left").join(F.broadcast(kept), "snapshot").join(F.broadcast(size), "snapshot")
    value = (F.col("hits") - F.coalesce("own", F.lit(0))) * F.col("size") / F.col("kept")
    return out.select("snapshot", "id", value.alias("fan_in")).where("fan_in > 0")


# -- structure ---------------------------------------------------------------


def cycles(graph: Graph) -> DataFrame:
    """(snapshot, id, component) of nodes on circles of calls and imports through others."""
    return circles.scc(graph.adjacency(("CALLS", "IMPORTS")))


def self_loops(graph: Graph) -> DataFrame:
    """(snapshot, id) of nodes that call or import themselves; those on no larger circle are circles
    of one beside ``cycles``."""
    return graph.adjacency(("CALLS", "IMPORTS")).where("s = d").select("snapshot", F.col("s").alias("id")).distinct()


def data_loops(graph: Graph) -> DataFrame:
    """Feedback through mutable state: circles of calls, writes and (turned round) reads that hold
    a variable."""
    state = graph.nodes.where(F.col("kind") == "Variable").select("snapshot", F.col("id").alias("dst_id"))
    e = graph.edges
    touch = e.where(F.col("relation").isin("WRITES", "READS")).join(state, ["snapshot", "dst_id"], "left_semi")
    turned = F.col("relation") == "READS"
    ends = [F.when(turned, F.col(a)).otherwise(F.col(b)).alias(x) for a, b, x in (("dst_id", "src", "s"), ("src", "dst_id", "d"))]
    calls = e.where(F.col("relation") == "CALLS").select("snapshot", F.col("src").alias("s"), F.col("dst_id").alias("d"))
    loops = circles.scc(calls.unionByName(touch.select("snapshot", *ends)))
    held = loops.join(state.withColumnRenamed("dst_id", "id"), ["snapshot", "id"], "left_semi").select("snapshot", "component").distinct()
    return loops.join(held, ["snapshot", "component"], "left_semi").select("snapshot", "id", "component")


def chokepoints(graph: Graph, n: int = 20) -> DataFrame:
    found = circles.articulation(graph.adjacency())
    code = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS))).select("snapshot", "id", "name", "location")
    ranked = found.join(code, ["snapshot", "id"]).withColumnRenamed("blast_radius", "n")
    return top_by_count(ranked, n).select("snapshot", "id", "name", "location", F.col("n").alias("blast_radius"))


def giant_component(graph: Graph) -> DataFrame:
    """Size of each snapshot's largest component of the undirected graph, and its least node."""
    adj = graph.adjacency()
    ends = adj.where("s <> d").select("snapshot", F.explode(F.array("s", "d")).alias("id")).distinct()
    sizes = sweeps.components(ends, adj).groupBy("snapshot", "component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("snapshot").agg(F.min(F.struct((-F.col("n")).alias("k"), "component")).alias("x"))
    return best.select("snapshot", F.col("x.component").alias("component"), (-F.col("x.k")).alias("n_nodes"))


def summarize(graph: Graph, scope: str) -> DataFrame:
    """A subsystem in rows (snapshot, part, item, n): node counts, hubs, public surface, files it
    depends on."""
    members = graph.nodes.where(under_scope(F.col("id"), scope))
    ids = members.select("snapshot", "id")
    counts = members.groupBy("snapshot", F.col("kind").alias("item")).agg(F.count(F.lit(1)).alias("n")).select("snapshot", F.lit("kind").alias("part"), "item", "n")
    inside = lambda c: under_scope(F.col(c), scope)
    surface = graph.edges.where(inside("dst_id") & ~inside("src")).groupBy("snapshot", F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    fan = degrees(graph).select("snapshot", "id", F.col("fan_in").alias("n"))
    hub = top_by_count(ids.join(fan, ["snapshot", "id"]), 8)
    public = top_by_count(surface.join(ids, ["snapshot", "id"], "left_semi"), 8)
    leaf = qual_of(F.col("id"))
    files = graph.edges.where(inside("src") & ~inside("dst_id")).select("snapshot", file_of(F.col("dst_id")).alias("item")).groupBy("snapshot", "item").agg(F.lit(0).cast("long").alias("n"))
    files = files.withColumn("place", F.row_number().over(Window.partitionBy("snapshot").orderBy("item"))).where("place <= 12")
    shown = [d.select("snapshot", F.lit(p).alias("part"), leaf.alias("item"), "n") for d, p in ((hub, "read_first"), (public, "public_surface"))]
    return counts.unionByName(shown[0]).unionByName(shown[1]).unionByName(files.select("snapshot", F.lit("depends_on").alias("part"), "item", "n"))


# -- issues ------------------------------------------------------------------


def god_floors(deg: DataFrame, code: DataFrame) -> DataFrame:
    """(snapshot, t_in, t_out): 5 and 5, or just above the 95th percentile of the coupled code if
    there are 200 of it or more. The percentile is the entry at 0.95 n of the sorted degrees; it
    is read off the counts of each degree, so nothing is ranked as a whole."""
    pop = deg.join(code, ["snapshot", "id"], "left_semi").where("fan_in >= 1 AND fan_out >= 1")
    size = pop.groupBy("snapshot").agg(F.count(F.lit(1)).alias("size"))
    out = size
    for c, t in (("fan_in", "t_in"), ("fan_out", "t_out")):
        per = pop.groupBy("snapshot", F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("snapshot").orderBy("v"))
        p95 = per.withColumn("upto", upto).join(F.broadcast(size), "snapshot").where(F.col("upto") > F.least(F.col("size") - 1, F.floor(F.lit(0.95) * F.col("size"))))
        out = out.join(p95.groupBy("snapshot").agg(F.greatest(F.min("v") + 1, F.lit(5)).alias(t)), "snapshot")
    enough = F.col("size") >= 200
    return out.select("snapshot", *[F.when(enough, F.col(t)).otherwise(F.lit(5)).alias(t) for t in ("t_in", "t_out")])


def god_objects(graph: Graph, review_cap: int | None = None) -> DataFrame:
    """Code coupled strongly both ways, without the coupling that only the test-suite makes; with
    ``review_cap``, at most so many flags of a snapshot that need review."""
    deg = degrees(graph)
    code = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS))).select("snapshot", "id")
    product = graph.nodes.where(F.col("kind").isin(list(CODE_KINDS)) & ~F.array_contains("roles", "test") & ~is_test_path(F.col("id"))).select("snapshot", "id")
    floors = F.broadcast(god_floors(deg, code))
    heavy = deg.join(product, ["snapshot", "id"], "left_semi").join(floors, "snapshot").where("fan_in >= t_in AND fan_out >= t_out")
    tests = graph.nodes.where(is_test_node()).select("snapshot", F.col("id").alias("src"))
    sure = F.sum(F.when(F.col("provenance") == "extracted", 1).otherwise(0))
    e = graph.edges.where(F.col("relation").isin(list(LIVENESS))).join(tests, ["snapshot", "src"], "left_anti")
    own = e.groupBy("snapshot", F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("own_in"), sure.alias("sure_in"))
    calls = graph.edges.where(F.col("relation") == "CALLS").groupBy("snapshot", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("all_out"), sure.alias("sure_out"))
    held = heavy.join(own, ["snapshot", "id"]).where("own_in >= t_in").join(calls, ["snapshot", "id"])
    artifact = (F.col("sure_in") < F.col("t_in")) | (F.col("sure_out") < F.col("t_out"))
    share = (F.col("sure_in") / F.col("own_in") + F.col("sure_out") / F.col("all_out")) / 2
    held = held.withColumn("needs_review", artifact).withColumn("confidence", F.round(F.lit(0.3) + F.lit(0.6) * share, 2))
    if review_cap is not None:
        place = F.row_number().over(Window.partitionBy("snapshot", "needs_review").orderBy(F.desc("confidence"), "id"))
        held = held.withColumn("place", place).where(~F.col("needs_review") | (F.col("place") <= review_cap))
    return held.select("snapshot", "id", "fan_in", "fan_out", "confidence", "needs_review")


def cycle_issues(graph: Graph, show_heuristic: bool = False) -> DataFrame:
    """Circles of code with the share of certain edges on them; without any they are noise."""
    found = cycles(graph)
    kinds = graph.nodes.select("snapshot", "id", F.col("kind").isin(list(CODE_KINDS)).cast("int").alias("code"))
    comps = found.join(kinds, ["snapshot", "id"]).groupBy("snapshot", "component").agg(F.count(F.lit(1)).alias("members"), F.min("code").alias("code")).where("code = 1")
    ends = [found.select("snapshot", F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in ("src", "dst_id")]
    e = graph.edges.where(F.col("relation").isin("CALLS", "IMPORTS")).join(ends[0], ["snapshot", "src"]).join(ends[1], ["snapshot", "dst_id"]).where("c_src = c_dst_id")
    sums = e.groupBy("snapshot", F.col("c_src").alias("component")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.when(F.col("provenance") == "extracted", 1).otherwise(0)).alias("confident_edges"))
    out = comps.join(sums, ["snapshot", "component"])
    if not show_heuristic:
        out = out.where("confident_edges > 0")
    share = F.col("confident_edges") / F.col("n_edges")
    return out.select("snapshot", F.col("component").alias("id"), "members", "n_edges", "confident_edges", F.round(F.lit(0.3) + F.lit(0.6) * share, 2).alias("confidence"), (share < 0.5).alias("needs_review"))


def scan(graph: Graph) -> DataFrame:
    """All issues in rows (snapshot, issue, id, detail, urgency): stubs and holes by liveness,
    circles, data loops and god objects."""
    live = live_set(graph).withColumn("live", F.lit(True))
    certain = live_set(graph, confident=True).withColumn("certain", F.lit(True))
    stub = graph.nodes.where("is_stub").select("snapshot", "id", (F.array_contains("roles", "test") | is_test_path(F.col("id"))).alias("own_test"))
    stub = stub.join(live, ["snapshot", "id"], "left").join(certain, ["snapshot", "id"], "left")
    is_live = F.coalesce("live", F.lit(False)) & ~F.col("own_test")
    urgency = F.when(is_live & F.coalesce("certain", F.lit(False)), "red").when(is_live, "orange").otherwise("green")
    stubs = stub.select("snapshot", F.when(is_live, "live_stub").otherwise("stub").alias("issue"), "id", F.lit("").alias("detail"), urgency.alias("urgency"))
    hole = find_holes(graph).join(live.withColumnRenamed("id", "src"), ["snapshot", "src"], "left")
    holes = hole.select("snapshot", F.lit("hole").alias("issue"), F.col("src").alias("id"), F.concat_ws(" ", "relation", "missing").alias("detail"), F.when(F.col("live"), "orange").otherwise("green").alias("urgency"))
    hedge = F.when(F.col("needs_review"), "green").otherwise("orange").alias("urgency")
    loops = data_loops(graph).groupBy("snapshot", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        stubs,
        holes,
        cycle_issues(graph).select("snapshot", F.lit("cycle").alias("issue"), "id", F.col("members").cast("string").alias("detail"), hedge),
        loops.select("snapshot", F.lit("data_loop").alias("issue"), F.col("component").alias("id"), F.col("n").cast("string").alias("detail"), F.lit("orange").alias("urgency")),
        god_objects(graph).select("snapshot", F.lit("god_object").alias("issue"), "id", F.concat_ws("/", F.col("fan_in").cast("string"), F.col("fan_out").cast("string")).alias("detail"), hedge),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- difference of two graphs ------------------------------------------------


def graph_diff(graph: Graph, old: int, new: int) -> DataFrame:
    """(side, what, key, n): multiset differences of node and edge keys between two snapshots."""
    nodes = graph.nodes.select("snapshot", F.lit("node").alias("what"), F.concat_ws(" ", "kind", "name").alias("key"))
    names = graph.nodes.select("snapshot", "id", "name")
    e = graph.edges.join(names.withColumnsRenamed({"id": "src", "name": "src_name"}), ["snapshot", "src"], "left")
    e = e.join(names.withColumnsRenamed({"id": "dst_id", "name": "dst_name"}), ["snapshot", "dst_id"], "left")
    key = F.concat_ws(" ", F.coalesce("src_name", "src"), "relation", F.coalesce("dst_name", "dst_symbol"))
    keys = nodes.unionByName(e.select("snapshot", F.lit("edge").alias("what"), key.alias("key")))
    count = lambda p: F.sum(F.when(F.col("snapshot") == p, 1).otherwise(0))
    both = keys.where(F.col("snapshot").isin(old, new)).groupBy("what", "key").agg((count(new) - count(old)).alias("n")).where("n <> 0")
    return both.select(F.when(F.col("n") > 0, "new").otherwise("old").alias("side"), "what", "key", F.abs("n").alias("n"))


def _with_graph(op, *args):
    return lambda spark, d: op(load_graph(spark, d), *args)


def _reach_counts(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    found = sweeps.reach(g.adjacency(), roots(g.nodes))
    return found.groupBy("snapshot", "hops").agg(F.count(F.lit(1)).alias("n_nodes"))


def _reach_nodes(spark: SparkSession, d: str) -> DataFrame:
    return live_set(load_graph(spark, d))


def _degree_query(spark: SparkSession, d: str) -> DataFrame:
    return degrees(load_graph(spark, d))


def _tfi_exact(spark: SparkSession, d: str) -> DataFrame:
    out = transitive_fan_in(load_graph(spark, d), samples=1 << 30)
    return out.select("snapshot", "id", F.col("fan_in").cast("long").alias("fan_in"))


QUERIES = {
    "find_symbol": _with_graph(find_symbol, SYMBOL),
    "resolve_target": _with_graph(resolve_target, "Sink.write_out"),
    "get_callers": _with_graph(callers, CALLED),
    "get_callees": _with_graph(callees, CALLER),
    "call_confidence": _with_graph(call_confidence, CALLED),
    "find_holes": _with_graph(find_holes),
    "get_matrix": _with_graph(relation_matrix, "services/core", "CALLS"),
    "live_set": _reach_nodes,
    "reach_hops": _reach_counts,
    "find_stale": _with_graph(find_stale),
    "impact_of": _with_graph(impact_of, CHANGED),
    "trace_path": _with_graph(trace_path, CALLER, SINK),
    "orient": _with_graph(orient),
    "degrees": _degree_query,
    "hubs": _with_graph(hubs),
    "pagerank": _with_graph(pagerank_top),
    "transitive_fan_in": _tfi_exact,
    "transitive_fan_in_sampled": _with_graph(transitive_fan_in, 64),
    "cycles": _with_graph(cycles),
    "self_loops": _with_graph(self_loops),
    "cycle_issues": _with_graph(cycle_issues),
    "data_loops": _with_graph(data_loops),
    "find_chokepoints": _with_graph(chokepoints),
    "giant_component": _with_graph(giant_component),
    "summarize_subsystem": _with_graph(summarize, SUBSYSTEM),
    "god_objects": _with_graph(god_objects, 500),
    "scan": _with_graph(scan),
    "graph_diff": _with_graph(graph_diff, 1, 4),
}

_EXISTS = "EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.{0})"
_SCOPED = "({0} = '{1}' OR starts_with({0}, '{1}/') OR starts_with({0}, '{1}::') OR starts_with({0}, '{1}.'))"

_HOLES = """holes AS (
  SELECT DISTINCT snapshot, src, relation, dst_symbol AS missing FROM h
  UNION SELECT snapshot, src, relation, dst_symbol FROM e WHERE NOT (provenance = 'ambiguous' AND NOT name_based)
    AND NOT EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.dst_id))"""

_DEGREES = """known AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.dst_id)),
deg AS (
  SELECT snapshot, id, CAST(sum(fi) AS BIGINT) AS fan_in, CAST(sum(ci) AS BIGINT) AS confident_fan_in, CAST(sum(fo) AS BIGINT) AS fan_out, CAST(sum(co) AS BIGINT) AS confident_fan_out FROM (
    SELECT snapshot, dst_id AS id, CASE WHEN relation IN ('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES') THEN 1 ELSE 0 END AS fi,
      CASE WHEN relation IN ('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES') AND provenance = 'extracted' THEN 1 ELSE 0 END AS ci, 0 AS fo, 0 AS co FROM known
    UNION ALL SELECT snapshot, src, 0, 0, CASE WHEN relation = 'CALLS' THEN 1 ELSE 0 END, CASE WHEN relation = 'CALLS' AND provenance = 'extracted' THEN 1 ELSE 0 END FROM known) GROUP BY 1, 2)"""

_ALL_GODS = (
    _DEGREES
    + """, pop AS (SELECT deg.*, count(*) OVER (PARTITION BY deg.snapshot) AS size, row_number() OVER (PARTITION BY deg.snapshot ORDER BY fan_in) - 1 AS ri,
    row_number() OVER (PARTITION BY deg.snapshot ORDER BY fan_out) - 1 AS ro
  FROM deg JOIN n USING (snapshot, id) WHERE n.kind IN ('Function', 'Method', 'Class') AND fan_in >= 1 AND fan_out >= 1),
floors AS (
  SELECT snapshot, CASE WHEN max(size) >= 200 THEN greatest(5, max(CASE WHEN ri = least(size - 1, CAST(floor(0.95 * size) AS BIGINT)) THEN fan_in END) + 1) ELSE 5 END AS t_in,
    CASE WHEN max(size) >= 200 THEN greatest(5, max(CASE WHEN ro = least(size - 1, CAST(floor(0.95 * size) AS BIGINT)) THEN fan_out END) + 1) ELSE 5 END AS t_out FROM pop GROUP BY 1),
own_in AS (SELECT snapshot, dst_id AS id, count(*) AS t, count(*) FILTER (provenance = 'extracted') AS c FROM e
  WHERE relation IN ('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES')
    AND NOT EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.src AND n.is_test) GROUP BY 1, 2),
own_out AS (SELECT snapshot, src AS id, count(*) AS t, count(*) FILTER (provenance = 'extracted') AS c FROM e WHERE relation = 'CALLS' GROUP BY 1, 2),
gods AS (
  SELECT d.snapshot, d.id, d.fan_in, d.fan_out, round(0.3 + 0.6 * ((i.c / i.t + o.c / o.t) / 2), 2) AS confidence, i.c < f.t_in OR o.c < f.t_out AS needs_review
  FROM deg d JOIN floors f USING (snapshot) JOIN n USING (snapshot, id) JOIN own_in i USING (snapshot, id) JOIN own_out o USING (snapshot, id)
  WHERE n.kind IN ('Function', 'Method', 'Class') AND NOT list_contains(n.roles, 'test') AND NOT """
    + test_path("n.id")
    + """ AND d.fan_in >= f.t_in AND d.fan_out >= f.t_out AND i.t >= f.t_in"""
)
_GODS = (
    _ALL_GODS
    + """
  QUALIFY NOT needs_review OR row_number() OVER (PARTITION BY d.snapshot, needs_review ORDER BY confidence DESC, d.id) <= 500)"""
)


def _scc_sql(edges: str, name: str) -> str:
    return f"""{name}_e AS ({edges}),
{name}_p AS (SELECT DISTINCT snapshot, s AS a, d AS b FROM {name}_e UNION SELECT p.snapshot, p.a, x.d FROM {name}_p p JOIN {name}_e x ON x.snapshot = p.snapshot AND x.s = p.b),
{name} AS (SELECT p.snapshot, p.a AS id, min(p.b) AS component FROM {name}_p p JOIN {name}_p q ON q.snapshot = p.snapshot AND q.a = p.b AND q.b = p.a GROUP BY 1, 2 HAVING count(*) > 1)"""


_CYCLES = _scc_sql(f"SELECT DISTINCT snapshot, src AS s, dst_id AS d FROM e WHERE relation IN ('CALLS', 'IMPORTS') AND src <> dst_id AND {_EXISTS.format('src')} AND {_EXISTS.format('dst_id')}", "cyc")
_LOOPS = (
    _scc_sql(
        """SELECT snapshot, src AS s, dst_id AS d FROM e WHERE relation = 'CALLS' AND src <> dst_id
  UNION SELECT e.snapshot, CASE WHEN relation = 'READS' THEN dst_id ELSE src END, CASE WHEN relation = 'READS' THEN src ELSE dst_id END FROM e
    JOIN n ON n.snapshot = e.snapshot AND n.id = e.dst_id AND n.kind = 'Variable' WHERE relation IN ('READS', 'WRITES') AND src <> dst_id""",
        "dl",
    )
    + """, loops AS (SELECT * FROM dl WHERE (snapshot, component) IN (SELECT (dl.snapshot, dl.component) FROM dl JOIN n USING (snapshot, id) WHERE n.kind = 'Variable'))"""
)
_CYCLE_ISSUES = (
    _CYCLES
    + """, sums AS (SELECT a.snapshot, a.component, count(*) AS t, count(*) FILTER (e.provenance = 'extracted') AS c FROM e JOIN cyc a ON a.snapshot = e.snapshot AND a.id = e.src
  JOIN cyc b ON b.snapshot = e.snapshot AND b.id = e.dst_id AND b.component = a.component WHERE e.relation IN ('CALLS', 'IMPORTS') GROUP BY 1, 2),
issues AS (SELECT snapshot, component AS id, k.members, t AS n_edges, c AS confident_edges, round(0.3 + 0.6 * (c / t), 2) AS confidence, c / t < 0.5 AS needs_review
  FROM (SELECT cyc.snapshot, component, count(*) AS members, bool_and(kind IN ('Function', 'Method', 'Class')) AS code FROM cyc JOIN n USING (snapshot, id) GROUP BY 1, 2) k JOIN sums USING (snapshot, component) WHERE code AND c > 0)"""
)

_IMPACT = f"""
, back AS (SELECT snapshot, id, 0 AS hops FROM n WHERE id = '{CHANGED}' UNION SELECT l.snapshot, l.src, b.hops + 1 FROM back b JOIN live l ON l.snapshot = b.snapshot AND l.dst_id = b.id WHERE b.hops < 60),
sure AS (SELECT snapshot, id FROM n WHERE id = '{CHANGED}' UNION SELECT l.snapshot, l.src FROM sure b JOIN live l ON l.snapshot = b.snapshot AND l.dst_id = b.id WHERE l.provenance = 'extracted')
SELECT b.snapshot, b.id, CASE WHEN s.id IS NULL THEN 'ambiguous' ELSE 'confident' END AS tier, CAST(b.hops AS INTEGER) AS hops, list_contains(n.roles, 'test') AS is_test
FROM (SELECT snapshot, id, min(hops) AS hops FROM back GROUP BY 1, 2) b JOIN n USING (snapshot, id) LEFT JOIN sure s USING (snapshot, id) WHERE b.hops > 0"""

SQL = {
    "find_symbol": GRAPH + f"SELECT snapshot, id, kind, location, CASE WHEN count(*) OVER (PARTITION BY snapshot) > 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM n WHERE name = '{SYMBOL}'",
    "resolve_target": GRAPH
    + """, hits AS (SELECT snapshot, id, CASE WHEN id = 'Sink.write_out' THEN 0 ELSE 1 END AS r FROM n WHERE id = 'Sink.write_out' OR name = 'Sink.write_out' OR suffix(id, '.Sink.write_out') OR suffix(id, '::Sink.write_out'))
SELECT snapshot, id, count(*) OVER (PARTITION BY snapshot) AS n FROM (SELECT *, min(r) OVER (PARTITION BY snapshot) AS best FROM hits) WHERE r = best""",
    "get_callers": GRAPH + f"SELECT snapshot, src, round(weight, 3) AS weight, provenance FROM e WHERE relation = 'CALLS' AND dst_id = '{CALLED}'",
    "get_callees": GRAPH + f"SELECT snapshot, dst_id, round(weight, 3) AS weight, provenance FROM e WHERE relation = 'CALLS' AND src = '{CALLER}'",
    "call_confidence": GRAPH
    + f"""SELECT snapshot, calls, extracted, other_uses, CASE WHEN calls > 0 THEN round(0.4 + 0.5 * extracted / calls, 2) ELSE 0.6 END::DOUBLE AS confidence FROM (
  SELECT snapshot, count(*) FILTER (relation = 'CALLS') AS calls, count(*) FILTER (relation = 'CALLS' AND provenance = 'extracted') AS extracted, count(*) FILTER (relation <> 'CALLS') AS other_uses
  FROM e WHERE dst_id = '{CALLED}' GROUP BY 1)""",
    "find_holes": GRAPH + ", " + _HOLES + " SELECT snapshot, src, relation, missing FROM holes",
    "get_matrix": GRAPH
    + f""", ids AS (SELECT snapshot, id, row_number() OVER (PARTITION BY snapshot ORDER BY id) - 1 AS i FROM n WHERE {_SCOPED.format('id', 'services/core')})
SELECT e.snapshot, e.src, e.dst_id, CAST(a.i AS INTEGER) AS row, CAST(b.i AS INTEGER) AS col, max(round(e.weight, 2)) AS weight FROM e
JOIN ids a ON a.snapshot = e.snapshot AND a.id = e.src JOIN ids b ON b.snapshot = e.snapshot AND b.id = e.dst_id WHERE e.relation = 'CALLS' GROUP BY ALL""",
    "orient": GRAPH + "SELECT snapshot, kind, count(*) AS n_nodes FROM n GROUP BY 1, 2",
    "degrees": GRAPH + ", " + _DEGREES + " SELECT * FROM deg",
    "hubs": GRAPH
    + """SELECT snapshot, id, fan_in, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY fan_in DESC, id) AS INTEGER) AS place FROM (
  SELECT e.snapshot, e.dst_id AS id, count(*) AS fan_in FROM e JOIN n d ON d.snapshot = e.snapshot AND d.id = e.dst_id
  WHERE e.relation IN ('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES') AND e.provenance = 'extracted' AND d.kind IN ('Function', 'Method', 'Class') AND NOT d.is_test
    AND NOT EXISTS (SELECT 1 FROM n s WHERE s.snapshot = e.snapshot AND s.id = e.src AND s.is_test) GROUP BY 1, 2) QUALIFY place <= 10""",
    "pagerank": GRAPH
    + """, size AS (SELECT snapshot, count(*) AS k FROM n GROUP BY 1), sure AS (SELECT snapshot, src AS s, dst_id AS d FROM live WHERE provenance = 'extracted'),
outs AS (SELECT snapshot, s, count(*) AS o FROM sure GROUP BY 1, 2), links AS (SELECT a.snapshot, a.s, a.d, count(*) / max(o) AS w FROM sure a JOIN outs USING (snapshot, s) GROUP BY 1, 2, 3),
pr AS (
  SELECT n.snapshot, n.id, 1.0 / size.k AS r, 0 AS it FROM n JOIN size USING (snapshot)
  UNION ALL
  SELECT n.snapshot, n.id, 0.15 / size.k + 0.85 * coalesce(x.r, 0), t.it + 1
  FROM n JOIN size USING (snapshot) JOIN (SELECT max(it) AS it FROM pr) t ON t.it < 40
  LEFT JOIN (SELECT l.snapshot, l.d, sum(p.r * l.w) AS r FROM pr p JOIN links l ON l.snapshot = p.snapshot AND l.s = p.id GROUP BY 1, 2) x ON x.snapshot = n.snapshot AND x.d = n.id)
SELECT snapshot, id, round(r, 8) AS rank, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY round(r, 8) DESC, id) AS INTEGER) AS place FROM pr WHERE it = 40 QUALIFY place <= 10""",
    "live_set": GRAPH
    + ROOTS
    + """, u1 AS (SELECT DISTINCT m.snapshot, m.id FROM n m JOIN (SELECT DISTINCT snapshot, split_part(id, '::', 1) AS file FROM reached) f USING (snapshot, file)
  WHERE m.kind = 'Module' AND regexp_matches(m.file, '\\.(c|h|cc|cpp|cxx|hpp|hxx)$'))
SELECT snapshot, id FROM reached""",
    "find_stale": GRAPH
    + ROOTS
    + """, owners AS (SELECT DISTINCT snapshot, split_part(id, '::', 1) || '::' || array_to_string(q[:i], '.') AS id FROM (
  SELECT snapshot, id, q, unnest(range(1, len(q))) AS i FROM (SELECT snapshot, id, string_split(substr(id, strpos(id, '::') + 2), '.') AS q FROM reached WHERE strpos(id, '::') > 0)))
SELECT n.snapshot, n.id, n.kind, CASE WHEN max(list_contains(n.roles, 'runtime')::INT) OVER (PARTITION BY n.snapshot) = 1 THEN 0.78
  WHEN n.snapshot IN (SELECT snapshot FROM n WHERE list_contains(roles, 'runtime')) THEN 0.78 ELSE 0.6 END::DOUBLE AS confidence FROM n
WHERE n.kind IN ('Function', 'Method', 'Class') AND NOT (starts_with(n.name, '__') AND suffix(n.name, '__')) AND (n.snapshot, n.id) NOT IN (SELECT (snapshot, id) FROM reached)
  AND NOT (n.kind = 'Class' AND (n.snapshot, n.id) IN (SELECT (snapshot, id) FROM owners))""",
    "reach_hops": GRAPH
    + ROOTS
    + """, walk AS (SELECT snapshot, id, 0 AS hops FROM roots UNION SELECT l.snapshot, l.dst_id, w.hops + 1 FROM walk w JOIN live l ON l.snapshot = w.snapshot AND l.src = w.id WHERE w.hops < 60)
SELECT snapshot, CAST(hops AS INTEGER) AS hops, count(*) AS n_nodes FROM (SELECT snapshot, id, min(hops) AS hops FROM walk GROUP BY 1, 2) GROUP BY 1, 2""",
    "trace_path": GRAPH
    + f""", sound AS (SELECT snapshot, src, dst_id, max(least(greatest(weight, 1e-9), 1.0)) AS w FROM e WHERE {_EXISTS.format('src')} AND {_EXISTS.format('dst_id')} GROUP BY 1, 2, 3),
ways AS (
  SELECT snapshot, id, 1.0::DOUBLE AS p, 0 AS hops, [id] AS path FROM n WHERE id = '{CALLER}'
  UNION ALL
  SELECT snapshot, dst_id, -k.a, hops, k.b FROM (
    SELECT w.snapshot, s.dst_id, w.hops + 1 AS hops, min(struct_pack(a := -(w.p * s.w), b := list_append(w.path, s.dst_id))) AS k
    FROM ways w JOIN sound s ON s.snapshot = w.snapshot AND s.src = w.id WHERE w.hops < 25 AND NOT list_contains(w.path, s.dst_id) GROUP BY 1, 2, 3))
SELECT snapshot, round(p, 6) AS confidence, CAST(hops AS INTEGER) AS hops, path FROM ways WHERE id = '{SINK}' QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY p DESC, hops, path) = 1""",
    "transitive_fan_in": GRAPH
    + """, anc AS (SELECT snapshot, id AS a, id AS b FROM n WHERE NOT is_test UNION SELECT x.snapshot, x.a, l.dst_id FROM anc x JOIN live l ON l.snapshot = x.snapshot AND l.src = x.b AND l.provenance = 'extracted')
SELECT snapshot, b AS id, count(*) AS fan_in FROM anc WHERE a <> b GROUP BY 1, 2""",
    "transitive_fan_in_sampled": GRAPH
    + """, pool AS (SELECT snapshot, id, row_number() OVER (PARTITION BY snapshot ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY snapshot) AS size FROM n WHERE NOT is_test),
seeds AS (SELECT snapshot, id FROM pool WHERE k % greatest(size // 64, 1) = 0),
reached AS (SELECT snapshot, id AS a, id AS b FROM seeds UNION SELECT x.snapshot, x.a, l.dst_id FROM reached x JOIN live l ON l.snapshot = x.snapshot AND l.src = x.b AND l.provenance = 'extracted'),
kept AS (SELECT snapshot, count(*) AS kept FROM seeds GROUP BY 1), sizes AS (SELECT DISTINCT snapshot, size FROM pool)
SELECT snapshot, b AS id, count(*) * any_value(size) / any_value(kept) AS fan_in FROM reached JOIN kept USING (snapshot) JOIN sizes USING (snapshot) WHERE a <> b GROUP BY 1, 2""",
    "giant_component": GRAPH
    + """, links AS (SELECT snapshot, src AS s, dst_id AS d FROM live WHERE src <> dst_id UNION SELECT snapshot, dst_id, src FROM live WHERE src <> dst_id),
lab AS (SELECT DISTINCT snapshot, s AS id, s AS label FROM links UNION SELECT l.snapshot, k.d, l.label FROM lab l JOIN links k ON k.snapshot = l.snapshot AND k.s = l.id WHERE l.label < k.d),
comp AS (SELECT snapshot, id, min(label) AS component FROM lab GROUP BY 1, 2)
SELECT snapshot, component, n_nodes FROM (SELECT snapshot, component, count(*) AS n_nodes FROM comp GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY n_nodes DESC, component) = 1""",
    "scan": GRAPH
    + ROOTS
    + ", "
    + ", ".join([_HOLES, _CYCLE_ISSUES, _LOOPS, _ALL_GODS + ")"])
    + f""", certain AS (SELECT snapshot, id FROM roots UNION SELECT l.snapshot, l.dst_id FROM certain r JOIN live l ON l.snapshot = r.snapshot AND l.src = r.id WHERE l.provenance = 'extracted'),
stubs AS (SELECT n.snapshot, n.id, r.id IS NOT NULL AND NOT (list_contains(n.roles, 'test') OR {test_path('n.id')}) AS live, c.id IS NOT NULL AS sure
  FROM n LEFT JOIN reached r USING (snapshot, id) LEFT JOIN certain c ON c.snapshot = n.snapshot AND c.id = n.id WHERE n.is_stub)
SELECT snapshot, CASE WHEN live THEN 'live_stub' ELSE 'stub' END AS issue, id, '' AS detail, CASE WHEN live AND sure THEN 'red' WHEN live THEN 'orange' ELSE 'green' END AS urgency FROM stubs
UNION ALL SELECT x.snapshot, 'hole', x.src, x.relation || ' ' || x.missing, CASE WHEN r.id IS NULL THEN 'green' ELSE 'orange' END FROM holes x LEFT JOIN reached r ON r.snapshot = x.snapshot AND r.id = x.src
UNION ALL SELECT snapshot, 'cycle', id, CAST(members AS VARCHAR), CASE WHEN needs_review THEN 'green' ELSE 'orange' END FROM issues
UNION ALL SELECT snapshot, 'data_loop', component, CAST(count(*) AS VARCHAR), 'orange' FROM loops GROUP BY 1, 3
UNION ALL SELECT snapshot, 'god_object', id, fan_in || '/' || fan_out, CASE WHEN needs_review THEN 'green' ELSE 'orange' END FROM gods""",
    "impact_of": GRAPH + _IMPACT,
    "cycles": GRAPH + ", " + _CYCLES + " SELECT snapshot, id, component FROM cyc",
    "self_loops": GRAPH + f"SELECT DISTINCT snapshot, src AS id FROM e WHERE relation IN ('CALLS', 'IMPORTS') AND src = dst_id AND {_EXISTS.format('src')}",
    "cycle_issues": GRAPH + ", " + _CYCLE_ISSUES + " SELECT * FROM issues",
    "data_loops": GRAPH + ", " + _LOOPS + " SELECT snapshot, id, component FROM loops",
    "god_objects": GRAPH + ", " + _GODS + " SELECT * FROM gods",
    "graph_diff": GRAPH
    + """, keys AS (
  SELECT snapshot, 'node' AS what, kind || ' ' || name AS key FROM n
  UNION ALL SELECT e.snapshot, 'edge', coalesce(a.name, e.src) || ' ' || e.relation || ' ' || coalesce(b.name, e.dst_symbol) FROM e
    LEFT JOIN n a ON a.snapshot = e.snapshot AND a.id = e.src LEFT JOIN n b ON b.snapshot = e.snapshot AND b.id = e.dst_id)
SELECT CASE WHEN k > 0 THEN 'new' ELSE 'old' END AS side, what, key, abs(k) AS n FROM (
  SELECT what, key, count(*) FILTER (snapshot = 4) - count(*) FILTER (snapshot = 1) AS k FROM keys GROUP BY 1, 2) WHERE k <> 0""",
    "summarize_subsystem": GRAPH
    + ", "
    + _DEGREES
    + f""", ids AS (SELECT * FROM n WHERE {_SCOPED.format('id', SUBSYSTEM)}),
surface AS (SELECT e.snapshot, e.dst_id AS id, count(*) AS k FROM e JOIN ids ON ids.snapshot = e.snapshot AND ids.id = e.dst_id WHERE NOT {_SCOPED.format('e.src', SUBSYSTEM)} GROUP BY 1, 2)
SELECT snapshot, 'kind' AS part, kind AS item, count(*) AS n FROM ids GROUP BY 1, 2, 3
UNION ALL SELECT snapshot, 'read_first', substr(id, strpos(id, '::') + 2), fan_in FROM (SELECT deg.* FROM deg JOIN ids USING (snapshot, id) QUALIFY row_number() OVER (PARTITION BY deg.snapshot ORDER BY fan_in DESC, deg.id) <= 8)
UNION ALL SELECT snapshot, 'public_surface', substr(id, strpos(id, '::') + 2), k FROM (SELECT * FROM surface QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY k DESC, id) <= 8)
UNION ALL SELECT snapshot, 'depends_on', item, 0 FROM (SELECT DISTINCT snapshot, split_part(dst_id, '::', 1) AS item FROM e WHERE {_SCOPED.format('src', SUBSYSTEM)} AND NOT {_SCOPED.format('dst_id', SUBSYSTEM)}
  QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY item) <= 12)""",
}

"""Sweeps and circles against plain walks on small random graphs."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwright.operators import circles, sweeps
from meshwright.operators.graph import CODE_KINDS, Graph, clean_edges, clean_nodes, dedup_holes, dedup_resolved, roots
from meshwright.plans import graphops

ADJ = "snapshot int, s string, d string"


def closure(edges, start):
    seen, todo = {start: 0}, [start]
    for x in todo:
        for a, b in edges:
            if a == x and b not in seen:
                seen[b] = seen[x] + 1
                todo.append(b)
    return seen


def graphs(n_graphs=6, n=9, m=16):
    rng = random.Random(11)
    return {g: [(rng.choice("abcdefghi"[:n]), rng.choice("abcdefghi"[:n])) for _ in range(m)] for g in range(n_graphs)}


def adjacency(spark, gs):
    return spark.createDataFrame([(g, s, d) for g, es in gs.items() for s, d in es], ADJ)


BOTH = pytest.mark.parametrize("local", [0, 10_000])


@BOTH
def test_reach_and_reverse(spark, local):
    gs = graphs()
    adj = adjacency(spark, gs)
    seeds = spark.createDataFrame([(g, "a") for g in gs] + [(0, "a")], "snapshot int, id string")
    got = {(r.snapshot, r.id): r.hops for r in sweeps.reach(adj, seeds, local_edges=local).collect()}
    assert got == {(g, x): h for g, es in gs.items() for x, h in closure(es, "a").items()}
    back = {(r.snapshot, r.id): r.hops for r in sweeps.reach(sweeps.reverse(adj), seeds, local_edges=local).collect()}
    assert back == {(g, x): h for g, es in gs.items() for x, h in closure([(b, a) for a, b in es], "a").items()}
    assert sweeps.reach(adj, seeds.limit(0), local_edges=local).collect() == []


@BOTH
def test_lanes_equal_single_sweeps(spark, local):
    rng = random.Random(2)
    ids = [f"n{i}" for i in range(70)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(120)]
    adj = spark.createDataFrame([(1, s, d) for s, d in edges], ADJ)
    groups = spark.createDataFrame([(1, f"g{i:02d}", x) for i, x in enumerate(ids)] + [(1, "g00", "n69")], "snapshot int, group string, id string")
    numbered = sweeps.lanes(groups)
    labels = sweeps.lane_reach(adj, numbered.select("snapshot", "word", "id", "mask"), local_edges=local).collect()
    number = {r.group: r.number for r in numbered.collect()}
    assert sorted(set(number.values())) == list(range(70))
    got = {(r.word * 64 + b, r.id) for r in labels for b in range(64) if r.mask >> b & 1}
    want = {(number[f"g{i:02d}"], y) for i, x in enumerate(ids) for y in closure(edges, x)} | {(number["g00"], y) for y in closure(edges, "n69")}
    assert got == want


@BOTH
def test_strong_components(spark, local):
    gs = graphs()
    got = {}
    for r in circles.scc(adjacency(spark, gs), local_edges=local).collect():
        got.setdefault((r.snapshot, r.component), set()).add(r.id)
    want = {}
    for g, es in gs.items():
        reach = {x: set(closure(es, x)) for x in "abcdefghi"}
        for x in reach:
            same = {y for y in reach[x] if x in reach[y]}
            if len(same) > 1:
                want[(g, min(same))] = same
    assert got == want
    assert circles.scc(adjacency(spark, {1: [("a", "b"), ("b", "c"), ("c", "c")]}), local_edges=local).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_cut_vertices(edges):
    def pieces(nodes):
        left, out = set(nodes), []
        both = [(a, b) for a, b in edges if a in left and b in left] + [(b, a) for a, b in edges if a in left and b in left]
        while left:
            found = set(closure(both, min(left)))
            out.append(found)
            left -= found
        return out

    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = {}
    for comp in pieces(nodes):
        for x in comp:
            rest = [len(p) for p in pieces(comp - {x})]
            if len(rest) > 1:
                want[x] = sum(rest) - max(rest)
    assert circles.cut_vertices(edges) == want
    kept = circles.certificate([e for e in edges if e[0] != e[1]])
    assert circles.cut_vertices(kept) == want and len(kept) <= 2 * max(0, len(nodes) - 1)


def test_articulation_by_tree(spark):
    gs = {1: [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("e", "g"), ("e", "h"), ("x", "x")], 2: [("a", "b"), ("b", "c"), ("c", "a")]}
    for size in (2, 1000):
        got = {(r.snapshot, r.id): r.blast_radius for r in circles.articulation(adjacency(spark, gs), edges_per_chunk=size, fan_in=2).collect()}
        assert got == {(1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (1, "e"): 3}


@BOTH
def test_components(spark, local):
    gs = {1: [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], 2: [("a", "a")]}
    adj = adjacency(spark, gs)
    ids = spark.createDataFrame(sorted({(g, x) for g, es in gs.items() for e in es for x in e}), "snapshot int, id string")
    got = {(r.snapshot, r.id): r.component for r in sweeps.components(ids, adj, local_edges=local).collect()}
    assert {got[(1, f"n{i:02d}")] for i in range(21)} == {"n00"} and got[(1, "y")] == "x" and got[(2, "a")] == "a"


@BOTH
def test_best_path(spark, local):
    edges = [(1, "a", "b", 0.9), (1, "b", "c", 0.9), (1, "a", "c", 0.8), (1, "c", "d", 0.5), (1, "a", "d", 0.41), (1, "b", "a", 1.0)]
    df = spark.createDataFrame(edges, "snapshot int, s string, d string, w double")
    got = {r.id: (round(r.score, 9), r.path) for r in sweeps.best_paths(df, spark.createDataFrame([(1, "a")], "snapshot int, id string"), local_edges=local).collect()}
    assert got == {"a": (1.0, ["a"]), "b": (0.9, ["a", "b"]), "c": (0.81, ["a", "b", "c"]), "d": (0.41, ["a", "d"])}


@BOTH
def test_pagerank(spark, local):
    edges = [("a", "b"), ("a", "b"), ("a", "c"), ("c", "a"), ("b", "c"), ("d", "c")]
    adj = adjacency(spark, {1: edges})
    nodes = spark.createDataFrame([(1, x) for x in "abcd"], "snapshot int, id string")
    rank = dict.fromkeys("abcd", 0.25)
    out = {x: sum(a == x for a, _ in edges) for x in "abcd"}
    for _ in range(7):
        rank = {x: 0.15 / 4 + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == x) for x in "abcd"}
    got = {r.id: r["rank"] for r in sweeps.pagerank(nodes, adj, rounds=7, every=3, local_edges=local).collect()}
    assert got == pytest.approx(rank)


EDGES = "snapshot int, seq long, src string, relation string, dst_symbol string, dst_id string, weight double, provenance string, source string, name_based boolean, id string"


def test_cleaning_and_dedup(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, "a", " calls", "b", "b", 0.5, "extracted", "x", False, "z"), (1, 2, "a", "CALLS", "b", "b", 0.7, "inferred", "x", True, "z"), (1, 3, "a", "CALLS ", "b", "b", 0.7, "extracted", "x", None, "z"),
        (1, 4, "a", "REFERENCES", "b", "b", 1.0, "extracted", "x", False, "z"), (1, 5, "a", "references", "a", "a", 1.0, "extracted", "x", False, "z"), (1, 6, "a", "REFERENCES", "c", "c", nan, "odd", "x", False, "z"),
        (1, 7, "a", "NONSENSE", "c", "c", 1.0, "extracted", "x", False, "z"), (1, 8, None, "CALLS", "c", "c", 1.0, "extracted", "x", False, "z"), (1, 9, "a", "CALLS", None, "c", 1.0, "extracted", "x", False, "z"),
        (1, 10, "a", "CALLS", "gone", None, None, None, "x", False, "z"), (1, 11, "a", "CALLS", "gone", None, inf, None, "x", True, "z"), (1, 12, "b", None, "c", "c", 1.0, "extracted", "x", False, "z"), (1, 13, "b", "CALLS", "c", "c", inf, None, "x", False, "z"),
    ]
    clean = clean_edges(spark.createDataFrame(rows, EDGES))
    got = {(r.src, r.relation, r.dst_id): (r.weight, r.provenance, r.name_based, r.seq) for r in dedup_resolved(clean).collect()}
    assert got == {("a", "CALLS", "b"): (0.7, "inferred", True, 2), ("a", "REFERENCES", "c"): (1.0, "ambiguous", False, 6), ("b", "CALLS", "c"): (1.0, "ambiguous", False, 13)}
    assert [(r.dst_symbol, r.name_based, r.seq) for r in dedup_holes(clean).collect()] == [("gone", True, 10)]


NODES = "snapshot int, id string, kind string, name string, location string, end_line int, is_stub boolean, arity int, summary string, roles array<string>, ingested_at timestamp, place int"


def test_roots_and_poisoned_nodes(spark):
    node = lambda i, k="Function", roles=(), name="n": (1, i, k, name, None, None, None, None, None, list(roles), None, 0)
    rows = [
        node("a.py::f", roles=["exported"]), node("a.py::a", "Module"), node("b.py::b", "Module"), node("b.py::g"), node("go/x.go::x", "Module"), node("go/y.go::main", roles=["main"]), node("r", "Route"),
        node("c.py::c", "Class"), node("c.py::t", roles=["test", "test"]), node("bad", "Nonsense"), node(None), node("noname", name=None), node("g/z.py::z", "Module"),
    ]
    shared = spark.createDataFrame([("s", "Function", "n", None, ["exported", "exported"])], "id string, kind string, name string, location string, roles array<string>")
    nodes = clean_nodes(spark.createDataFrame(rows, NODES), shared, [1, 2])
    ids = {(r.snapshot, r.id) for r in nodes.collect()}
    assert (1, "bad") not in ids and (1, "noname") not in ids and (2, "s") in ids and (1, "s") in ids
    got = {r.id for r in roots(nodes).where("snapshot = 1").collect()}
    assert got == {"a.py::f", "a.py::a", "go/x.go::x", "go/y.go::main", "r", "c.py::c", "c.py::t", "s"}
    assert roots(nodes.limit(0)).collect() == [] and CODE_KINDS


def test_ids(spark):
    from meshwright.functions import ids

    names = ["a/b.py::C.m#2", "a/b.py::f", "plain", "tests/x.py::f", "p/test_y.py::g", "a/b.ts::C.D.e", None]
    df = spark.createDataFrame([(n,) for n in names], "id string")
    c = F.col("id")
    rows = df.select(ids.file_of(c), ids.qual_of(c), ids.owner_of(c), ids.is_test_path(c), ids.language_of(c), ids.leaf_of(c), ids.under_scope(c, "a/b.py::C")).collect()
    assert [tuple(r) for r in rows] == [
        ("a/b.py", "C.m#2", "a/b.py::C", False, "python", "m#2", True), ("a/b.py", "f", None, False, "python", "f", False), ("plain", "", None, False, None, "plain", False),
        ("tests/x.py", "f", None, False, "python", "f", False), ("p/test_y.py", "g", None, True, "python", "g", False), ("a/b.ts", "C.D.e", "a/b.ts::C.D", False, "js", "e", False), (None, None if rows[6][1] is None else "", None, None, None, None, None),
    ]
    tests = ["f.py::t", "f.py::C::t[a|b]|run", "f.py::t[x[1]]", "f.py::t|setup", "x|runs", "t[a\nb]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tests], "t string").select(ids.base_test_id(F.col("t"))).collect()]
    assert got[:5] == ["f.py::t", "f.py::C.t", "f.py::t", "f.py::t", "x|runs"]


def test_self_loops(spark):
    from meshwright.plans import graphops

    nodes = spark.createDataFrame([(1, x) for x in "abc"], "snapshot int, id string")
    edges = spark.createDataFrame([(1, "a", "CALLS", "a"), (1, "a", "IMPORTS", "a"), (1, "b", "READS", "b"), (1, "b", "CALLS", "c"), (1, "c", "CALLS", "b"), (1, "x", "CALLS", "x")], "snapshot int, src string, relation string, dst_id string")
    assert [tuple(r) for r in graphops.self_loops(Graph(nodes, edges, edges)).collect()] == [(1, "a")]


def test_matrix_of_a_wide_scope(spark):
    from meshwright.plans import graphops

    rows = [(1, f"s/a.py::f{i:02d}", "Function", f"f{i:02d}", None, None, None, None, None, [], None, 0) for i in range(30)]
    nodes = clean_nodes(spark.createDataFrame(rows, NODES), spark.createDataFrame([], "id string, kind string, name string, location string, roles array<string>"), [1])
    edges = spark.createDataFrame([(1, "s/a.py::f29", "CALLS", "s/a.py::f03", 0.5)], "snapshot int, src string, relation string, dst_id string, weight double")
    g = Graph(nodes, edges, edges)
    assert [tuple(r) for r in graphops.relation_matrix(g, "s").collect()] == [(1, "s/a.py::f29", "s/a.py::f03", 29, 3, 0.5)]
    assert graphops.relation_matrix(g, "s", limit=29).collect() == []


def test_operations_do_not_raise_on_an_empty_graph(spark):
    from meshwright.plans import graphops

    nodes = clean_nodes(spark.createDataFrame([], NODES), spark.createDataFrame([], "id string, kind string, name string, location string, roles array<string>"), [1])
    edges = clean_edges(spark.createDataFrame([], EDGES))
    g = Graph(nodes, dedup_resolved(edges), dedup_holes(edges))
    for op, args in itertools.chain(
        [(graphops.find_stale, ()), (graphops.scan, ()), (graphops.find_holes, ()), (graphops.hubs, ()), (graphops.chokepoints, ()), (graphops.data_loops, ())],
        [(graphops.impact_of, ("x",)), (graphops.trace_path, ("x", "y")), (graphops.summarize, ("x",)), (graphops.relation_matrix, ("x",)), (graphops.graph_diff, (1, 2))],
    ):
        assert op(g, *args).collect() == []


def test_scan_lists_every_god_object_that_needs_review(spark):
    light, heavy = [f"a.py::f{i}" for i in range(10_500)], [f"b.py::g{i}" for i in range(510)]
    links = list(itertools.pairwise(light)) + [(x, heavy[(i + k) % len(heavy)]) for i, x in enumerate(heavy) for k in range(1, 7)]
    nodes = spark.createDataFrame([(1, x, "Function", x[6:], False, [], x[:4]) for x in light + heavy], "snapshot int, id string, kind string, name string, is_stub boolean, roles array<string>, file string")
    edges = spark.createDataFrame([(1, s, "CALLS", d, d, 1.0, "ambiguous", True) for s, d in links], "snapshot int, src string, relation string, dst_id string, dst_symbol string, weight double, provenance string, name_based boolean")
    graph = Graph(nodes, edges, edges.limit(0).select("snapshot", "src", "relation", "dst_symbol"))
    found = graphops.scan(graph).where("issue = 'god_object'")
    assert {(r.id, r.urgency) for r in found.collect()} == {(x, "green") for x in heavy}


RINGED = ["cycles", "cycle_issues", "data_loops", "scan"]


@pytest.mark.parametrize("name", RINGED)
def test_a_ring_of_many_edges_needs_no_rounds(spark, monkeypatch, name):
    monkeypatch.setattr(circles, "_labels", lambda *_: pytest.fail("rounds along the ring"))
    n = 21_000
    ring = [f"a.py::f{i:05d}" for i in range(n)]
    nodes = spark.createDataFrame([(1, x, "Function", x[6:], False, [], x[:4]) for x in ring] + [(1, "v", "Variable", "v", False, [], "v")], "snapshot int, id string, kind string, name string, is_stub boolean, roles array<string>, file string")
    links = [(x, "CALLS", ring[(i + 1) % n]) for i, x in enumerate(ring)] + [(ring[5], "WRITES", "v"), (ring[3], "READS", "v")]
    edges = spark.createDataFrame([(1, s, r, d, d, 1.0, "extracted", False) for s, r, d in links], "snapshot int, src string, relation string, dst_id string, dst_symbol string, weight double, provenance string, name_based boolean")
    graph = Graph(nodes, edges, edges.limit(0).select("snapshot", "src", "relation", "dst_symbol"))
    found = getattr(graphops, name)(graph)
    if name in ("cycles", "data_loops"):
        assert {(r.id, r.component) for r in found.collect()} == {(x, ring[0]) for x in ring + ["v"] * (name == "data_loops")}
    elif name == "cycle_issues":
        assert [(r.id, r.members, r.n_edges) for r in found.collect()] == [(ring[0], n, n)]
    else:
        assert {(r.issue, r.detail) for r in found.collect()} >= {("cycle", str(n)), ("data_loop", str(n + 1))}


@pytest.mark.parametrize("chunk", [64, 16_384])
def test_lane_counts_equal_closures(spark, chunk):
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(90)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(100)]
    reach = {x: set(closure(edges, x)) for x in ids}
    asked = {x: rng.sample(ids, 5) for x in ids}
    rows = [(1, i, x, True) for i, x in enumerate(ids)] + [(1, 0, "n89", True)] + [(1, i, y, False) for i, x in enumerate(ids) for y in asked[x]]
    reach_0 = reach["n0"] | reach["n89"]
    adj, lanes = spark.createDataFrame([(1, s, d) for s, d in edges], ADJ), spark.createDataFrame(rows, "snapshot int, lane long, id string, seed boolean")
    of = {x: reach_0 if x == "n0" else reach[x] for x in ids}
    got = {r.lane: (r.n, r.hit) for r in sweeps.lane_counts(adj, lanes, by_node=False, chunk=chunk).collect()}
    assert got == {i: (len(of[x]), len(of[x] & set(asked[x]))) for i, x in enumerate(ids)}
    by_node = {r.id: r.n for r in sweeps.lane_counts(adj, lanes, by_node=True, chunk=chunk).collect()}
    assert by_node == {y: sum(y in of[x] for x in ids) for y in ids}


SAMPLES = [64, 1 << 30]


@pytest.mark.parametrize("samples", SAMPLES)
def test_fan_in_of_a_chain_makes_no_rows_of_lanes(spark, monkeypatch, samples):
    monkeypatch.setattr(sweeps, "lane_reach", lambda *_, **__: pytest.fail("a row for each word of lanes and node"))
    chain = [f"a.py::f{i:03d}" for i in range(128)]
    nodes = spark.createDataFrame([(1, x, "Function", x[6:], False, [], x[:4]) for x in chain], "snapshot int, id string, kind string, name string, is_stub boolean, roles array<string>, file string")
    edges = spark.createDataFrame([(1, s, "CALLS", d, d, 1.0, "extracted", True) for s, d in itertools.pairwise(chain)], "snapshot int, src string, relation string, dst_id string, dst_symbol string, weight double, provenance string, name_based boolean")
    found = graphops.transitive_fan_in(Graph(nodes, edges, edges.limit(0).select("snapshot", "src", "relation", "dst_symbol")), samples)
    step = max(128 // samples, 1)
    want = {x: sum(j < i for j in range(0, 128, step)) * step for i, x in enumerate(chain)}
    assert {r.id: r.fan_in for r in found.collect()} == {x: n for x, n in want.items() if n}


def test_sampled_lanes_are_numbered_without_gaps(spark, monkeypatch):
    ids = [f"a.py::f{i:03d}" for i in range(90)]
    nodes = spark.createDataFrame([(p, x, "Function", x[6:], False, [], x[:4]) for p in (1, 2) for x in ids], "snapshot int, id string, kind string, name string, is_stub boolean, roles array<string>, file string")
    edges = spark.createDataFrame([(p, s, "CALLS", d, d, 1.0, "extracted", True) for p in (1, 2) for s, d in itertools.pairwise(ids)], "snapshot int, src string, relation string, dst_id string, dst_symbol string, weight double, provenance string, name_based boolean")
    given, counts = [], sweeps.lane_counts
    monkeypatch.setattr(sweeps, "lane_counts", lambda adj, lanes, **k: given.append(lanes) or counts(adj, lanes, **k))
    found = graphops.transitive_fan_in(Graph(nodes, edges, edges.limit(0).select("snapshot", "src", "relation", "dst_symbol")), 30)
    assert {(r.snapshot, r.lane) for r in given[0].collect()} == {(p, i) for p in (1, 2) for i in range(30)}
    assert {(r.snapshot, r.id): r.fan_in for r in found.collect()} == {(p, x): n for p in (1, 2) for i, x in enumerate(ids) if (n := -(-i // 3) * 3)}


def test_exact_fan_in_takes_the_edges_of_a_snapshot_few_times(spark, monkeypatch):
    nodes = spark.createDataFrame([(1, f"a.py::{x}", "Function", x, False, [], "a.py") for x in "fgh"], "snapshot int, id string, kind string, name string, is_stub boolean, roles array<string>, file string")
    edges = spark.createDataFrame([(1, "a.py::f", "CALLS", "a.py::g", "g", 1.0, "extracted", True)], "snapshot int, src string, relation string, dst_id string, dst_symbol string, weight double, provenance string, name_based boolean")
    asked, counts = [], sweeps.lane_counts
    monkeypatch.setattr(sweeps, "lane_counts", lambda *a, **k: asked.append(k.get("chunk", 16_384)) or counts(*a, **k))
    found = graphops.transitive_fan_in(Graph(nodes, edges, edges.limit(0).select("snapshot", "src", "relation", "dst_symbol")), 1 << 30)
    assert [(r.id, r.fan_in) for r in found.collect()] == [("a.py::g", 1)] and -(-200_000 // asked[0]) <= 4

from pyspark.sql import functions as F

from meshwright.functions.envelope import Result, refuse, share_confidence
from meshwright.operators import maintain
from meshwright.operators.graph import Graph
from meshwright.sources import pysource
from meshwright.streaming import filewatch, orphanwatch

NODES = "snapshot int, id string, kind string, name string, location string, end_line int, is_stub boolean, arity int, summary string, roles array<string>, file string"
EDGES = "snapshot int, src string, relation string, dst_symbol string, dst_id string, weight double, provenance string, source string, name_based boolean"
HOLES = "snapshot int, src string, relation string, dst_symbol string, name_based boolean"


def node(i, kind="Function", name=None):
    return (1, i, kind, name or i.rsplit("::", 1)[-1].rsplit(".", 1)[-1], None, None, False, None, None, [], i.split("::")[0])


def graph(spark, nodes, edges, holes=()):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(1, *e) for e in edges], EDGES), spark.createDataFrame([(1, *h) for h in holes], HOLES))


def test_holes_bind_or_fan_out(spark):
    nodes = [node("a.py::f"), node("b.py::f"), node("c.py::g"), node("d.js::g"), node("m.py::m", "Module"), node("e.zig::h")]
    holes = [("x.py::s", "CALLS", "f", False), ("x.py::s", "CALLS", "g", False), ("x.py::s", "CALLS", "m", False), ("x.py::s", "IMPORTS", "m", False), ("x.py::s", "CALLS", "h", False), ("x.py::s", "CALLS", "none", False)]
    got = {(r.relation, r.dst_symbol, r.dst_id): (r.weight, r.provenance) for r in maintain.resolve_holes(graph(spark, nodes, [], holes)).collect()}
    assert got == {
        ("CALLS", "f", "a.py::f"): (0.5, "ambiguous"), ("CALLS", "f", "b.py::f"): (0.5, "ambiguous"), ("CALLS", "g", "c.py::g"): (1.0, "inferred"),
        ("IMPORTS", "m", "m.py::m"): (1.0, "inferred"), ("CALLS", "h", "e.zig::h"): (1.0, "inferred"),
    }


def test_overrides_follow_the_subclasses(spark):
    nodes = [node("p.py::A", "Class"), node("p.py::B", "Class"), node("q.py::C", "Class"), node("p.py::A.m", "Method"), node("p.py::B.m", "Method"), node("q.py::C.m", "Method"), node("q.py::C.k", "Method"), node("z.py::s")]
    e = lambda s, r, d: (s, r, d.rsplit(".", 1)[-1], d, 1.0, "extracted", "ast", False)
    g = graph(spark, nodes, [e("p.py::B", "INHERITS", "p.py::A"), e("q.py::C", "INHERITS", "p.py::B"), e("z.py::s", "CALLS", "p.py::A.m"), e("z.py::s", "CALLS", "p.py::B.m"), e("z.py::s", "READS", "q.py::C.k")])
    assert {(r.src, r.dst_symbol, r.dst_id) for r in maintain.override_edges(g).collect()} == {("z.py::s", "m", "q.py::C.m")}


def test_overrides_of_circular_subclasses(spark):
    names = ["D", "A", "B", "C"]
    nodes = [n for c in names for n in (node(f"p.py::{c}", "Class"), node(f"p.py::{c}.m", "Method"))] + [node("z.py::s")]
    e = lambda s, r, d: (s, r, d.rsplit(".", 1)[-1], d, 1.0, "extracted", "ast", False)
    up = [e(f"p.py::{a}", "INHERITS", f"p.py::{b}") for a, b in ("DA", "AB", "BC", "CB")]
    g = graph(spark, nodes, [*up, e("z.py::s", "CALLS", "p.py::B.m")])
    assert maintain.override_edges(g).collect() == []
    assert {r.dst_id for r in maintain.override_edges(g, circular=True).collect()} == {"p.py::D.m", "p.py::A.m", "p.py::C.m"}


def test_compression_keeps_the_rows(spark):
    rows = [("s", "CALLS", "f", f"t{i}", 0.25, "ambiguous", "ast", True) for i in range(4)] + [("r", "CALLS", "f", f"t{i}", 0.25, "ambiguous", "ast", True) for i in range(4)]
    rows += [("u", "CALLS", "g", "t0", 0.5, "ambiguous", "ast", True), ("u", "CALLS", "g", "t1", 0.4, "ambiguous", "ast", True), ("v", "CALLS", "h", "t0", 1.0, "extracted", "ast", False), ("w", "CALLS", "f", "t0", 0.5, "ambiguous", None, True), ("w", "CALLS", "f", "t1", 0.5, "ambiguous", None, True)]
    g = graph(spark, [], rows)
    packed = maintain.compress(g.edges)
    assert packed.groups.count() == 2 and packed.sets.count() == 1 and packed.flat.count() == 5
    assert sorted(map(str, maintain.expand(packed).collect())) == sorted(map(str, g.edges.collect()))


def test_exported_roles(spark):
    g = graph(spark, [node("a"), (*node("b")[:9], ["exported", "test"], "b")], [])
    got = {r.id: r.roles for r in maintain.sync_exported(g.nodes, spark.createDataFrame([(1, "a")], "snapshot int, id string")).collect()}
    assert got == {"a": ["exported"], "b": ["test"]}


def state(g):
    edges = {(r.src, r.relation, r.dst_symbol, r.dst_id, r.weight, r.provenance) for r in g.edges.where("name_based").collect()}
    return {r.id for r in g.nodes.collect()}, edges


def test_watch_equals_a_full_build(spark, tmp_path):
    def caller(name):
        return f"def {name}(x):\n    return x.work()\n"

    steps = [
        {"a.py": "def work(): return 1\n", "c.py": caller("go")},
        {"b.py": "def work(): return 2\n"},
        {"a.py": "def rest(): return 1\n", "c.py": caller("run")},
        {"b.py": None},
    ]
    log = tmp_path / "log"
    watch = filewatch.GraphWatch(spark, str(tmp_path / "graph"))
    now = {}
    for i, step in enumerate(steps):
        spark.createDataFrame([(1, p, t) for p, t in step.items()], filewatch.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(log))
        watch.start(spark.readStream.schema(filewatch.LOG_SCHEMA).parquet(str(log)), str(tmp_path / "ck")).awaitTermination(120)
        now |= step
        files = spark.createDataFrame([(1, p, t) for p, t in now.items() if t is not None], filewatch.LOG_SCHEMA)
        nodes = pysource.definitions(files)
        full = Graph(nodes, pysource.resolve(nodes, pysource.references(files)), None)
        ids, edges = state(watch.load(watch.version))
        want_ids, want = state(full)
        assert ids == want_ids
        strip = lambda es: {x[:5] for x in es}
        assert strip(edges) == strip(want), i


def test_orphan_stream_equals_the_batch(spark, tmp_path):
    log = tmp_path / "log"
    watch = orphanwatch.OrphanWatch(spark, str(tmp_path / "state"))
    deliveries = [
        [(1, "parent", "id", "a", None, None), (1, "reference", "id", "a", 1, "dst"), (1, "reference", "id", "b", 2, "dst"), (1, "reference", "id", "never", 3, "dst")],
        [(2, "parent", "id", "b", None, None), (2, "reference", "id", "a", 4, "dst"), (2, "reference", "id", "b", 5, "dst")],
        [(3, "parent", "id", "a", None, None), (3, "reference", "id", "b", 6, "dst"), (4, "reference", "id", "a", 7, "dst")],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, orphanwatch.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(log))
        watch.start(spark.readStream.schema(orphanwatch.LOG_SCHEMA).parquet(str(log)), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.period, r.row_id, r.state) for r in watch.state().collect()}
    assert got == {(1, 2, "later"), (1, 3, "pending"), (2, 4, "deleted"), (3, 6, "deleted"), (4, 7, "deleted")}
    again = spark.createDataFrame(deliveries[2], orphanwatch.LOG_SCHEMA)
    watch.apply(again, watch.version)
    assert {(r.period, r.row_id, r.state) for r in watch.state().collect()} == got


def test_envelope(spark):
    r = Result(True, spark.range(3).select(F.col("id").alias("x")), float("nan"), "odd", "red")
    assert r.confidence == 0.0 and r.needs_review and r.review_reasons and r.urgency == "orange"
    assert '"x": 2' in r.to_json() and not Result(True, None, 0.9).needs_review
    assert not refuse("no such name").ok and share_confidence(1, 2) == 0.65 and share_confidence(0, 0) == 0.9

import ast
import json

from meshwright.sources import artifacts, bodies, links, project, pysource

NODES = "snapshot int, id string, kind string, name string, location string, end_line int, is_stub boolean, arity int, summary string, roles array<string>, file string"

FILES = {
    "pkg/__init__.py": "from pkg.core import run\n",
    "pkg/core.py": '''"""Core."""
import os
from pkg.util import helper, missing, LIMIT

__all__ = ["run"]


class Base:
    """A base."""

    def go(self):
        return self.stop()

    def stop(self):
        raise NotImplementedError


class Sub(Base):
    def stop(self):
        return helper(1)


def run(x, unused):
    b = Sub()
    b.go()
    return os.getcwd()


@app.get("/items")
def items():
    return run(1, 2)


if __name__ == "__main__":
    run(1, 2)
''',
    "pkg/util.py": "LIMIT = 3\n\n\ndef helper(a):\n    return a\n\n\ndef stop():\n    pass\n",
    "pkg/bad.py": "def broken(:\n",
}


def sources(spark, files=FILES):
    return spark.createDataFrame([(1, p, t) for p, t in files.items()], "snapshot int, path string, text string")


def test_definitions(spark):
    rows = {r.id: r for r in pysource.definitions(sources(spark)).collect()}
    assert rows["pkg/core.py::Base.go"].kind == "Method" and rows["pkg/core.py::run"].arity == 2
    assert rows["pkg/core.py::Base.stop"].is_stub and rows["pkg/util.py::stop"].is_stub and not rows["pkg/core.py::run"].is_stub
    assert rows["pkg/core.py::run"].roles == ["exported"] and rows["pkg/core.py::items"].roles == ["route"]
    assert rows["pkg/core.py::core"].roles == ["main"] and rows["pkg/core.py::core"].summary == "Core."
    assert not any(i.startswith("pkg/bad.py") for i in rows)


def test_resolution(spark):
    s = sources(spark)
    edges = pysource.resolve(pysource.definitions(s), pysource.references(s), pysource.symbols(s)).collect()
    got = {(r.src.split("::")[1], r.relation, r.dst_symbol, r.dst_id and r.dst_id.split("::")[1]): (r.weight, r.provenance) for r in edges}
    assert got[("Base.go", "CALLS", "stop", "Base.stop")] == (1.0, "extracted")
    assert ("Base.go", "CALLS", "stop", "stop") not in got
    assert got[("Sub.stop", "CALLS", "helper", "helper")] == (1.0, "extracted")
    assert got[("Sub", "INHERITS", "Base", "Base")] == (1.0, "extracted")
    assert got[("run", "CALLS", "go", "Base.go")][0] == 1.0
    assert got[("core", "IMPORTS", "helper", "helper")] == (1.0, "extracted")
    assert got[("core", "IMPORTS", "missing", None)] == (0.6, "inferred")
    assert ("core", "IMPORTS", "LIMIT", None) not in got and not any(k[2] == "getcwd" for k in got)


def test_names_shared_by_several(spark):
    s = sources(spark, {"a.py": "def f(): return 1\n", "b.py": "def f(): return 2\n", "c.py": "def g(x):\n    return x.f()\n"})
    edges = pysource.resolve(pysource.definitions(s), pysource.references(s)).where("src = 'c.py::g' and relation = 'CALLS'").collect()
    assert sorted((r.dst_id, r.weight, r.provenance) for r in edges) == [("a.py::f", 0.5, "ambiguous"), ("b.py::f", 0.5, "ambiguous")]


STATE = """CACHE = {}
LIMIT = 3
count = 0


def put(k, v):
    CACHE[k] = v


def get(k):
    return CACHE[k] + LIMIT


def bump():
    global count
    count += 1


class Box:
    def fill(self, x):
        self.items = [x]
        self.alone = 1

    def take(self):
        return self.items.pop()


def run(obj, what):
    return getattr(obj, f"fi{what}")() or getattr(obj, "take")()
"""


def test_state_and_names_made_at_run_time(spark):
    s = sources(spark, {"m.py": STATE})
    refs = pysource.references(s)
    made, edges = pysource.state_edges(refs)
    got = {(r.src.split("::")[1], r.relation, r.dst_id) for r in edges.collect()}
    assert got == {
        ("put", "WRITES", "var::m.py::CACHE"), ("get", "READS", "var::m.py::CACHE"), ("put", "READS", "var::m.py::CACHE"), ("bump", "WRITES", "var::m.py::count"), ("bump", "READS", "var::m.py::count"),
        ("Box.fill", "WRITES", "var::m.py::Box::items"), ("Box.take", "WRITES", "var::m.py::Box::items"), ("Box.take", "READS", "var::m.py::Box::items"),
    }
    assert {(r.id, r.kind) for r in made.collect()} == {(f"var::m.py::{n}", "Variable") for n in ("CACHE", "count", "Box::items")}
    found = pysource.resolve(pysource.definitions(s), refs).where("src = 'm.py::run' AND relation = 'REFERENCES'").collect()
    by = {(r.dst_symbol, r.dst_id) for r in found}
    assert ("fi*", "m.py::Box.fill") in by and ("take", "m.py::Box.take") in by


def fn(text):
    return ast.parse(text).body[0]


def test_fingerprints():
    a, b = fn("def f(xs):\n    t = 0\n    for x in xs:\n        t += x\n    return t\n"), fn("def g(vals):\n    acc = 0\n    for v in vals:\n        acc += v\n    return acc\n")
    c = fn("def h(xs):\n    return max(xs)\n")
    pa, pb, pc = map(bodies.fingerprint, (a, b, c))
    assert pa == pb and bodies.cosine(pa, pb) == 1.0 and bodies.cosine(pa, pc) < 0.5
    same_calls = bodies.fingerprint(fn("def p(x):\n    return f(g(x))\n")), bodies.fingerprint(fn("def p(x):\n    return g(f(x))\n"))
    assert same_calls[0] != same_calls[1]
    labels, edges = bodies.dependences(a)
    assert labels == ["entry", "Assign", "For", "AugAssign", "Return"]
    assert {(1, 3, "D"), (2, 3, "C"), (0, 2, "D"), (1, 4, "D"), (3, 4, "D")} <= set(edges)
    assert bodies.unused_parameters(fn("def f(a, b, _c, *, d):\n    return a\n"), method=False) == ["b", "d"]
    assert bodies.unused_parameters(fn("def f(a):\n    ...\n"), method=False) == []


def test_every_construct_is_walked():
    text = """async def f(a, *b, c=1, **k):
    global z
    with open(a) as h, a: pass
    async with a: pass
    try:
        x, *y = [i async for i in a if i]
    except (ValueError, TypeError) as e:
        raise RuntimeError from e
    else: pass
    finally: del x
    match a:
        case {"k": v, **rest} if v: return v
        case [1, *_]: pass
    while (n := a): break
    assert a, b
    q = {**k, 1: 2}; r = {1, 2}; s = f"{a!r:>{c}}"; t = lambda: 1; u = a[1:2]; w = not a or b and c
    def inner(): return 1
    class K: pass
    yield a if b else c
    await a
"""
    f = fn(text)
    flow = bodies.ValueFlow(f)
    assert all(0 <= s < len(flow.labels) and 0 <= d < len(flow.labels) for s, d, _ in flow.edges) and len(flow.labels) > 40
    labels, edges = bodies.dependences(f)
    assert all(0 <= s < len(labels) and 0 <= d < len(labels) for s, d, _ in edges)
    assert bodies.fingerprint(f) == bodies.fingerprint(fn(text.replace("    global z\n", "    # note\n")))


def test_shape_search_and_divergence(spark):
    one, two = "def f(x):\n    return a(x)\ndef same(x):\n    return x\n", "def f(x):\n    for i in x:\n        yield b(i)\ndef same(y):\n    return y\n"
    s = spark.createDataFrame([(1, "m.py", one), (2, "m.py", two)], "snapshot int, path string, text string")
    prints = bodies.fingerprints(s)
    assert [r.id for r in bodies.diverged(prints, 1, 2).collect()] == ["m.py::f"]
    best = bodies.similar_shape(prints, "def q(z):\n    return a(z)\n").orderBy("score", ascending=False).first()
    assert (best.id, round(best.score, 6)) == ("m.py::f", 1.0)
    assert bodies.unused(s).collect() == []
    assert bodies.body_matrix(s).count() > 0 and bodies.similar_shape(prints, "not python (").collect() == []


def test_line_coverage(spark):
    texts = [
        ("j", json.dumps({"files": {"a.py": {"executed_lines": [1, True, "3", "x", None, 2.5]}, "b.py": {"executed_lines": 7}, "c.py": []}})),
        ("l", "TN:\nSF:src/a.py\nDA:4,1\nDA:5,0\nDA:bad\nend_of_record\nDA:9,9\n"),
        ("g", "mode: set\npkg/x.go:10.2,12.3 2 1\npkg/x.go:20.1,21.1 1 0\npkg/x.go:1.1,9000000.1 1 1\njunk\n"),
        ("none", "hello"), ("empty", ""), ("null", None), ("broken", "{"),
    ]
    df = spark.createDataFrame(texts, "artifact string, value string")
    got = {tuple(r) for r in artifacts.line_coverage(df).collect()}
    assert got == {("j", "a.py", 1, 1), ("j", "a.py", 3, 3), ("l", "src/a.py", 4, 4), ("g", "pkg/x.go", 10, 12)}


def test_ingest_trace(spark):
    rows = [(1, "d/a.py::f", "Function", "f", "d/a.py:3", 6, False, 0, None, [], "d/a.py"), (1, "d/a.py::g", "Function", "g", "d/a.py:8", 8, False, 0, None, ["test"], "d/a.py"), (1, "d/a.py::h", "Function", "h", "d/a.py", None, False, 0, None, [], "d/a.py")]
    nodes = spark.createDataFrame(rows, NODES)
    span = lambda *x: spark.createDataFrame([("t", *s) for s in x], "artifact string, file string, first long, last long")
    roles = lambda s: {r.name: r.roles for r in artifacts.ingest_trace(nodes, s).collect()}
    assert roles(span(("d/a.py", 3, 3))) == {"f": [], "g": ["test"], "h": []}
    assert roles(span(("d/a.py", 3, 4), ("./d/a.py", 8, 8))) == {"f": ["runtime"], "g": ["runtime", "test"], "h": []}
    assert roles(span(("/ci/work/d/a.py", 5, 5), ("a.py", 8, 8))) == {"f": ["runtime"], "g": ["test"], "h": []}
    assert roles(span()) == {"f": [], "g": ["test"], "h": []}


def test_settings_globs_and_listing(spark, tmp_path):
    (tmp_path / "s.toml").write_text('[meshwright]\nignore = ["*.gen.py", "docs/**"]\nreview_threshold = 3\nhub_metric = "pagerank"\nroot_modules = "x"\n')
    s = project.load_settings(tmp_path / "s.toml")
    assert s.ignore == ("*.gen.py", "docs/**") and s.review_threshold == 0.7 and s.hub_metric == "pagerank" and s.root_modules == ()
    assert project.load_settings(tmp_path / "missing.toml") == project.Settings()
    for name, text in {"a.py": "x = 1\n", "p/b.gen.py": "y = 1\n", "docs/deep/c.py": "", "node_modules/d.py": "z\n", "p/e.py": "é\n", "p/f.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r.text for r in project.read_sources(spark, str(tmp_path), s.ignore).collect()}
    assert got == {"a.py": "x = 1\n", "p/e.py": "é\n"}
    times = project.file_times(spark, str(tmp_path)).cache()
    fewer = times.where("path NOT LIKE '%a.py'")
    assert [r.change for r in project.changed_files(times, fewer).collect()] == ["removed"] and project.changed_files(times, times).collect() == []
    log = artifacts.read_git_log(spark, str(tmp_path))
    assert log.collect() == []


def test_artifact_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"format": "v1", "tests": {"t": ["f", None]}}))
    (tmp_path / "b.json").write_text("broken")
    got = sorted((r.format, r.tests) for r in artifacts.read_test_artifacts(spark, str(tmp_path)).collect() if r.format)
    assert got == [("v1", {"t": ["f", None]})]


LINKED = {
    "web.py": '@app.get("/users/")\ndef users():\n    db.execute("SELECT * FROM person JOIN team ON 1")\n\nurlpatterns = [path("old", views.users)]\n',
    "models.py": "class Person(Base):\n    __tablename__ = 'person'\n\ndef save():\n    run('''WITH t AS (SELECT 1) INSERT INTO person SELECT * FROM t''')\n    bus.emit('saved')\nbus.on('saved', notify)\ndef notify(): pass\n",
    "app.js": "router.get('/items', auth, listItems)\nfunction x() { fetch('/users?x=1') }\n@Entity('teams')\nexport class Team {}\n",
    "form.html": "<html>\n<form action='/users'>{{ obj.save }} {{ forloop.counter }}</form>\n",
    "api.json": json.dumps({"paths": {"/api": {"get": {"operationId": "users"}, "x": 1}}}),
    "s.proto": "service Greeter { rpc Hello (A) returns (B) {} }\n",
    "schema.prisma": 'model Person {\n  id Int\n  @@map("people")\n}\n',
    "C.java": '@GetMapping("/hi")\npublic String users() {}\n',
}


def test_links(spark):
    s = spark.createDataFrame([(1, p, t) for p, t in LINKED.items()], "snapshot int, path string, text string")
    f = lambda i, k, n, a, b, p: (1, i, k, n, f"{p}:{a}", b, False, 0, None, [], p)
    nodes = spark.createDataFrame(
        [
            f("web.py::users", "Function", "users", 2, 3, "web.py"), f("models.py::Person", "Class", "Person", 1, 2, "models.py"), f("models.py::save", "Function", "save", 4, 6, "models.py"),
            f("models.py::notify", "Function", "notify", 8, 8, "models.py"), f("app.js::listItems", "Function", "listItems", 9, 9, "app.js"), f("app.js::x", "Function", "x", 2, 2, "app.js"),
            f("app.js::Team", "Class", "Team", 4, 4, "app.js"), f("C.java::C.users", "Method", "users", 2, 2, "C.java"), f("g.py::GreeterServicer.Hello", "Method", "Hello", 1, 1, "g.py"),
        ],
        NODES,
    )
    made, edges = links.link(nodes, links.raw_links(s))
    got = {(r.src, r.relation, r.dst_id): (r.weight, r.provenance, r.source) for r in edges.collect()}
    assert got[("route::/users", "ROUTES_TO", "web.py::users")] == (0.45, "ambiguous", "routes")
    assert got[("route::/items", "ROUTES_TO", "app.js::listItems")] == (0.8, "inferred", "express")
    assert got[("app.js::x", "SUBMITS_TO", "route::/users")][2] == "fetch"
    assert got[("template::form.html", "SUBMITS_TO", "route::/users")][2] == "html"
    assert got[("template::form.html", "REFERENCES", "models.py::save")][2] == "template"
    assert got[("models.py::Person", "MAPS_TO", "db::person")][2] == "orm" and got[("models.py::Person", "MAPS_TO", "db::people")][2] == "prisma"
    assert got[("app.js::Team", "MAPS_TO", "db::teams")][2] == "typeorm"
    assert got[("web.py::users", "READS", "db::person")][2] == "sql" and ("web.py::users", "READS", "db::team") in got
    assert ("models.py::save", "WRITES", "db::person") in got and ("models.py::save", "READS", "db::t") not in got
    assert ("models.py::save", "EMITS", "event::saved") in got and ("event::saved", "HANDLES", "models.py::notify") in got
    assert got[("route::/Greeter/Hello", "ROUTES_TO", "g.py::GreeterServicer.Hello")] == (0.9, "inferred", "grpc")
    assert {s for (a, r, b), (_, _, s) in got.items()} >= {"openapi", "spring", "urlconf"}
    assert {("db::person", "DBTable"), ("event::saved", "Event"), ("template::form.html", "Template"), ("route::/users", "Route")} <= {(r.id, r.kind) for r in made.collect()}


def test_import_of_a_store(spark, tmp_path):
    import sqlite3

    from meshwright.sources import sqlite_store

    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("CREATE TABLE nodes(id, kind, name, location, is_stub, roles)")
    db.execute("CREATE TABLE edges(src, relation, dst_symbol, dst_id, weight)")
    db.executemany("INSERT INTO nodes VALUES (?,?,?,?,?,?)", [("a::f", "Function", "f", "a:1", 1, "exported,test"), (b"x", "Function", "g", None, 0, ""), ("b", "Class", "b", 7, 0, None)])
    db.executemany("INSERT INTO edges VALUES (?,?,?,?,?)", [("a::f", "CALLS", "g", None, "heavy"), ("a::f", "CALLS", "b", "b", 0.5), (None, "CALLS", "b", "b", 0.5)])
    db.commit()
    db.close()
    nodes, edges = sqlite_store.import_store(spark, str(tmp_path / "s.db"), str(tmp_path / "out"))
    assert {(r.id, r.location, tuple(r.roles), r.is_stub) for r in nodes.collect()} == {("a::f", "a:1", ("exported", "test"), True), ("b", None, (), False)}
    assert {(r.src, r.dst_id, r.weight) for r in edges.collect()} == {("a::f", None, None), ("a::f", "b", 0.5)}


def test_rescue_of_sources_that_do_not_parse():
    from meshwright.sources.pysource import parse_file, rescue

    text = "    return cut_off\n\ndef empty(a, b=None):\n    # nothing yet\n\nclass K(Base):\ndef f(x):\n    y = g(x\n    return y\r\n\nthis is prose, no code\nclass Late: # note\n"
    tree, lost = rescue(text)
    assert [n.name for n in tree.body if hasattr(n, "name")] == ["empty", "K", "f", "Late"] and lost >= 3
    found = parse_file("m.py", text)
    where = {n[2]: (n[1], n[3], n[5]) for n in found.nodes}
    assert where["empty"] == ("Function", "m.py:3", True) and where["f"][1:] == ("m.py:7", False) and where["Late"][1] == "m.py:12"
    assert ("m.py::K", "INHERITS", "Base") in {r[:3] for r in found.refs}
    for odd in ("", "\n", "\x00", "def f(:\n", "((((", "  x", "def f(x):"):
        assert rescue(odd)[0] is not None
    assert rescue("x = 1\n")[1] == 0 and rescue("def f(:\n")[1] == 1


def test_given_up_lines_are_told(spark):
    from meshwright.sources.pysource import given_up

    df = spark.createDataFrame([(1, "a.py", "x = 1\n"), (1, "b.py", "no code at all\n")], "snapshot int, path string, text string")
    assert [tuple(r) for r in given_up(df).collect()] == [(1, "b.py", 1)]


def _files(spark, *rows):
    return spark.createDataFrame([(1, path, text) for path, text in rows], "snapshot int, path string, text string")


DEEP = "class A(B):\n    def f(self, a):\n        return a" + ".b()" * 700 + "\n"


def test_nodes_of_deep_odd_and_unnamed_files(spark):
    files = _files(spark, ("a.py", DEEP), (None, "def g():\n    return 1\n"), ("c.py", 'def h():\n    """x \\ud800"""\n'), ("d.py", "if 0x" + "f" * 5000 + ":\n    k = 1\n"))
    got = {(r.id, r.name, r.location) for r in pysource.definitions(files).where("kind <> 'Module'").collect()}
    assert got == {("a.py::A", "A", "a.py:1"), ("a.py::A.f", "f", "a.py:2"), (None, "g", None), ("c.py::h", "h", "c.py:1")}


def test_bases_of_deep_and_unnamed_files(spark):
    files = _files(spark, ("a.py", DEEP), (None, "class C(A):\n    pass\n"))
    refs = pysource.references(files)
    assert {(r.src, r.dst_symbol) for r in refs.where("relation = 'INHERITS'").collect()} == {("a.py::A", "B"), (None, "A")}
    assert pysource.resolve(pysource.definitions(files), refs).where("relation = 'INHERITS'").count() == 0


def test_edges_of_deep_files_and_odd_names(spark):
    files = _files(spark, ("a.py", DEEP + "def b():\n    return getattr(A, '\\\\ud800')\n"), (None, "def g():\n    return b()\n"))
    edges = pysource.resolve(pysource.definitions(files), pysource.references(files), pysource.symbols(files)).collect()
    assert {(e.src, e.relation, e.dst_id) for e in edges} == {("a.py::A.f", "CALLS", "a.py::b"), ("a.py::b", "REFERENCES", "a.py::A")}


def _listed(spark, path, *texts):
    rows = [(i, text, "code_listing") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_edges_of_listings_parse_each_file_once(spark, tmp_path):
    from meshwright.plans.sourceops import python_edges

    d = _listed(spark, tmp_path, DEEP + "def b():\n    return A\n", "LIMIT = 1\ndef g():\n    return b()\n", "no code at all")
    edges = python_edges(spark, d)
    assert {(e.src, e.relation, e.dst_id) for e in edges.collect()} >= {("listings/0.py::A.f", "CALLS", "listings/0.py::b"), ("listings/1.py::g", "CALLS", "listings/0.py::b")}
    assert "MapInPandas" not in edges._jdf.queryExecution().executedPlan().toString()
    files = _files(spark, *[f for f in FILES.items() if f[0].endswith(".py")])
    apart = pysource.definitions(files), pysource.references(files), pysource.symbols(files)
    for got, one in zip(pysource.extracted(files), apart):
        assert sorted(repr(r) for r in got.collect()) == sorted(repr(r) for r in one.collect())


def test_bases_of_listings_parse_each_file_once(spark, tmp_path):
    from meshwright.plans.sourceops import python_bases

    d = _listed(spark, tmp_path, DEEP, "class B:\n    pass\nclass C(A, B):\n    x = A(B)\n", "class B:\n    pass\n")
    bases = python_bases(spark, d)
    assert {(r.src, r.base, r.line, r.n_candidates) for r in bases.collect()} == {("listings/0.py::A", "B", 1, 2), ("listings/1.py::C", "A", 3, 1), ("listings/1.py::C", "B", 3, 2)}
    assert "MapInPandas" not in bases._jdf.queryExecution().executedPlan().toString()

import pytest

from meshwright.sources import polyglot, pysource

SAMPLES = {
    "a.js": "import x from './lib'\nexport function one() { two('f(') } // gone()\nconst two = (a) => { return a.three() }\nclass K extends Base {\n  three() { one() }\n}\n",
    "b.go": 'package b\nimport "fmt"\ntype S struct { x int }\nfunc (s *S) Run() { helper() }\nfunc helper() { fmt.Println("no()") }\n',
    "c.rs": "struct P { x: u8 }\nimpl P {\n  pub fn go(&self) { step(1) }\n}\nfn step(x: u8) {}\n",
    "D.java": "import java.util.List;\npublic class D extends E {\n  public int f(int x) { return g(x); }\n  private int g(int x) { return x; }\n}\n",
    "e.cs": "using System;\nclass Q : R {\n  public void Go() { Other(); }\n  void Other() { }\n}\n",
    "f.cpp": "#include <x.h>\nclass W : public V {\n};\nint W::run(int a) {\n  return helper(a);\n}\nstatic int helper(int a) { return a; }\n",
    "g.rb": "require 'set'\nclass T < U\n  def go\n    if x\n      work(1)\n    end\n  end\n  def work(a)\n    a\n  end\nend\n",
    "h.php": "<?php\nuse A\\B;\nclass M extends N {\n  public function go() { $this->work(); }\n  function work() { return 1; }\n}\n",
    "i.sh": "source ./lib.sh\ngo() {\n  work now\n}\nfunction work {\n  true # go\n}\n",
}
DEFINED = {
    "a.js": {"one": "Function", "two": "Function", "K": "Class", "K.three": "Method"}, "b.go": {"S": "Class", "S.Run": "Method", "helper": "Function"}, "c.rs": {"P": "Class", "P.go": "Method", "step": "Function"},
    "D.java": {"D": "Class", "D.f": "Method", "D.g": "Method"}, "e.cs": {"Q": "Class", "Q.Go": "Method", "Q.Other": "Method"}, "f.cpp": {"W": "Class", "W.run": "Method", "helper": "Function"},
    "g.rb": {"T": "Class", "T.go": "Method", "T.work": "Method"}, "h.php": {"M": "Class", "M.go": "Method", "M.work": "Method"}, "i.sh": {"go": "Function", "work": "Function"},
}
CALLED = {
    "a.js": {("one", "two"), ("two", "three"), ("K.three", "one")}, "b.go": {("S.Run", "helper")}, "c.rs": {("P.go", "step")}, "D.java": {("D.f", "g")}, "e.cs": {("Q.Go", "Other")},
    "f.cpp": {("W.run", "helper")}, "g.rb": {("T.go", "work")}, "h.php": {("M.go", "work")}, "i.sh": {("go", "work")},
}
BASES = {"a.js": "Base", "D.java": "E", "e.cs": "R", "f.cpp": "V", "g.rb": "U", "h.php": "N"}


@pytest.mark.parametrize("path", SAMPLES)
def test_language(path):
    nodes, refs = polyglot.parse(path, SAMPLES[path])
    assert {i.split("::")[1]: k for i, k, *_ in nodes if k != "Module"} == DEFINED[path]
    calls = {(s.split("::")[1], d) for s, r, d, *_ in refs if r == "CALLS"}
    assert CALLED[path] <= calls and not any(d in ("gone", "f", "no") and s != "D" for s, d in calls if path != "D.java")
    assert {d for _, r, d, *_ in refs if r == "INHERITS"} == ({BASES[path]} if path in BASES else set())
    assert path == "c.rs" or any(r == "IMPORTS" for _, r, *_ in refs)


def test_no_links_between_languages(spark):
    s = spark.createDataFrame([(1, p, t) for p, t in SAMPLES.items()] + [(1, "z.py", "def helper(): pass\ndef top(): return helper()\n"), (1, "odd.txt", "x(")], "snapshot int, path string, text string")
    nodes = polyglot.definitions(s).unionByName(pysource.definitions(s.where("path LIKE '%.py'")))
    edges = pysource.resolve(nodes, polyglot.references(s).unionByName(pysource.references(s.where("path LIKE '%.py'")))).where("relation = 'CALLS'").collect()
    got = {(r.src, r.dst_id, r.weight) for r in edges}
    assert ("b.go::S.Run", "b.go::helper", 1.0) in got and ("z.py::top", "z.py::helper", 1.0) in got and ("f.cpp::W.run", "f.cpp::helper", 1.0) in got


def test_header_dialect_and_long_or_odd_texts():
    assert polyglot.header_dialect("int f(int);") == "c" and polyglot.header_dialect("class X;") == "cpp"
    assert polyglot.parse("x.js", "")[0][0][1] == "Module" and polyglot.parse("x.js", "}{)(\"'`")[1] == []
    assert len(polyglot.parse("x.js", "f();\n" * 3000)[1]) == 3000

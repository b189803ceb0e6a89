"""Bodies of Python functions as graphs: flow of values, dependences of statements, fingerprints.

Fingerprints count the labels of a value-flow graph over rounds of neighbourhood refinement, so
names and order of unrelated lines do not matter, but what flows where does.
"""

from __future__ import annotations

import ast
import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.sources.pysource import is_stub, rescue

ROUNDS = 3


class ValueFlow(ast.NodeVisitor):
    """Nodes are operations, edges carry values ('d') or the decision that runs them ('c').

    A name stands for the operation that made its value: copies leave no trace.
    """

    def __init__(self, function: ast.AST):
        self.labels: list[str] = []
        self.edges: list[tuple[int, int, str]] = []
        self.made: dict[str, int] = {}
        self.guards: list[int] = []
        args = getattr(function, "args", None)
        for x in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, [args.vararg, args.kwarg])] if args else []:
            self.made[x.arg] = self.add("param")
        self.block(function.body)

    def add(self, label: str, *inputs: int | None) -> int:
        self.labels.append(label)
        at = len(self.labels) - 1
        self.edges += [(i, at, "d") for i in inputs if i is not None]
        if self.guards:
            self.edges.append((self.guards[-1], at, "c"))
        return at

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.statement(s)

    def bind(self, target: ast.AST, value: int) -> None:
        if isinstance(target, ast.Name):
            self.made[target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t.value if isinstance(t, ast.Starred) else t, self.add("unpack", value))
        elif isinstance(target, ast.Attribute):
            self.add(f"store.{target.attr}", self.value(target.value), value)
        elif isinstance(target, ast.Subscript):
            self.add("store[]", self.value(target.value), self.value(target.slice), value)

    def under(self, guard: int, *bodies: list[ast.stmt]) -> None:
        self.guards.append(guard)
        for body in bodies:
            self.block(body)
        self.guards.pop()

    def statement(self, s: ast.stmt) -> None:
        match s:
            case ast.Assign():
                v = self.value(s.value)
                for t in s.targets:
                    self.bind(t, v)
            case ast.AnnAssign():
                if s.value is not None:
                    self.bind(s.target, self.value(s.value))
            case ast.AugAssign():
                self.bind(s.target, self.add(f"op.{type(s.op).__name__}", self.value(s.target), self.value(s.value)))
            case ast.Return():
                self.add("return", self.value(s.value) if s.value else None)
            case ast.Expr():
                if not isinstance(s.value, ast.Constant):
                    self.value(s.value)
            case ast.If():
                self.under(self.add("if", self.value(s.test)), s.body, s.orelse)
            case ast.While():
                self.under(self.add("while", self.value(s.test)), s.body, s.orelse)
            case ast.For() | ast.AsyncFor():
                loop = self.add("for", self.value(s.iter))
                self.bind(s.target, loop)
                self.under(loop, s.body, s.orelse)
            case ast.With() | ast.AsyncWith():
                for item in s.items:
                    v = self.add("with", self.value(item.context_expr))
                    if item.optional_vars is not None:
                        self.bind(item.optional_vars, v)
                self.block(s.body)
            case ast.Try():
                guard = self.add("try")
                self.under(guard, s.body)
                for h in s.handlers:
                    caught = self.add("except", guard, self.value(h.type) if h.type else None)
                    if h.name:
                        self.made[h.name] = caught
                    self.under(caught, h.body)
                self.block(s.orelse)
                self.block(s.finalbody)
            case ast.Raise():
                self.add("raise", self.value(s.exc) if s.exc else None)
            case ast.Assert():
                self.add("assert", self.value(s.test))
            case ast.Match():
                subject = self.value(s.subject)
                for case in s.cases:
                    arm = self.add("case", subject, self.value(case.guard) if case.guard else None)
                    for x in ast.walk(case.pattern):
                        if getattr(x, "name", None):
                            self.made[x.name] = arm
                    self.under(arm, case.body)
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                self.made[s.name] = self.add("define")
            case ast.Delete():
                for t in s.targets:
                    self.add("del", self.value(t))
            case ast.Break() | ast.Continue():
                self.add(type(s).__name__.lower())
            case _:
                for child in ast.iter_child_nodes(s):
                    if isinstance(child, ast.expr):
                        self.value(child)

    def value(self, e: ast.AST | None) -> int | None:
        match e:
            case None:
                return None
            case ast.Name():
                if e.id not in self.made:
                    self.made[e.id] = self.add(f"name.{e.id}")
                return self.made[e.id]
            case ast.Constant():
                return self.add(f"const.{type(e.value).__name__}")
            case ast.Call():
                name = e.func.attr if isinstance(e.func, ast.Attribute) else e.func.id if isinstance(e.func, ast.Name) else "?"
                on = self.value(e.func.value) if isinstance(e.func, ast.Attribute) else None if isinstance(e.func, ast.Name) else self.value(e.func)
                return self.add(f"call.{name}", on, *[self.value(a) for a in e.args], *[self.value(k.value) for k in e.keywords])
            case ast.Attribute():
                return self.add(f"get.{e.attr}", self.value(e.value))
            case ast.Subscript():
                return self.add("get[]", self.value(e.value), self.value(e.slice))
            case ast.BinOp():
                return self.add(f"op.{type(e.op).__name__}", self.value(e.left), self.value(e.right))
            case ast.UnaryOp():
                return self.add(f"op.{type(e.op).__name__}", self.value(e.operand))
            case ast.BoolOp():
                return self.add(f"op.{type(e.op).__name__}", *[self.value(v) for v in e.values])
            case ast.Compare():
                return self.add("cmp." + ".".join(type(o).__name__ for o in e.ops), self.value(e.left), *[self.value(c) for c in e.comparators])
            case ast.IfExp():
                return self.add("choose", self.value(e.test), self.value(e.body), self.value(e.orelse))
            case ast.NamedExpr():
                v = self.value(e.value)
                self.bind(e.target, v if v is not None else self.add("none"))
                return v
            case ast.ListComp() | ast.SetComp() | ast.GeneratorExp() | ast.DictComp():
                held, last = dict(self.made), None
                for g in e.generators:
                    last = self.add("each", self.value(g.iter), last)
                    self.bind(g.target, last)
                    for c in g.ifs:
                        last = self.add("where", last, self.value(c))
                parts = [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]
                out = self.add(type(e).__name__, last, *[self.value(p) for p in parts])
                self.made = held
                return out
            case ast.Lambda():
                return self.add("lambda")
            case ast.Starred() | ast.Await() | ast.YieldFrom():
                return self.add(type(e).__name__.lower(), self.value(e.value))
            case ast.Yield():
                return self.add("yield", self.value(e.value))
            case _:
                return self.add(type(e).__name__, *[self.value(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)])


def refine(labels: list[str], edges: list[tuple[int, int, str]], rounds: int = ROUNDS) -> Counter[str]:
    """Counts of all labels of all rounds; a round hashes a label with those around it."""
    short = lambda s: hashlib.md5(s.encode(), usedforsecurity=False).hexdigest()[:16]
    cur = [short(x) for x in labels]
    out = Counter(cur)
    for _ in range(rounds):
        around: list[list[str]] = [[] for _ in cur]
        for s, d, kind in edges:
            around[d].append(f"<{kind}{cur[s]}")
            around[s].append(f">{kind}{cur[d]}")
        cur = [short(x + "|" + ",".join(sorted(a))) for x, a in zip(cur, around)]
        out.update(cur)
    return out


def fingerprint(function: ast.AST) -> Counter[str]:
    flow = ValueFlow(function)
    return refine(flow.labels, flow.edges)


def cosine(a: Counter[str], b: Counter[str]) -> float:
    dot = sum(n * b[k] for k, n in a.items())
    norm = (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
    return min(1.0, dot / norm) if norm else 0.0


def dependences(function: ast.AST) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Statements with control ('C') and data ('D') edges: what decides, and whose value is read."""
    labels: list[str] = ["entry"]
    edges: list[tuple[int, int, str]] = []
    last: dict[str, set[int]] = {}

    def names(node: ast.AST, kind: type) -> set[str]:
        return {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, kind)}

    def run(body: list[ast.stmt], over: int) -> None:
        for s in body:
            at = len(labels)
            labels.append(type(s).__name__)
            edges.append((over, at, "C"))
            inner = [getattr(s, f, []) for f in ("body", "orelse", "finalbody")] + [h.body for h in getattr(s, "handlers", [])] + [c.body for c in getattr(s, "cases", [])]
            nested = [b for b in inner if isinstance(b, list) and b]
            head = [c for c in ast.iter_child_nodes(s) if not isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case))]
            reads = set().union(*(names(c, ast.Load) for c in head)) if head else set()
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                reads.add(s.target.id)
            edges.extend((d, at, "D") for n in sorted(reads) for d in sorted(last.get(n, ())))
            writes = set().union(*(names(c, ast.Store) for c in head)) if head else set()
            for n in writes:
                last[n] = {at}
            before = {k: set(v) for k, v in last.items()}
            merged = {k: set(v) for k, v in last.items()}
            for b in nested:
                last.clear()
                last.update({k: set(v) for k, v in before.items()})
                run(b, at)
                for k, v in last.items():
                    merged.setdefault(k, set()).update(v)
            if nested:
                last.clear()
                last.update(merged)

    for x in ast.walk(getattr(function, "args", ast.arguments(posonlyargs=[], args=[], kwonlyargs=[], kw_defaults=[], defaults=[]))):
        if isinstance(x, ast.arg):
            last[x.arg] = {0}
    run(function.body, 0)
    return labels, edges


def unused_parameters(function: ast.FunctionDef | ast.AsyncFunctionDef, *, method: bool) -> list[str]:
    """Parameters that the body never reads; none for what has a body to come or a decorator."""
    if is_stub(function) or function.decorator_list or (function.name.startswith("__") and function.name.endswith("__")):
        return []
    args = [*function.args.posonlyargs, *function.args.args]
    own = args[1:] if method else args
    read = {x.id for s in function.body for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Load, ast.Del))}
    calls_locals = "locals" in read
    return [] if calls_locals else [x.arg for x in [*own, *function.args.kwonlyargs] if x.arg not in read and not x.arg.startswith("_")]


def functions_of(path: str, text: str) -> Iterator[tuple[str, ast.AST, bool]]:
    """(id, function, is a method) of all functions of a file, nested ones too."""
    tree, _ = rescue(text)
    taken: Counter[str] = Counter()
    work = [(tree, "", False)]
    while work:
        node, qual, in_class = work.pop()
        found = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{qual}.{child.name}" if qual else child.name
                taken[name] += 1
                if not isinstance(child, ast.ClassDef):
                    yield f"{path}::{name}" + (f"#{taken[name]}" if taken[name] > 1 else ""), child, in_class
                found.append((child, name, isinstance(child, ast.ClassDef)))
            else:
                found.append((child, qual, in_class))
        work += reversed(found)


def _fingerprint_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for snapshot, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]):
            for ident, function, _ in functions_of(path, text):
                rows += [(snapshot, ident, f, n) for f, n in fingerprint(function).items()]
        yield pd.DataFrame(rows, columns=["snapshot", "id", "feature", "n"])


def fingerprints(sources: DataFrame) -> DataFrame:
    """(snapshot, id, feature, n) of all functions of (snapshot, path, text) rows."""
    return sources.select("snapshot", "path", "text").mapInPandas(_fingerprint_rows, "snapshot int, id string, feature string, n long")


def similar_shape(prints: DataFrame, snippet: str) -> DataFrame:
    """(snapshot, id, score): functions by the likeness of their bodies to the snippet's largest."""
    spark = prints.sparkSession
    own = [fingerprint(f) for _, f, _ in functions_of("snippet.py", snippet)]
    asked = max(own, key=lambda c: (sum(c.values()), sorted(c)), default=Counter())
    norm = sum(n * n for n in asked.values()) ** 0.5
    q = spark.createDataFrame(sorted(asked.items()), "feature string, q long")
    norms = prints.groupBy("snapshot", "id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dots = prints.join(F.broadcast(q), "feature").groupBy("snapshot", "id").agg(F.sum(F.col("n") * F.col("q")).alias("dot"))
    return dots.join(norms, ["snapshot", "id"]).select("snapshot", "id", F.least(F.lit(1.0), F.col("dot") / (F.col("norm") * F.lit(norm or 1.0))).alias("score"))


def diverged(prints: DataFrame, old: int, new: int, threshold: float = 0.95) -> DataFrame:
    """(id, similarity): functions of both snapshots whose bodies are less alike than that."""
    a, b = (prints.where(F.col("snapshot") == p).select("id", "feature", F.col("n").alias(c)) for p, c in ((old, "a"), (new, "b")))
    ids = a.select("id").distinct().join(b.select("id").distinct(), "id", "left_semi")
    both = a.join(b, ["id", "feature"], "full").fillna(0, ["a", "b"]).join(ids, "id", "left_semi")
    sums = both.groupBy("id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.max((F.col("a") != F.col("b")).cast("int")).alias("moved"))
    out = sums.where("moved = 1").select("id", F.round(F.col("dot") / F.sqrt(F.col("aa") * F.col("bb")), 3).alias("similarity"))
    return out.where(F.col("similarity") < threshold)


def _unused_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(s, i, p) for s, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]) for i, f, m in functions_of(path, text) for p in unused_parameters(f, method=m)]
        yield pd.DataFrame(rows, columns=["snapshot", "id", "parameter"])


def unused(sources: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(snapshot, id, parameter) never read; functions of ``overrides`` (snapshot, id) owe their
    signature to a base and are left out."""
    found = sources.select("snapshot", "path", "text").mapInPandas(_unused_rows, "snapshot int, id string, parameter string")
    return found if overrides is None else found.join(overrides, ["snapshot", "id"], "left_anti")


def _body_rows(kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for snapshot, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]):
                for ident, function, _ in functions_of(path, text):
                    if kind == "statement":
                        labels, edges = dependences(function)
                    else:
                        flow = ValueFlow(function)
                        labels, edges = flow.labels, flow.edges
                    rows += [(snapshot, ident, s, d, k, labels[s], labels[d]) for s, d, k in edges]
            yield pd.DataFrame(rows, columns=["snapshot", "id", "row", "col", "edge", "row_label", "col_label"])

    return run


def body_matrix(sources: DataFrame, layer: str = "statement") -> DataFrame:
    """Cells (snapshot, id, row, col, edge, labels) of each function's matrix of statements or of
    expressions."""
    return sources.select("snapshot", "path", "text").mapInPandas(_body_rows(layer), "snapshot int, id string, row int, col int, edge string, row_label string, col_label string")

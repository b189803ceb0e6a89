"""Python source files to nodes, references and symbols; references are resolved by joins.

A task parses the files it is given and emits what stands in each; nothing is known of other files
there. Names become edges afterwards, by joins over all files: in the enclosing class, by import,
or by name over the whole project with the weight shared by all candidates.
"""

from __future__ import annotations

import ast
import re
import sys
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions.ids import same_language
from meshwright.runtime import Workspace

NODE_SCHEMA = "snapshot int, id string, kind string, name string, location string, end_line int, is_stub boolean, arity int, summary string, roles array<string>, file string"
REF_SCHEMA = "snapshot int, src string, relation string, dst_symbol string, scope string, receiver boolean, line int, file string"
SYMBOL_SCHEMA = "file string, kind string, name string"

#: Methods that change what they are called on.
_MUTATORS = {"append", "add", "update", "pop", "popitem", "clear", "extend", "insert", "remove", "discard", "setdefault", "sort", "reverse", "appendleft"}
_ROUTES = {"get", "post", "put", "delete", "patch", "route", "websocket"}


def module_name(path: str) -> str:
    """Dotted name of a module; of a package its own, without a leading ``src``."""
    parts = path.removesuffix(".py").split("/")
    if parts[0] == "src" and len(parts) > 1:
        parts = parts[1:]
    if parts[-1] == "__init__" and len(parts) > 1:
        parts = parts[:-1]
    return ".".join(parts)


def _plain_body(node: ast.AST) -> list[ast.stmt]:
    body = list(node.body)
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    return body


def is_stub(node: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    """A body that is not written yet; an abstract method is meant to have none."""
    if any(_last_name(d) in ("abstractmethod", "overload") for d in node.decorator_list):
        return False
    body = _plain_body(node)
    if len(body) > 1:
        return False
    if not body:
        return True
    only = body[0]
    if isinstance(only, ast.Pass) or (isinstance(only, ast.Expr) and isinstance(only.value, ast.Constant) and only.value.value is Ellipsis):
        return True
    return isinstance(only, ast.Raise) and only.exc is not None and _last_name(only.exc) == "NotImplementedError"


def _last_name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        return _last_name(node.func)
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def _plain(text: str) -> str:
    """Text that can be written: halves of surrogate pairs as escapes."""
    return text.encode("utf-8", "backslashreplace").decode("utf-8")


def _mentions(tree: ast.AST, word: str) -> bool:
    """Whether a name or a string in a tree holds a word."""
    said = (getattr(x, "id", None) or getattr(x, "attr", None) or getattr(x, "arg", None) or getattr(x, "value", None) for x in ast.walk(tree))
    return any(word in x if isinstance(x, str) else word.encode() in x for x in said if isinstance(x, (str, bytes)))


#: Frames of Python while a tree is walked; the parser's own bound on depth is below a third of it.
FRAMES = 100_000


@contextmanager
def _deep():
    """Room for trees as deep as the parser makes them: the walks are calls of Python in Python."""
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(max(held, FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(held)


class _File(ast.NodeVisitor):
    """What one file defines and names. A file without a path has nodes without id and location."""

    def __init__(self, path: str | None, tree: ast.Module):
        self.path, self.nodes, self.refs, self.symbols = path, [], [], []
        self.taken: Counter[str] = Counter()
        own = "" if path is None else module_name(path)
        self.module = self._id(own.rsplit(".", 1)[-1])
        self.exported = self._names_in_all(tree)
        main = any(isinstance(s, ast.If) and _mentions(s.test, "__main__") and _mentions(s.test, "__name__") for s in tree.body)
        last = max([1, *(getattr(s, "end_lineno", 1) or 1 for s in tree.body)])
        self._node(self.module, "Module", own, 1, last, False, None, ast.get_docstring(tree), ["main"] if main else [])
        if main:
            self.symbols.append(("main", "__main__"))
        self.symbols += [("export", _plain(n)) for n in self.exported]
        for s in tree.body:
            for target in [*getattr(s, "targets", []), getattr(s, "target", None)]:
                if isinstance(s, (ast.Assign, ast.AnnAssign)) and isinstance(target, ast.Name):
                    self.symbols.append(("const", target.id))
        self.globals = {n for k, n in self.symbols if k == "const"}
        self.declared: set[str] = set()
        self.owner, self.cls, self.qual = self.module, None, ""
        self.locals: dict[str, str] = {}
        for s in tree.body:
            self.visit(s)

    def _id(self, qual: str) -> str | None:
        self.taken[qual] += 1
        return None if self.path is None else f"{self.path}::{qual}" + (f"#{self.taken[qual]}" if self.taken[qual] > 1 else "")

    def _node(self, ident, kind, name, line, end, stub, arity, doc, roles):
        summary = _plain((doc or "").strip().split("\n")[0]) or None
        self.nodes.append((ident, kind, name, None if self.path is None else f"{self.path}:{line}", end, stub, arity, summary, sorted(set(roles))))

    def _ref(self, relation: str, symbol: str, node: ast.AST, scope: str | None = None, receiver: bool = False):
        self.refs.append((self.owner, relation, _plain(symbol), scope, receiver, getattr(node, "lineno", 1)))

    @staticmethod
    def _names_in_all(tree: ast.Module) -> list[str]:
        out = []
        for s in tree.body:
            targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, (ast.AugAssign, ast.AnnAssign)) else []
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(s.value, (ast.List, ast.Tuple)):
                out += [e.value for e in s.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        return out

    def _roles(self, node, name: str, top: bool) -> list[str]:
        roles = []
        file = (self.path or "").rsplit("/", 1)[-1]
        if top and (name in self.exported or (file == "__init__.py" and not name.startswith("_"))):
            roles.append("exported")
        if name.startswith("test") and (file.startswith("test") or file.endswith("_test.py")):
            roles.append("test")
        for d in node.decorator_list:
            last = _last_name(d)
            if last in _ROUTES and isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant):
                roles.append("route")
            elif last in ("fixture", "command", "task", "receiver", "listens_for", "hookimpl"):
                roles.append("callback")
            if last == "fixture":
                self.symbols.append(("fixture", name))
        return roles

    def _define(self, node, kind: str):
        qual = f"{self.qual}.{node.name}" if self.qual else node.name
        ident = self._id(qual)
        for d in node.decorator_list:
            self.visit(d)
        if kind == "Class":
            for b in node.bases:
                if name := _last_name(b):
                    self._ref_from(ident, "INHERITS", name, b)
            arity, stub = None, False
        else:
            a = node.args
            arity = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
            stub = is_stub(node)
            for part in [*a.defaults, *[d for d in a.kw_defaults if d], *[x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if x.annotation], *([node.returns] if node.returns else [])]:
                self.visit(part)
        self._node(ident, kind, node.name, node.lineno, node.end_lineno, stub, arity, ast.get_docstring(node), self._roles(node, node.name, not self.qual))
        held = self.owner, self.cls, self.qual, self.locals, self.declared
        self.owner, self.qual, self.locals, self.declared = ident, qual, {}, set()
        if kind == "Class":
            self.cls = f"{self.path or ''}::{qual}"
        else:
            for x in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                if x.annotation is not None and (name := _last_name(x.annotation)):
                    self.locals[x.arg] = name
        for s in node.body:
            self.visit(s)
        self.owner, self.cls, self.qual, self.locals, self.declared = held

    def _ref_from(self, src: str, relation: str, symbol: str, node: ast.AST):
        self.refs.append((src, relation, symbol, None, False, node.lineno))

    def visit_ClassDef(self, node):  # noqa: N802
        self._define(node, "Class")

    def visit_FunctionDef(self, node):  # noqa: N802
        self._define(node, "Method" if self.cls and self.qual == self.cls.split("::", 1)[1] else "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self._ref("IMPORTS", a.name, node, "module")

    def visit_ImportFrom(self, node):  # noqa: N802
        base = node.module or ""
        if node.level:
            parts = module_name(self.path or "").split(".")
            keep = len(parts) - node.level + (self.path or "").endswith("__init__.py")
            base = ".".join([*parts[: max(0, keep)], *([base] if base else [])])
        self._ref("IMPORTS", base, node, "module")
        for a in node.names:
            if a.name != "*":
                self._ref("IMPORTS", a.name, node, f"from {base}")

    def _state(self, relation: str, target: ast.AST):
        """A read or write of a variable of the module or of the object, kept by file or class."""
        if self.owner == self.module:
            return
        if isinstance(target, ast.Name) and target.id in self.globals:
            self._ref(relation, target.id, target, f"state {self.path or ''}")
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and self.cls:
            self._ref(relation, target.attr, target, f"state {self.cls}")

    def _written(self, target: ast.AST):
        if isinstance(target, ast.Subscript):
            self._state("WRITES", target.value)
        elif isinstance(target, ast.Attribute) or (isinstance(target, ast.Name) and target.id in self.declared):
            self._state("WRITES", target)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self._written(t)

    def visit_Global(self, node):  # noqa: N802
        self.declared |= set(node.names)

    def visit_AugAssign(self, node):  # noqa: N802
        self._written(node.target)
        self._state("READS", node.target)
        self.generic_visit(node)

    def visit_Assign(self, node):  # noqa: N802
        for t in node.targets:
            self._written(t)
        if isinstance(node.value, ast.Call) and (name := _last_name(node.value)) and name[:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.locals[t.id] = name
        self.generic_visit(node)

    def _member(self, relation: str, node: ast.Attribute):
        base = node.value.id if isinstance(node.value, ast.Name) else None
        scope = self.cls if base in ("self", "cls") else f"type {self.locals[base]}" if base in self.locals else None
        self._ref(relation, node.attr, node, scope, True)

    def visit_Call(self, node):  # noqa: N802
        f = node.func
        if isinstance(f, ast.Name):
            self._ref("CALLS", f.id, f)
            if f.id == "getattr" and len(node.args) > 1:
                self._dispatch(node.args[1], node)
        elif isinstance(f, ast.Attribute):
            self._member("CALLS", f)
            if f.attr in _MUTATORS:
                self._state("WRITES", f.value)
            self.visit(f.value)
        else:
            self.visit(f)
        for x in [*node.args, *[k.value for k in node.keywords]]:
            self.visit(x)

    def _dispatch(self, name: ast.AST, node: ast.AST):
        """A name made at run time: what is literal of it, before and after, is a pattern."""
        text = lambda e: e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None
        if text(name):
            self._ref("REFERENCES", text(name), node, None, True)
            return
        if isinstance(name, ast.JoinedStr) and name.values:
            before, after = text(name.values[0]) or "", text(name.values[-1]) or ""
        elif isinstance(name, ast.BinOp) and isinstance(name.op, ast.Add):
            before, after = text(name.left) or "", text(name.right) or ""
        else:
            return
        if len(before) + len(after) > 1:
            self._ref("REFERENCES", f"{before}*{after}", node, "pattern", True)

    def visit_Attribute(self, node):  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self._member("REFERENCES", node)
            self._state("READS", node)
        self.visit(node.value)

    def visit_Name(self, node):  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self._ref("REFERENCES", node.id, node)
            self._state("READS", node)

    def visit_With(self, node):  # noqa: N802
        for item in node.items:
            if (name := _last_name(item.context_expr)) and name[:1].isupper():
                self._ref("CALLS", "__enter__", node, f"type {name}", True)
                self._ref("CALLS", "__exit__", node, f"type {name}", True)
        self.generic_visit(node)


_HEADER = re.compile(r"([ \t]*)(?:async[ \t]+def|def|class)\b.*:[ \t]*(?:#.*)?\r?$")


def _says(line: str) -> bool:
    """Whether a line holds more than blanks and a comment."""
    bare = line.strip()
    return bool(bare) and not bare.startswith("#")


def _parses(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _with_bodies(lines: list[str]) -> list[str]:
    """The lines with an empty body for every definition that has none, on its own line."""
    out = list(lines)
    spoken = [i for i, line in enumerate(lines) if _says(line)]
    for i, after in zip(spoken, [*spoken[1:], None]):
        if _HEADER.match(lines[i]) and (after is None or _indent(lines[after]) <= _indent(lines[i])):
            head = lines[i].split("#")[0].rstrip() if "#" in lines[i] else lines[i].rstrip()
            out[i] = head + " pass"
    return out


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


#: Lines of one part that are given up before the part is.
GIVEN_UP = 20


def rescue(text: str) -> tuple[ast.Module, int]:
    """The tree of a text, and how many of its lines had to be given up for it to parse.

    Lines keep their numbers. A definition without a body gets an empty one; indented lines before
    anything else, the rest of a body that was cut off, are given up; then, if it must be, in each
    part between two unindented lines those that the parser stops at, or else the part. In place of
    such a line stands an expression without meaning, so what lost its body is no stub.
    """
    if (tree := _parses(text)) is not None:
        return tree, 0
    lines = text.split("\n")
    spoken = [i for i, line in enumerate(lines) if _says(line)]
    lost = 0
    for i in spoken:
        if not _indent(lines[i]):
            break
        lines[i], lost = "", lost + 1
    if (tree := _parses("\n".join(_with_bodies(lines)))) is not None:
        return tree, lost
    starts = [i for i in spoken if lines[i] and not _indent(lines[i])]
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        part, gone, fits = lines[a:b], 0, False
        while not fits and gone <= GIVEN_UP:
            try:
                ast.parse("\n".join(_with_bodies(part)))
                fits = True
            except SyntaxError as error:
                at = min((error.lineno or 1), len(part)) - 1
                while at > 0 and not _says(part[at]):
                    at -= 1
                if at <= 0:
                    break
                part[at], gone = " " * _indent(part[at]) + "None", gone + 1
            except (ValueError, RecursionError, MemoryError):
                break
        lost += gone if fits else sum(map(_says, lines[a:b]))
        lines[a:b] = part if fits else [""] * (b - a)
    tree = _parses("\n".join(_with_bodies(lines)))
    return (tree, lost) if tree is not None else (ast.Module([], []), len(spoken))


def parse_file(path: str | None, text: str) -> _File | None:
    """What a file holds; of one that does not parse, what can be rescued of it, None if nothing can."""
    tree, lost = rescue(text)
    with _deep():
        return None if lost and not tree.body else _File(path, tree)


def given_up(sources: DataFrame) -> DataFrame:
    """(snapshot, path, n_lines) of files of which lines were given up to parse the rest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["snapshot", "path"]].assign(n_lines=[rescue(t)[1] for t in pdf["text"]])

    return sources.select("snapshot", "path", "text").mapInPandas(run, "snapshot int, path string, n_lines int").where("n_lines > 0")


def _emit(what: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for snapshot, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]):
                found = parse_file(path, text)
                if found is None:
                    continue
                if what == "nodes":
                    rows += [(snapshot, *x, path) for x in found.nodes]
                elif what == "refs":
                    rows += [(snapshot, *x, path) for x in found.refs]
                else:
                    rows += [(path, *x) for x in found.symbols]
            schema = {"nodes": NODE_SCHEMA, "refs": REF_SCHEMA, "symbols": SYMBOL_SCHEMA}[what]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return run


def definitions(sources: DataFrame) -> DataFrame:
    """Nodes of (snapshot, path, text) rows; of files that do not parse, what can be rescued."""
    return sources.select("snapshot", "path", "text").mapInPandas(_emit("nodes"), NODE_SCHEMA)


def references(sources: DataFrame) -> DataFrame:
    return sources.select("snapshot", "path", "text").mapInPandas(_emit("refs"), REF_SCHEMA)


def symbols(sources: DataFrame) -> DataFrame:
    """(file, kind, name) of constants, exports, fixtures and main blocks."""
    return sources.select(F.lit(0).alias("snapshot"), "path", "text").mapInPandas(_emit("symbols"), SYMBOL_SCHEMA)


#: Rows of files that a task hands on at once.
AT_ONCE = 50_000


def _all_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for pdf in frames:
        for snapshot, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]):
            found = parse_file(path, text)
            if found is None:
                continue
            none = [None] * 6
            # what, snapshot, file; node: id, kind, name, location, end_line, is_stub, arity, summary, roles; reference: src ... line
            rows += [("node", snapshot, path, *x, *none) for x in found.nodes]
            rows += [("reference", snapshot, path, *none, *none[:3], *x) for x in found.refs]
            rows += [("symbol", snapshot, path, None, *x, *none, *none) for x in found.symbols]
            if len(rows) >= AT_ONCE:
                yield pd.DataFrame(rows, columns=_ALL)
                rows = []
    yield pd.DataFrame(rows, columns=_ALL)


_KINDS = dict(c.split() for c in ", ".join(("what string", NODE_SCHEMA, REF_SCHEMA)).split(", "))
_ALL = ["what", "snapshot", "file", *[c for c in _KINDS if c not in ("what", "snapshot", "file")]]


def extracted(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``definitions``, ``references`` and ``symbols`` of files, each parsed once: what stands in them is
    written, so that plans which read it many times neither parse again nor hold the extraction."""
    ws = Workspace(sources.sparkSession, "extracted")
    rows = sources.select("snapshot", "path", "text").mapInPandas(_all_rows, ", ".join(f"{c} {_KINDS[c]}" for c in _ALL))
    rows = ws.write(rows, "rows", partition_by=("what",))
    shown = lambda what, schema: rows.where(F.col("what") == what).select(*[c.split()[0] for c in schema.split(", ")])
    return shown("node", NODE_SCHEMA), shown("reference", REF_SCHEMA), shown("symbol", SYMBOL_SCHEMA)


def state_edges(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of mutable state: variables that some function writes, with those that write
    and read them; state of an object only if one method writes what another reads."""
    used = refs.where(F.startswith("scope", F.lit("state "))).withColumn("holder", F.expr("substring(scope, 7)"))
    used = used.select("snapshot", "src", "relation", "dst_symbol", "holder", F.concat(F.lit("var::"), "holder", F.lit("::"), "dst_symbol").alias("dst_id"), "file").distinct()
    writes, reads = used.where("relation = 'WRITES'"), used.where("relation = 'READS'")
    key = ["snapshot", "dst_id"]
    pairs = writes.select(*key, F.col("src").alias("writer")).join(reads.select(*key, F.col("src").alias("reader")), key)
    apart = pairs.where("writer <> reader").select(*key).distinct()
    shared = used.where(~F.col("holder").contains("::")).join(writes.select(*key).distinct(), key, "left_semi")
    own = used.where(F.col("holder").contains("::")).join(apart, key, "left_semi")
    both = shared.unionByName(own.select(*shared.columns))
    edges = both.select("snapshot", "src", "relation", "dst_symbol", "dst_id", F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.lit("ast").alias("source"), F.lit(False).alias("name_based"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("location", "string"), ("end_line", "int"))]
    made = both.select("snapshot", F.col("dst_id").alias("id"), F.lit("Variable").alias("kind"), F.col("dst_symbol").alias("name"), *none, F.lit(False).alias("is_stub"), F.lit(None).cast("int").alias("arity"), F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("roles"), "file")
    return made.distinct(), edges


def resolve(nodes: DataFrame, refs: DataFrame, consts: DataFrame | None = None) -> DataFrame:
    """Edges of references, in the order of certainty: a member of the enclosing class, an import
    by module path, a member of a typed local (widened by name too), all nodes of the name.

    One candidate by name has weight 1, and is inferred if a receiver stands before it; several
    share it, ambiguous. A name nothing has is external and gives no edge; a name imported from a
    module of the project that does not define it, not even as a constant, leaves a hole.
    """
    ids = nodes.select("snapshot", F.col("id").alias("dst_id"), F.col("kind").alias("dst_kind"), F.col("name").alias("dst_name"), F.col("file").alias("dst_file"))
    refs = refs.where(F.col("scope").isNull() | ~F.startswith("scope", F.lit("state ")))
    refs = refs.withColumn("site", F.xxhash64("src", "relation", "dst_symbol", "scope", "line"))
    base = ["snapshot", "src", "relation", "dst_symbol", "receiver", "site"]

    own = refs.where(F.col("scope").contains("::")).withColumn("dst_id", F.concat("scope", F.lit("."), "dst_symbol"))
    own = own.join(ids.select("snapshot", "dst_id"), ["snapshot", "dst_id"]).select(*base, "dst_id", F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.lit(False).alias("name_based"))

    modules = ids.where(F.col("dst_kind") == "Module").select("snapshot", "dst_id", "dst_name", "dst_file")
    loads = refs.where(F.col("scope") == "module").join(modules.withColumnRenamed("dst_name", "dst_symbol"), ["snapshot", "dst_symbol"])
    loads = loads.select(*base, "dst_id", F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.lit(False).alias("name_based"))
    names = refs.where(F.startswith("scope", F.lit("from "))).withColumn("module", F.expr("substring(scope, 6)"))
    here = names.join(modules.select("snapshot", F.col("dst_name").alias("module"), F.col("dst_file").alias("home")), ["snapshot", "module"])
    inside = ids.where(F.col("dst_kind") != "Module").select("snapshot", F.col("dst_file").alias("home"), F.col("dst_name").alias("dst_symbol"), "dst_id")
    defined = here.join(inside, ["snapshot", "home", "dst_symbol"], "left")
    bound = defined.where(F.col("dst_id").isNotNull()).select(*base, "dst_id", F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.lit(False).alias("name_based"))
    sub = names.withColumn("dst_name", F.concat_ws(".", "module", "dst_symbol")).join(modules, ["snapshot", "dst_name"])
    sub = sub.select(*base, "dst_id", F.lit(1.0).alias("weight"), F.lit("extracted").alias("provenance"), F.lit(False).alias("name_based"))
    lost = defined.where(F.col("dst_id").isNull()).join(sub.select("snapshot", "site"), ["snapshot", "site"], "left_anti")
    if consts is not None:
        fixed = consts.where(F.col("kind") == "const").select(F.col("file").alias("home"), F.col("name").alias("dst_symbol"))
        lost = lost.join(fixed, ["home", "dst_symbol"], "left_anti")
    lost = lost.select(*base, F.lit(None).cast("string").alias("dst_id"), F.lit(0.6).alias("weight"), F.lit("inferred").alias("provenance"), F.lit(False).alias("name_based"))

    sure = own.unionByName(loads).unionByName(bound).unionByName(sub)
    classes = nodes.where(F.col("kind") == "Class").select("snapshot", F.col("name").alias("typed"), F.col("id").alias("cls"))
    typed = refs.where(F.startswith("scope", F.lit("type "))).withColumn("typed", F.expr("substring(scope, 6)")).join(classes, ["snapshot", "typed"])
    typed = typed.withColumn("dst_id", F.concat("cls", F.lit("."), "dst_symbol")).join(ids.select("snapshot", "dst_id"), ["snapshot", "dst_id"])
    typed = typed.select(*base, "dst_id", F.lit(1.0).alias("weight"), F.lit("inferred").alias("provenance"), F.lit(False).alias("name_based"))

    free = refs.where(F.col("relation") != "IMPORTS").join(sure.select("snapshot", "site"), ["snapshot", "site"], "left_anti")
    near = free.join(ids.where(F.col("dst_kind") != "Module").withColumnRenamed("dst_name", "dst_symbol"), ["snapshot", "dst_symbol"])
    near = near.where(same_language(F.col("src"), F.col("dst_id")))
    n = near.groupBy("snapshot", "site", "src").agg(F.countDistinct("dst_id").alias("n"))
    near = near.join(n, ["snapshot", "site", "src"])
    guess = F.when(F.col("n") > 1, "ambiguous").when(F.col("receiver"), "inferred").otherwise("extracted")
    near = near.select(*base, "dst_id", F.round(F.lit(1.0) / F.col("n"), 3).alias("weight"), guess.alias("provenance"), F.lit(True).alias("name_based"))
    near = near.where((F.col("src") != F.col("dst_id")) | (F.col("relation") == "CALLS"))
    # a name made at run time: every name that begins and ends like it, found by the longer end's letters
    made = free.where("scope = 'pattern'").withColumn("head", F.substring_index("dst_symbol", "*", 1)).withColumn("tail", F.substring_index("dst_symbol", "*", -1))
    made = made.withColumn("by_head", F.length("head") >= F.length("tail")).withColumn("hint", F.when(F.col("by_head"), F.substring("head", 1, 1)).otherwise(F.expr("right(tail, 1)")))
    ends = F.explode(F.array(F.struct(F.lit(True).alias("by_head"), F.substring("dst_name", 1, 1).alias("hint")), F.struct(F.lit(False).alias("by_head"), F.expr("right(dst_name, 1)").alias("hint"))))
    names_by_end = ids.where(F.col("dst_kind") != "Module").select("snapshot", "dst_id", "dst_name", ends.alias("x")).select("snapshot", "dst_id", "dst_name", "x.*")
    fits = F.startswith(F.col("dst_name"), F.col("head")) & F.endswith(F.col("dst_name"), F.col("tail")) & (F.length("dst_name") > F.length("head") + F.length("tail"))
    made = made.join(names_by_end, ["snapshot", "by_head", "hint"]).where(fits & same_language(F.col("src"), F.col("dst_id")))
    many = made.groupBy("snapshot", "site", "src").agg(F.countDistinct("dst_id").alias("n"))
    made = made.join(many, ["snapshot", "site", "src"]).select(*base, "dst_id", F.round(F.lit(1.0) / F.col("n"), 3).alias("weight"), F.lit("ambiguous").alias("provenance"), F.lit(False).alias("name_based"))
    everything = sure.unionByName(lost).unionByName(typed).unionByName(near).unionByName(made)
    return everything.select("snapshot", "src", "relation", "dst_symbol", "dst_id", "weight", "provenance", F.lit("ast").alias("source"), "name_based").distinct()

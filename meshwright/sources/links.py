"""Edges between languages: patterns found in files, joined by name, path or table.

A task scans a file for patterns and emits what it found; the other end is a key. Keys are then
joined with the nodes that have them, and several ends share the weight.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.ids import start_line

RAW_SCHEMA = "snapshot int, file string, line int, source string, left string, relation string, right string, left_by string, right_by string, weight double"

_HTTP = "get|post|put|delete|patch|options|head|all"
_WORD = r"[A-Za-z_][\w]*"
_PATTERNS = {
    "decorator": re.compile(rf"@\w+(?:\.\w+)*\.(?:{_HTTP}|route|websocket)\(\s*[rf]?['\"]([^'\"]*)['\"][^\n]*\n(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+({_WORD})"),
    "urlconf": re.compile(rf"\b(?:re_)?path\(\s*r?['\"]([^'\"]*)['\"]\s*,\s*(?:{_WORD}\.)*({_WORD})"),
    "express": re.compile(rf"\b(?!axios\b|http\b|client\b|fetch\b)(?:\w+)\.(?:{_HTTP})\(\s*['\"`](/[^'\"`]*)['\"`]\s*,(?:[^()\n]*,)?\s*(?:\w+\.)*({_WORD})\s*\)"),
    "spring": re.compile(rf"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?\"([^\"]*)\"[^)]*\)\s*(?:@[^\n]*\s+)*(?:public|protected|private)?\s*[\w<>\[\], ?.]+?\s+({_WORD})\s*\("),
    "fetch": re.compile(r"\b(?:fetch|axios(?:\.\w+)?)\(\s*['\"`](/[^'\"`?]*)"),
    "member": re.compile(r"\{\{\s*([\w.]+)"),
    "emit": re.compile(r"\b\w+\.(?:emit|publish|dispatch)\(\s*['\"]([^'\"]+)['\"]"),
    "handle": re.compile(rf"\b\w+\.(?:on|once|subscribe|add_listener|addListener)\(\s*['\"]([^'\"]+)['\"]\s*,\s*(?:\w+\.)*({_WORD})"),
    "send": re.compile(r"\b(\w+)\.send(?:_robust)?\("),
    "connect": re.compile(rf"\b(\w+)\.connect\(\s*({_WORD})"),
    "tablename": re.compile(rf"^class\s+({_WORD})[^\n]*:(?:\n(?:[ \t][^\n]*)?)*?\n[ \t]+__tablename__\s*=\s*['\"]([^'\"]+)['\"]", re.MULTILINE),
    "prisma": re.compile(rf"^model\s+({_WORD})\s*\{{(.*?)^\}}", re.MULTILINE | re.DOTALL),
    "entity": re.compile(rf"@Entity\(\s*['\"]([^'\"]+)['\"][^)]*\)\s*(?:export\s+)?(?:default\s+)?class\s+({_WORD})"),
    "service": re.compile(rf"service\s+({_WORD})\s*\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}"),
    "rpc": re.compile(rf"rpc\s+({_WORD})\s*\("),
    "string": re.compile(r"(?:\"\"\"|''')(.*?)(?:\"\"\"|''')|\"([^\"\n]*)\"|'([^'\n]*)'", re.DOTALL),
}
_SQL = re.compile(r"^\s*(?:with|select|insert|update|delete|merge|replace)\b", re.IGNORECASE)
_CTE = re.compile(rf"(?:\bwith|,)\s*(?:recursive\s+)?({_WORD})\s*(?:\([^)]*\))?\s+as\s*\(", re.IGNORECASE)
_READ = re.compile(rf"\b(?:from|join)\s+[\"`\[]?({_WORD}(?:\.{_WORD})?)", re.IGNORECASE)
_WRITE = re.compile(rf"\b(?:insert\s+(?:or\s+\w+\s+)?into|replace\s+into|merge\s+into|update|delete\s+from)\s+[\"`\[]?({_WORD}(?:\.{_WORD})?)", re.IGNORECASE)
# Members of a template that name the loop or form, not code.
_TEMPLATE_WORDS = {"forloop", "loop", "request", "user", "csrf_token", "block", "super", "self", "id", "name", "url", "count", "items", "keys", "values"}
_NOT_TABLES = {"select", "set", "where", "values", "the", "only", "lateral", "unnest"}


def norm_path(path: str) -> str:
    return "/" + path.strip().strip("/")


class _Forms(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        action = dict(attrs).get("action")
        if tag == "form" and action and action.startswith("/"):
            self.found.append((self.getpos()[0], action))


def sql_tables(text: str) -> tuple[set[str], set[str]]:
    """(read, written) tables of a statement, without its own named queries."""
    own = {m.lower() for m in _CTE.findall(text)}
    written = {m for m in _WRITE.findall(text) if m.lower() not in own | _NOT_TABLES}
    stripped = re.sub(r"\bdelete\s+from\b", "delete", text, flags=re.IGNORECASE)
    return {m for m in _READ.findall(stripped) if m.lower() not in own | _NOT_TABLES}, written


def scan(path: str, text: str) -> Iterator[tuple[int, str, str, str, str, str, str, float]]:
    """(line, source, left, relation, right, left_by, right_by, weight) of one file.

    ``*_by`` says what an end is: 'id' as it stands, 'name' of a node, 'line' of the enclosing
    one, 'route' by path, 'class' by name, 'member' as class.member.
    """
    ext = path.rsplit(".", 1)[-1].lower()
    line = lambda m: text.count("\n", 0, m.start()) + 1
    every = lambda name: _PATTERNS[name].finditer(text)
    if ext == "py":
        for m in every("decorator"):
            yield line(m), "routes", "route::" + norm_path(m[1]), "ROUTES_TO", m[2], "id", "name", 0.9
        for m in every("urlconf"):
            yield line(m), "urlconf", "route::" + norm_path(m[1]), "ROUTES_TO", m[2], "id", "name", 0.85
        for m in every("tablename"):
            yield line(m), "orm", m[1], "MAPS_TO", "db::" + m[2], "class", "id", 0.7
        for m in every("send"):
            if m[1][:1].islower() and m[1] not in ("self", "socket", "sock", "conn", "session", "client"):
                yield line(m), "events", "", "EMITS", "event::" + m[1], "line", "id", 0.7
        for m in every("connect"):
            yield line(m), "events", "event::" + m[1], "HANDLES", m[2], "id", "name", 0.7
    if ext in ("js", "jsx", "ts", "tsx", "mjs", "cjs"):
        for m in every("express"):
            yield line(m), "express", "route::" + norm_path(m[1]), "ROUTES_TO", m[2], "id", "name", 0.8
        for m in every("fetch"):
            yield line(m), "fetch", "", "SUBMITS_TO", norm_path(m[1]), "line", "route", 0.75
        for m in every("entity"):
            yield line(m), "typeorm", m[2], "MAPS_TO", "db::" + m[1], "class", "id", 0.9
    if ext in ("py", "js", "jsx", "ts", "tsx", "mjs", "cjs"):
        for m in every("emit"):
            yield line(m), "events", "", "EMITS", "event::" + m[1], "line", "id", 0.7
        for m in every("handle"):
            yield line(m), "events", "event::" + m[1], "HANDLES", m[2], "id", "name", 0.7
    if ext in ("py", "js", "ts", "go", "java", "rb", "php", "cs", "rs"):
        for m in every("string"):
            said = next(x for x in m.groups() if x is not None)
            if _SQL.match(said):
                reads, writes = sql_tables(said)
                for t in sorted(reads | writes):
                    yield line(m), "sql", "", "QUERIES", "db::" + t, "line", "id", 0.8
                for t in sorted(reads):
                    yield line(m), "sql", "", "READS", "db::" + t, "line", "id", 0.8
                for t in sorted(writes):
                    yield line(m), "sql", "", "WRITES", "db::" + t, "line", "id", 0.8
    if ext == "java":
        for m in every("spring"):
            yield line(m), "spring", "route::" + norm_path(m[1]), "ROUTES_TO", m[2], "id", "name", 0.85
    if ext == "prisma":
        for m in every("prisma"):
            named = re.search(r"@@map\(\s*(?:name:\s*)?\"([^\"]+)\"", m[2])
            yield line(m), "prisma", m[1], "MAPS_TO", "db::" + (named[1] if named else m[1]), "class", "id", 0.8
    if ext == "proto":
        for m in every("service"):
            for r in _PATTERNS["rpc"].finditer(m[2]):
                for suffix in ("Servicer", "Base", "Impl"):
                    yield line(m), "grpc", f"route::/{m[1]}/{r[1]}", "ROUTES_TO", f"{m[1]}{suffix}.{r[1]}", "id", "member", 0.9
    if ext in ("html", "htm", "jinja", "j2", "tpl"):
        forms = _Forms()
        forms.feed(text)
        for at, action in forms.found:
            yield at, "html", f"template::{path}", "SUBMITS_TO", norm_path(action.split("?")[0]), "id", "route", 0.8
        for m in every("member"):
            last = m[1].rsplit(".", 1)[-1]
            if "." in m[1] and last not in _TEMPLATE_WORDS and not last.isdigit():
                yield line(m), "template", f"template::{path}", "REFERENCES", last, "id", "name", 0.8
    if ext in ("json", "yaml", "yml") and "paths" in text:
        try:
            paths = json.loads(text).get("paths", {})
            items = [(p, op) for p, ops in paths.items() for k, op in ops.items() if re.fullmatch(_HTTP, k) and isinstance(op, dict)]
        except (ValueError, AttributeError):
            items = []
        for p, op in items:
            if isinstance(op.get("operationId"), str):
                yield 1, "openapi", "route::" + norm_path(p), "ROUTES_TO", op["operationId"], "id", "name", 0.9


def _scan_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for snapshot, path, text in zip(pdf["snapshot"], pdf["path"], pdf["text"]):
            rows += [(snapshot, path, *x) for x in scan(path, text)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW_SCHEMA.split(", ")])


def raw_links(sources: DataFrame) -> DataFrame:
    return sources.select("snapshot", "path", "text").mapInPandas(_scan_rows, RAW_SCHEMA)


def innermost(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(snapshot, file, line, id): the smallest node whose span holds a line, else the module."""
    spans = nodes.where(F.col("end_line").isNotNull()).select("snapshot", "file", "id", start_line(F.col("location")).alias("lo"), F.col("end_line").alias("hi"))
    spans = spans.where(F.col("lo").isNotNull()).where(F.col("hi") >= F.col("lo"))
    hit = places.join(spans, ["snapshot", "file"]).where((F.col("lo") <= F.col("line")) & (F.col("line") <= F.col("hi")))
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("span"), "id")).alias("x")
    return hit.groupBy("snapshot", "file", "line").agg(best).select("snapshot", "file", "line", F.col("x.id").alias("id"))


def link(nodes: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, edges) of what was found: routes, tables, events and templates become nodes.

    A name that several code nodes have gets an edge to each, ambiguous, the weight shared; an
    end that nothing has gives no edge.
    """
    raw = raw.withColumn("site", F.xxhash64("file", "line", "source", "left", "relation", "right"))
    places = raw.where("left_by = 'line'").select("snapshot", "file", "line").distinct()
    around = innermost(nodes, places).withColumnRenamed("id", "holder")
    code = nodes.where(F.col("kind").isin("Function", "Method", "Class")).select("snapshot", "id", "name", "kind")
    with_left = raw.join(around, ["snapshot", "file", "line"], "left")
    by_class = code.where("kind = 'Class'").select("snapshot", F.col("name").alias("left"), F.col("id").alias("class_id"))
    with_left = with_left.join(by_class, ["snapshot", "left"], "left")
    src = F.when(F.col("left_by") == "id", F.col("left")).when(F.col("left_by") == "line", F.col("holder")).otherwise(F.col("class_id"))
    with_left = with_left.withColumn("src", src).where(F.col("src").isNotNull()).drop("holder", "class_id")

    named = code.select("snapshot", F.col("name").alias("right"), F.col("id").alias("dst_id"))
    member = code.where("kind = 'Method'").select("snapshot", F.substring_index(F.substring_index("id", "::", -1), ".", -2).alias("right"), F.col("id").alias("dst_id"))
    routes = raw.where(F.startswith("left", F.lit("route::"))).select("snapshot", F.expr("substring(left, 8)").alias("right"), F.col("left").alias("dst_id")).distinct()
    known = nodes.where("kind = 'Route'").select("snapshot", F.col("name").alias("right"), F.col("id").alias("dst_id"))
    routes = routes.unionByName(known).distinct()
    parts = [with_left.where("right_by = 'id'").withColumn("dst_id", F.col("right"))]
    parts += [with_left.where(F.col("right_by") == by).join(ends, ["snapshot", "right"]) for by, ends in (("name", named), ("member", member), ("route", routes))]
    columns = ["snapshot", "site", "src", "relation", "right", "dst_id", "weight", "source", "file", "line"]
    both = parts[0].select(*columns)
    for part in parts[1:]:
        both = both.unionByName(part.select(*columns))
    n = F.count(F.lit(1)).over(Window.partitionBy("snapshot", "site", "src"))
    both = both.distinct().withColumn("n", n)
    edges = both.select(
        "snapshot", "src", "relation", F.col("right").alias("dst_symbol"), "dst_id", F.round(F.col("weight") / F.col("n"), 3).alias("weight"), F.when(F.col("n") > 1, "ambiguous").otherwise("inferred").alias("provenance"), "source", F.lit(False).alias("name_based")
    ).distinct()
    ends = edges.select("snapshot", F.explode(F.array("src", "dst_id")).alias("id")).distinct()
    kind = F.when(F.startswith("id", F.lit("route::")), "Route").when(F.startswith("id", F.lit("db::")), "DBTable").when(F.startswith("id", F.lit("event::")), "Event").when(F.startswith("id", F.lit("template::")), "Template")
    made = ends.withColumn("kind", kind).where("kind IS NOT NULL").join(nodes.select("snapshot", "id"), ["snapshot", "id"], "left_anti")
    return made.select("snapshot", "id", "kind", F.substring_index("id", "::", -1).alias("name")), edges

"""Operations on source files, run over the code listings among the documents, and on line coverage,
run over reports in three formats that are written from the nodes and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ids import start_line
from meshwright.operators.graph import Graph, load_graph
from meshwright.plans.graphsql import GRAPH
from meshwright.sources import artifacts, bodies, pysource
from meshwright.tables import periods, table

SNIPPET = "def total(xs):\n    out = 0\n    for x in xs:\n        if x:\n            out += x\n    return out\n"


def listings(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, path, text) of all code listings, each a file of its own."""
    docs = table(spark, d, "documents").where((F.lower(F.trim("source")) == "code_listing") & F.col("text").isNotNull())
    return docs.select(F.lit(1).alias("snapshot"), F.concat(F.lit("listings/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")


def python_nodes(spark: SparkSession, d: str) -> DataFrame:
    found = pysource.definitions(listings(spark, d)).where("kind <> 'Module'")
    return found.select("id", "kind", "name", "location", "arity", "is_stub")


def python_edges(spark: SparkSession, d: str) -> DataFrame:
    return pysource.resolve(*pysource.extracted(listings(spark, d)))


def python_bases(spark: SparkSession, d: str) -> DataFrame:
    """(src, base, line, n_candidates): bases of classes and what the name may mean in all files."""
    nodes, refs, _ = pysource.extracted(listings(spark, d))
    named = refs.where("relation = 'INHERITS'")
    edges = pysource.resolve(nodes, named)
    found = edges.groupBy("src", F.col("dst_symbol").alias("base")).agg(F.countDistinct("dst_id").alias("n_candidates"))
    return named.select("src", F.col("dst_symbol").alias("base"), "line").join(found, ["src", "base"], "left").fillna(0, ["n_candidates"])


def similar_structure(spark: SparkSession, d: str) -> DataFrame:
    found = bodies.similar_shape(bodies.fingerprints(listings(spark, d)), SNIPPET)
    return found.select("snapshot", "id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def unused_params(spark: SparkSession, d: str) -> DataFrame:
    return bodies.unused(listings(spark, d)).select("id", "parameter")


def statement_matrix(spark: SparkSession, d: str) -> DataFrame:
    return bodies.body_matrix(listings(spark, d), "statement")


def expression_matrix(spark: SparkSession, d: str) -> DataFrame:
    return bodies.body_matrix(listings(spark, d), "expression")


def coverage_reports(graph: Graph, period: int) -> DataFrame:
    """(artifact, value): a report per file of a snapshot in which every node with known lines ran;
    in the format of its language: blocks for Go, JSON for Python, records of lines for others."""
    lines = graph.nodes.where(F.col("snapshot") == period).select("file", start_line(F.col("location")).alias("first"), F.col("end_line").alias("last"))
    spans = lines.dropna().groupBy("file").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    go = F.concat(F.lit("mode: set\n"), F.array_join(F.transform("spans", lambda s: F.concat("file", F.lit(":"), s["first"], F.lit(".1,"), s["last"], F.lit(".2 1 1"))), "\n"))
    json = F.to_json(F.struct(F.create_map("file", F.struct(F.transform("spans", lambda s: s["last"]).alias("executed_lines"))).alias("files")))
    lcov = F.concat(F.lit("TN:\nSF:"), "file", F.lit("\n"), F.array_join(F.transform("spans", lambda s: F.concat(F.lit("DA:"), s["last"], F.lit(",1"))), "\n"), F.lit("\nend_of_record\n"))
    kind = F.substring_index("file", ".", -1)
    return spans.select(F.col("file").alias("artifact"), F.when(kind == "go", go).when(kind == "py", json).otherwise(lcov).alias("value"))


def _spans(spark: SparkSession, d: str, graph: Graph) -> DataFrame:
    return artifacts.line_coverage(coverage_reports(graph, max(periods(spark, d))))


def line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """(file, first, last) of spans that ran, read from the reports of the last snapshot."""
    return _spans(spark, d, load_graph(spark, d)).select("file", "first", "last").distinct()


def runtime_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, id) of nodes of which a line ran in the last snapshot's reports, by the role they get."""
    graph = load_graph(spark, d)
    seen = artifacts.ingest_trace(graph.nodes.withColumn("roles", F.array_remove("roles", "runtime")), _spans(spark, d, graph))
    return seen.where(F.array_contains("roles", "runtime")).select("snapshot", "id")


QUERIES = {
    "python_nodes": python_nodes,
    "python_edges": python_edges,
    "python_bases": python_bases,
    "similar_structure": similar_structure,
    "unused_params": unused_params,
    "statement_matrix": statement_matrix,
    "expression_matrix": expression_matrix,
    "line_coverage": line_coverage,
    "runtime_nodes": runtime_nodes,
}

_LISTED = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE lower(trim(source)) = 'code_listing' AND text IS NOT NULL),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM docs),
said AS (
  SELECT *, max(CASE WHEN regexp_matches(line, '^\S') THEN no END) OVER (PARTITION BY doc_id ORDER BY no) AS head
  FROM lines WHERE regexp_matches(line, '^\s*[^\s#]')),
defs AS (
  SELECT doc_id, no, word, name, params, 'listings/' || doc_id || '.py' AS path, body,
    row_number() OVER (PARTITION BY doc_id, name ORDER BY no) AS nth
  FROM (
    SELECT doc_id, no, regexp_extract(line, '^(def|class) ', 1) AS word, regexp_extract(line, '^(?:def|class) (\w+)', 1) AS name,
      regexp_extract(line, '\((.*)\)', 1) AS params,
      (SELECT string_agg(s.line, chr(10) ORDER BY s.no) FROM said s WHERE s.doc_id = said.doc_id AND s.head = said.no AND s.no > said.no) AS body
    FROM said WHERE regexp_matches(line, '^(def|class) \w+\(.*\):\s*$'))),
named AS (SELECT *, path || '::' || name || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END AS id FROM defs)
"""

_RAN = """
, lasts AS (SELECT DISTINCT n.file, CAST(try_cast(split_part(n.location, ':', -1) AS INT) AS BIGINT) AS a, CAST(end_line AS BIGINT) AS b
  FROM n WHERE snapshot = (SELECT max(snapshot) FROM snapshots) AND end_line IS NOT NULL AND try_cast(split_part(n.location, ':', -1) AS INT) IS NOT NULL),
spans AS (SELECT DISTINCT file, CASE WHEN file LIKE '%.go' THEN a ELSE b END AS "first", b AS "last" FROM lasts WHERE file NOT LIKE '%.go' OR b >= a)
"""

SQL = {
    "python_nodes": _LISTED
    + """SELECT id, CASE word WHEN 'class' THEN 'Class' ELSE 'Function' END AS kind, name, path || ':' || no AS location,
  CASE word WHEN 'def' THEN CAST(len(string_split(params, ',')) AS INT) END AS arity, word = 'def' AND body IS NULL AS is_stub FROM named""",
    "python_bases": _LISTED
    + """SELECT c.id AS src, c.params AS base, CAST(c.no AS INT) AS line, count(DISTINCT b.id) AS n_candidates
FROM named c LEFT JOIN named b ON b.name = c.params AND b.id <> c.id WHERE c.word = 'class' GROUP BY ALL""",
    "unused_params": _LISTED
    + r""", args AS (
  SELECT id, trim(split_part(unnest(string_split(params, ',')), '=', 1)) AS parameter,
    regexp_replace(regexp_replace(regexp_replace(body, 'f"[^"{]*\{(\w+)\}[^"]*"', ' \1 ', 'g'), '"[^"]*"', '', 'g'), 'for \w+ in', '', 'g') AS body
  FROM named WHERE word = 'def' AND body IS NOT NULL)
SELECT id, parameter FROM args WHERE NOT regexp_matches(body, '(^|[^\w.])' || parameter || '([^\w=]|$)') AND NOT starts_with(parameter, '_')""",
    "line_coverage": GRAPH + _RAN + """SELECT file, "first", "last" FROM spans""",
    "runtime_nodes": GRAPH
    + _RAN
    + """SELECT DISTINCT x.snapshot, x.id FROM (
  SELECT snapshot, id, file, end_line, try_cast(split_part(location, ':', -1) AS INT) AS start FROM n WHERE end_line IS NOT NULL) x
JOIN spans s ON s.file = x.file AND s."first" <= x.end_line AND s."last" >= CASE WHEN x.start = x.end_line THEN x.start ELSE x.start + 1 END
WHERE x.start IS NOT NULL""",
}

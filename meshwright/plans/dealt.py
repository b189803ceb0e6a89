"""Queries of the dealt problems that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import forest, orphans, snapdiff, treeagg
from meshwright.tables import NODE_FIELDS, periods, relation_key, table

#: Share of all rows from which on a value counts as heavy.
HEAVY_SHARE = "0.01"


def _inherits(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").where(F.col("dst_id").isNotNull())
    return edges.where(relation_key() == "INHERITS").select("snapshot", "src", "dst_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = forest.hierarchy(_inherits(spark, d), "snapshot", "src", "dst_id")
    return found.nodes.select("snapshot", "id", "root_id", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = forest.hierarchy(_inherits(spark, d), "snapshot", "src", "dst_id", paths=True).nodes
    return nodes.select("snapshot", "id", "root_id", "depth", F.array_join("path", " > ").alias("path"), (F.col("depth") < 0).alias("is_circular"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes = forest.hierarchy(_inherits(spark, d), "snapshot", "src", "dst_id", paths=True).nodes
    return forest.descendants(nodes, "snapshot")


def p1_circular_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that ``p1_descendants`` has not: subclasses whose bases lead round in a circle."""
    found = forest.hierarchy(_inherits(spark, d), "snapshot", "src", "dst_id")
    return forest.circular_descendants(found, "snapshot", "src", "dst_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").select("src", "dst_id")
    return treeagg.heavy_keys(edges, ["dst_id", "src"], HEAVY_SHARE).select("field", "node_id")


def p2_degrees(spark: SparkSession, d: str) -> DataFrame:
    return treeagg.degrees(table(spark, d, "edges"))


def _node_changes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    return snapdiff.record_changes(nodes, "snapshot", ["id"], [*NODE_FIELDS, "roles"], periods(spark, d), version="ingested_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges").select("snapshot", F.col("src").alias("id"), relation_key().alias("relation"), "dst_symbol", "dst_id")
    refs = snapdiff.set_changes(edges, "snapshot", ["id", "relation", "dst_symbol"], ["dst_id"], periods(spark, d))
    columns = ("tbl", "snapshot", "id", "relation", "dst_symbol", "change")
    nodes = _node_changes(spark, d).select(F.lit("nodes").alias("tbl"), "snapshot", "id", F.lit("").alias("relation"), F.lit("").alias("dst_symbol"), "change")
    return nodes.unionByName(refs.select(F.lit("edges").alias("tbl"), *columns[1:]))


def p3_node_fields(spark: SparkSession, d: str) -> DataFrame:
    return _node_changes(spark, d).select("snapshot", "id", "change", F.coalesce(F.array_join("fields", ","), F.lit("")).alias("fields"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes, shared, edges = (table(spark, d, t) for t in ("nodes", "shared_nodes", "edges"))
    spaces = {"id": F.col("id"), "name": F.col("name")}

    def parents_of(period: int) -> DataFrame:
        return orphans.parent_keys([(nodes.where(F.col("snapshot") == period), spaces), (shared, spaces)])

    def references_of(period: int) -> DataFrame:
        symbol = F.when(F.col("dst_id").isNull(), F.col("dst_symbol"))
        fields = [("src", "id", F.col("src")), ("dst_id", "id", F.col("dst_id")), ("dst_symbol", "name", symbol)]
        return orphans.reference_keys(edges.where(F.col("snapshot") == period), "seq", fields)

    return orphans.orphans(parents_of, references_of, periods(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = _orphans(spark, d)
    return found.select(F.col("period").cast("int").alias("snapshot"), F.col("row_id").alias("seq"), "field", "state")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.period_report(_orphans(spark, d), "edges").select("tbl", F.col("period").cast("int").alias("snapshot"), "field", "state", "n_references", "n_keys")


QUERIES = {
    "p1_found": p1_found,
    "p1_paths": p1_paths,
    "p1_descendants": p1_descendants,
    "p1_circular_descendants": p1_circular_descendants,
    "p2_found": p2_found,
    "p2_degrees": p2_degrees,
    "p3_found": p3_found,
    "p3_node_fields": p3_node_fields,
    "p5_found": p5_found,
    "p5_report": p5_report,
}

_LINKS = """
WITH RECURSIVE links AS (
  SELECT snapshot, src, min(dst_id) AS dst FROM edges
  WHERE upper(trim(relation)) = 'INHERITS' AND dst_id IS NOT NULL AND src IS NOT NULL AND snapshot IS NOT NULL GROUP BY 1, 2),
ids AS (SELECT snapshot, src AS id FROM links UNION SELECT snapshot, dst FROM links),
up AS (
  SELECT snapshot, id, id AS spot, 0 AS depth, [id] AS way FROM ids
  UNION ALL
  SELECT u.snapshot, u.id, l.dst, u.depth + 1, list_append(u.way, l.dst) FROM up u JOIN links l ON l.snapshot = u.snapshot AND l.src = u.spot
  WHERE NOT list_contains(u.way[:-2], u.spot)),
ends AS (SELECT u.* FROM up u LEFT JOIN links l ON l.snapshot = u.snapshot AND l.src = u.spot WHERE l.src IS NULL),
rings AS (SELECT u.* FROM up u WHERE list_contains(u.way[:-2], u.spot)),
found AS (
  SELECT snapshot, id, spot AS root_id, depth, way FROM ends
  UNION ALL
  SELECT snapshot, id, list_min(way[list_position(way, spot):]) AS root_id, -1, NULL FROM rings)
"""

_DEAD = """
WITH parents AS (
  SELECT DISTINCT snapshot, 'id' AS space, id AS k FROM nodes WHERE id IS NOT NULL
  UNION SELECT DISTINCT snapshot, 'name', name FROM nodes WHERE name IS NOT NULL),
shared AS (SELECT 'id' AS space, id AS k FROM shared_nodes UNION SELECT 'name', name FROM shared_nodes),
refs AS (
  SELECT snapshot, seq, 'src' AS field, 'id' AS space, src AS k FROM edges WHERE src IS NOT NULL
  UNION ALL SELECT snapshot, seq, 'dst_id', 'id', dst_id FROM edges WHERE dst_id IS NOT NULL
  UNION ALL SELECT snapshot, seq, 'dst_symbol', 'name', dst_symbol FROM edges WHERE dst_id IS NULL AND dst_symbol IS NOT NULL),
orphan AS (
  SELECT r.* FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.snapshot = r.snapshot AND p.space = r.space AND p.k = r.k)
    AND NOT EXISTS (SELECT 1 FROM shared s WHERE s.space = r.space AND s.k = r.k)),
span AS (SELECT space, k, min(snapshot) AS first_seen FROM parents GROUP BY 1, 2),
found AS (
  SELECT o.*, CASE WHEN s.first_seen < o.snapshot THEN 'deleted' WHEN s.first_seen > o.snapshot THEN 'later' ELSE 'never' END AS state
  FROM orphan o LEFT JOIN span s ON s.space = o.space AND s.k = o.k)
"""

_NODE_CHANGES = """
WITH picked AS (
  SELECT snapshot, id, kind, name, location, end_line, is_stub, arity, summary, list_sort(list_distinct(roles)) AS roles
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, id ORDER BY ingested_at DESC NULLS LAST, kind DESC NULLS LAST, name DESC NULLS LAST,
    location DESC NULLS LAST, end_line DESC NULLS LAST, is_stub DESC NULLS LAST, arity DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1),
pairs AS (SELECT a.snapshot AS s0, b.snapshot AS s1 FROM snapshots a JOIN snapshots b ON b.snapshot = a.snapshot + 1),
node_changes AS (
  SELECT s1 AS snapshot, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
    concat_ws(',', CASE WHEN n.kind IS DISTINCT FROM o.kind THEN 'kind' END, CASE WHEN n.name IS DISTINCT FROM o.name THEN 'name' END,
      CASE WHEN n.location IS DISTINCT FROM o.location THEN 'location' END, CASE WHEN n.end_line IS DISTINCT FROM o.end_line THEN 'end_line' END,
      CASE WHEN n.is_stub IS DISTINCT FROM o.is_stub THEN 'is_stub' END, CASE WHEN n.arity IS DISTINCT FROM o.arity THEN 'arity' END,
      CASE WHEN n.summary IS DISTINCT FROM o.summary THEN 'summary' END, CASE WHEN n.roles IS DISTINCT FROM o.roles THEN 'roles' END) AS differ
  FROM (SELECT p.s0, p.s1, x.* FROM pairs p JOIN picked x ON x.snapshot = p.s1) n
  FULL OUTER JOIN (SELECT p.s0, p.s1, x.* FROM pairs p JOIN picked x ON x.snapshot = p.s0) o USING (s0, s1, id)
  WHERE n.id IS NULL OR o.id IS NULL OR (n.kind, n.name, n.location, n.end_line, n.is_stub, n.arity, n.summary, n.roles)
    IS DISTINCT FROM (o.kind, o.name, o.location, o.end_line, o.is_stub, o.arity, o.summary, o.roles))
"""

SQL = {
    "p1_found": _LINKS + "SELECT snapshot, id, root_id, CAST(depth AS INTEGER) AS depth FROM found",
    "p1_paths": _LINKS
    + "SELECT snapshot, id, root_id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth >= 0 THEN array_to_string(way[2:], ' > ') END AS path, depth < 0 AS is_circular FROM found",
    "p1_descendants": _LINKS
    + """SELECT snapshot, way[i + 1] AS id, id AS descendant_id, CAST(i AS INTEGER) AS distance
FROM (SELECT snapshot, id, way, unnest(range(1, len(way))) AS i FROM found WHERE depth > 0)""",
    "p1_circular_descendants": _LINKS
    + """SELECT snapshot, way[i + 1] AS id, id AS descendant_id, CAST(i AS INTEGER) AS distance, spot = id AS on_circle
FROM (SELECT snapshot, id, spot, way, unnest(range(1, len(way) - 1)) AS i FROM rings)""",
    "p2_found": """
SELECT field, node_id FROM (
  SELECT 'dst_id' AS field, dst_id AS node_id, count(*) AS n FROM edges WHERE dst_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'src', src, count(*) FROM edges WHERE src IS NOT NULL GROUP BY 2)
WHERE n * 100 >= (SELECT count(*) FROM edges)""",
    "p2_degrees": """
SELECT node_id, CAST(sum(n_in) AS BIGINT) AS n_in, CAST(sum(n_out) AS BIGINT) AS n_out, CAST(sum(n_callers) AS BIGINT) AS n_callers, CAST(sum(n_callees) AS BIGINT) AS n_callees FROM (
  SELECT dst_id AS node_id, count(*) AS n_in, 0 AS n_out, count(DISTINCT src) AS n_callers, 0 AS n_callees FROM edges WHERE dst_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT src, 0, count(*), 0, count(DISTINCT dst_id) FROM edges WHERE src IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "p3_found": _NODE_CHANGES
    + """, keyed AS (SELECT DISTINCT snapshot, src AS id, upper(trim(relation)) AS relation, dst_symbol, dst_id FROM edges),
sets AS (SELECT snapshot, id, relation, dst_symbol, list_sort(list(dst_id)) AS m FROM keyed GROUP BY 1, 2, 3, 4),
edge_changes AS (
  SELECT s1 AS snapshot, id, relation, dst_symbol, CASE WHEN o.m IS NULL THEN 'added' WHEN n.m IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM (SELECT p.s1, x.* FROM pairs p JOIN sets x ON x.snapshot = p.s1) n
  FULL OUTER JOIN (SELECT p.s1, x.* FROM pairs p JOIN sets x ON x.snapshot = p.s0) o USING (s1, id, relation, dst_symbol)
  WHERE n.m IS DISTINCT FROM o.m)
SELECT 'nodes' AS tbl, snapshot, id, '' AS relation, '' AS dst_symbol, change FROM node_changes
UNION ALL SELECT 'edges', snapshot, id, relation, dst_symbol, change FROM edge_changes""",
    "p3_node_fields": _NODE_CHANGES + "SELECT snapshot, id, change, CASE WHEN change = 'changed' THEN differ ELSE '' END AS fields FROM node_changes",
    "p5_found": _DEAD + "SELECT snapshot, seq, field, state FROM found",
    "p5_report": _DEAD
    + "SELECT 'edges' AS tbl, snapshot, field, state, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM found GROUP BY snapshot, field, state",
}

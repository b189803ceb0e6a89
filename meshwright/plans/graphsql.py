"""SQL of the cleaned graph, shared by the queries on it."""

KINDS = "('File','Module','Package','Class','Function','Method','Variable','Route','Endpoint','Handler','Template','HTMLElement','ORMModel','DBTable','DBColumn','Query','Test','Event')"
RELATIONS = "('CALLS','IMPORTS','INHERITS','READS','WRITES','QUERIES','ROUTES_TO','RENDERS','SUBMITS_TO','MAPS_TO','RETURNS','REFERENCES','TESTS','EMITS','HANDLES','RUNTIME_HITS')"
LIVENESS = "('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES')"
TEST_PATH = "(starts_with(split_part(lower(split_part({0}, '::', 1)), '/', -1), 'test') OR regexp_matches(lower(split_part({0}, '::', 1)), '/test|test_|_test|/spec|\\.spec\\.|\\.test\\.'))"


def test_path(column: str) -> str:
    return TEST_PATH.format(column)


GRAPH = f"""
WITH RECURSIVE raw_n AS (
  SELECT snapshot, id, kind, name, location, end_line, is_stub, arity, summary, list_sort(list_distinct(roles)) AS roles
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot, id ORDER BY ingested_at DESC NULLS LAST, kind DESC NULLS LAST, name DESC NULLS LAST,
    location DESC NULLS LAST, end_line DESC NULLS LAST, is_stub DESC NULLS LAST, arity DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1
  UNION ALL
  SELECT s.snapshot, h.id, h.kind, h.name, h.location, NULL, NULL, NULL, NULL, list_sort(list_distinct(h.roles)) FROM shared_nodes h, snapshots s),
n AS (
  SELECT snapshot, id, kind, name, location, end_line, coalesce(is_stub, false) AS is_stub, arity, summary, roles, split_part(id, '::', 1) AS file,
    kind = 'Test' OR list_contains(roles, 'test') OR {test_path('id')} AS is_test
  FROM raw_n WHERE id IS NOT NULL AND name IS NOT NULL AND kind IN {KINDS}),
raw_e AS (
  SELECT snapshot, seq, src, upper(trim(relation)) AS relation, dst_symbol, dst_id, CASE WHEN isfinite(weight) THEN weight ELSE 1.0 END AS weight,
    CASE WHEN provenance IN ('extracted', 'inferred', 'ambiguous') THEN provenance ELSE 'ambiguous' END AS provenance, source, coalesce(name_based, false) AS name_based
  FROM edges WHERE upper(trim(relation)) IN {RELATIONS} AND src IS NOT NULL AND dst_symbol IS NOT NULL),
one_e AS (
  SELECT * EXCLUDE (rn, name_based), any_based AS name_based FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot, src, relation, dst_id ORDER BY weight DESC, seq) AS rn,
      bool_or(name_based) OVER (PARTITION BY snapshot, src, relation, dst_id) AS any_based FROM raw_e WHERE dst_id IS NOT NULL) WHERE rn = 1),
e AS (
  SELECT * FROM one_e x WHERE relation <> 'REFERENCES'
    OR (src <> dst_id AND NOT EXISTS (SELECT 1 FROM one_e c WHERE c.relation = 'CALLS' AND c.snapshot = x.snapshot AND c.src = x.src AND c.dst_id = x.dst_id))),
h AS (SELECT snapshot, src, relation, dst_symbol, bool_or(name_based) AS name_based, min(seq) AS seq FROM raw_e WHERE dst_id IS NULL GROUP BY 1, 2, 3, 4),
live AS (
  SELECT e.* FROM e WHERE relation IN {LIVENESS}
    AND EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.src) AND EXISTS (SELECT 1 FROM n WHERE n.snapshot = e.snapshot AND n.id = e.dst_id))
"""

ROOTS = """
, own AS (
  SELECT snapshot, id, file FROM n WHERE kind IN ('Route', 'Endpoint', 'Template')
    OR list_has_any(roles, ['exported', 'main', 'script', 'route', 'runtime', 'callback', 'test'])),
root_files AS (SELECT DISTINCT snapshot, file FROM own),
root_dirs AS (SELECT DISTINCT snapshot, regexp_replace(file, '/?[^/]*$', '') AS dir FROM root_files WHERE file LIKE '%.go'),
roots AS (
  SELECT snapshot, id FROM own
  UNION SELECT n.snapshot, n.id FROM n JOIN root_files USING (snapshot, file)
    WHERE n.kind = 'Module' OR n.id = n.file || '::' || regexp_replace(split_part(n.file, '/', -1), '(.)\\.[^.]*$', '\\1')
  UNION SELECT n.snapshot, n.id FROM n JOIN root_dirs d ON d.snapshot = n.snapshot AND d.dir = regexp_replace(n.file, '/?[^/]*$', '') WHERE n.kind = 'Module' AND n.file LIKE '%.go')
, reached AS (SELECT snapshot, id FROM roots UNION SELECT l.snapshot, l.dst_id FROM reached r JOIN live l ON l.snapshot = r.snapshot AND l.src = r.id)
"""

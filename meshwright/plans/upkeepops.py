"""Operations that keep the graph: binding, widening, overrides, compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.ids import LANGUAGE_OF
from meshwright.operators import maintain
from meshwright.operators.graph import load_graph
from meshwright.plans.graphsql import GRAPH


def _with_graph(op):
    return lambda spark, d: op(load_graph(spark, d))


def edge_groups(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, src, relation, dst_symbol, weight, n_members) of the compressed fan-outs."""
    packed = maintain.compress(load_graph(spark, d).edges)
    sizes = packed.sets.select("set_id", F.size("members").alias("n_members"))
    return packed.groups.join(sizes, "set_id").select("snapshot", "src", "relation", "dst_symbol", "weight", "n_members")


def expanded_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges again after they were compressed and expanded."""
    return maintain.expand(maintain.compress(load_graph(spark, d).edges)).select("snapshot", "src", "relation", "dst_symbol", "dst_id", "weight", "provenance", "name_based")


QUERIES = {
    "resolve_holes": _with_graph(maintain.resolve_holes),
    "redundant_holes": _with_graph(maintain.redundant_holes),
    "dangling_edges": _with_graph(maintain.dangling),
    "rewiden": _with_graph(maintain.rewiden),
    "override_edges": _with_graph(maintain.override_edges),
    "circular_override_edges": _with_graph(lambda g: maintain.override_edges(g, circular=True)),
    "edge_groups": edge_groups,
    "expanded_edges": expanded_edges,
}


def _lang(column: str) -> str:
    ext = f"lower(split_part(split_part({column}, '::', 1), '.', -1))"
    arms = " ".join(f"WHEN {ext} IN ({', '.join(repr(e) for e, lang in LANGUAGE_OF.items() if lang == name)}) THEN '{name}'" for name in dict.fromkeys(LANGUAGE_OF.values()))
    return f"CASE {arms} END"


def _candidates(refs: str) -> str:
    return f"""cand AS (SELECT r.snapshot, r.src, r.relation, r.dst_symbol, n.id AS dst_id, count(*) OVER (PARTITION BY r.snapshot, r.src, r.relation, r.dst_symbol) AS k FROM ({refs}) r
  JOIN n ON n.snapshot = r.snapshot AND n.name = r.dst_symbol AND (n.kind <> 'Module' OR r.relation = 'IMPORTS')
    AND coalesce({_lang('n.id')}, {_lang('r.src')}, '') = coalesce({_lang('r.src')}, {_lang('n.id')}, ''))"""


SQL = {
    "resolve_holes": GRAPH
    + ", "
    + _candidates("SELECT * FROM h")
    + " SELECT snapshot, src, relation, dst_symbol, dst_id, round(1.0 / k, 3)::DOUBLE AS weight, CASE WHEN k > 1 THEN 'ambiguous' ELSE 'inferred' END AS provenance FROM cand",
    "redundant_holes": GRAPH
    + """SELECT snapshot, src, relation, dst_symbol, name_based FROM h
WHERE EXISTS (SELECT 1 FROM e WHERE e.snapshot = h.snapshot AND e.src = h.src AND e.relation = h.relation AND e.dst_symbol = h.dst_symbol AND e.name_based = h.name_based)""",
    "dangling_edges": GRAPH
    + """SELECT e.snapshot, e.src, e.relation, e.dst_symbol, e.dst_id FROM e LEFT JOIN n ON n.snapshot = e.snapshot AND n.id = e.dst_id
WHERE e.name_based AND (n.id IS NULL OR (n.kind = 'Module' AND e.relation <> 'IMPORTS'))""",
    "rewiden": GRAPH
    + ", grp AS (SELECT snapshot, src, relation, dst_symbol, list_sort(list(dst_id)) AS now, count(*) AS k, bool_or(provenance = 'ambiguous') AS any_guess, bool_and(provenance = 'ambiguous') AS all_guess, min(weight) AS w0, max(weight) AS w1 FROM e WHERE name_based GROUP BY 1, 2, 3, 4), "
    + _candidates("SELECT * FROM grp")
    + """, want AS (SELECT snapshot, src, relation, dst_symbol, list_sort(list(dst_id)) AS ids, max(k) AS n FROM cand GROUP BY 1, 2, 3, 4)
SELECT c.snapshot, c.src, c.relation, c.dst_symbol, c.dst_id, round(1.0 / c.k, 3)::DOUBLE AS weight, CASE WHEN c.k > 1 THEN 'ambiguous' ELSE 'inferred' END AS provenance
FROM cand c JOIN want w USING (snapshot, src, relation, dst_symbol) JOIN grp g USING (snapshot, src, relation, dst_symbol)
WHERE NOT CASE WHEN w.n > 1 THEN w.ids = g.now AND g.all_guess AND g.w0 = round(1.0 / w.n, 3)::DOUBLE AND g.w1 = round(1.0 / w.n, 3)::DOUBLE ELSE g.k = 1 AND NOT g.any_guess END""",
    "override_edges": GRAPH
    + """, links AS (SELECT e.snapshot, e.src, min(e.dst_id) AS dst FROM e JOIN n a ON a.snapshot = e.snapshot AND a.id = e.src AND a.kind = 'Class' JOIN n b ON b.snapshot = e.snapshot AND b.id = e.dst_id AND b.kind = 'Class'
  WHERE e.relation = 'INHERITS' AND e.src <> e.dst_id GROUP BY 1, 2),
up AS (SELECT snapshot, src AS id, dst AS base, 1 AS d FROM links UNION ALL SELECT u.snapshot, u.id, l.dst, u.d + 1 FROM up u JOIN links l ON l.snapshot = u.snapshot AND l.src = u.base WHERE u.d < 100),
good AS (SELECT u.snapshot, u.id, u.base FROM up u WHERE (u.snapshot, u.id) NOT IN (SELECT (snapshot, id) FROM up WHERE d = 100)),
uses AS (SELECT snapshot, src, relation, dst_id FROM e WHERE relation IN ('CALLS', 'REFERENCES'))
SELECT DISTINCT u.snapshot, u.src, u.relation, split_part(u.dst_id, '.', -1) AS dst_symbol, g.id || '.' || split_part(u.dst_id, '.', -1) AS dst_id FROM uses u
JOIN good g ON g.snapshot = u.snapshot AND strpos(substr(u.dst_id, strpos(u.dst_id, '::')), '.') > 0 AND g.base = regexp_replace(u.dst_id, '\\.[^.]*$', '')
WHERE EXISTS (SELECT 1 FROM n WHERE n.snapshot = u.snapshot AND n.id = g.id || '.' || split_part(u.dst_id, '.', -1))
  AND NOT EXISTS (SELECT 1 FROM uses x WHERE x.snapshot = u.snapshot AND x.src = u.src AND x.relation = u.relation AND x.dst_id = g.id || '.' || split_part(u.dst_id, '.', -1))""",
    "circular_override_edges": GRAPH
    + """, links AS (SELECT e.snapshot, e.src, min(e.dst_id) AS dst FROM e JOIN n a ON a.snapshot = e.snapshot AND a.id = e.src AND a.kind = 'Class' JOIN n b ON b.snapshot = e.snapshot AND b.id = e.dst_id AND b.kind = 'Class'
  WHERE e.relation = 'INHERITS' AND e.src <> e.dst_id GROUP BY 1, 2),
up AS (SELECT snapshot, src AS id, dst AS spot, [src, dst] AS way FROM links
  UNION ALL SELECT u.snapshot, u.id, l.dst, list_append(u.way, l.dst) FROM up u JOIN links l ON l.snapshot = u.snapshot AND l.src = u.spot WHERE NOT list_contains(u.way[:-2], u.spot)),
below AS (SELECT snapshot, id, unnest(way[2:-2]) AS base FROM up WHERE list_contains(way[:-2], spot)),
uses AS (SELECT snapshot, src, relation, dst_id FROM e WHERE relation IN ('CALLS', 'REFERENCES'))
SELECT DISTINCT u.snapshot, u.src, u.relation, split_part(u.dst_id, '.', -1) AS dst_symbol, b.id || '.' || split_part(u.dst_id, '.', -1) AS dst_id FROM uses u
JOIN below b ON b.snapshot = u.snapshot AND strpos(substr(u.dst_id, strpos(u.dst_id, '::')), '.') > 0 AND b.base = regexp_replace(u.dst_id, '\\.[^.]*$', '')
WHERE EXISTS (SELECT 1 FROM n WHERE n.snapshot = u.snapshot AND n.id = b.id || '.' || split_part(u.dst_id, '.', -1))
  AND NOT EXISTS (SELECT 1 FROM uses x WHERE x.snapshot = u.snapshot AND x.src = u.src AND x.relation = u.relation AND x.dst_id = b.id || '.' || split_part(u.dst_id, '.', -1))""",
    "edge_groups": GRAPH
    + """SELECT snapshot, src, relation, dst_symbol, min(weight) AS weight, CAST(count(*) AS INTEGER) AS n_members FROM e GROUP BY 1, 2, 3, 4
HAVING count(*) >= 2 AND bool_and(provenance = 'ambiguous') AND count(DISTINCT weight) = 1 AND count(source) = count(*) AND count(DISTINCT source) = 1 AND count(DISTINCT name_based) = 1""",
    "expanded_edges": GRAPH + "SELECT snapshot, src, relation, dst_symbol, dst_id, weight, provenance, name_based FROM e",
}

"""Queries of the dealt problems on training data, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.llm import chunking, cooccur, mixing, packing, setjoin
from meshwright.llm.tokens import SQL_TOKEN, token_count
from meshwright.runtime import Workspace
from meshwright.tables import table

SIMILARITY, MIN_FUNCTIONS = "0.8", 5
MIN_TOGETHER, MIN_LIFT = 5, 3


def _test_functions(spark: SparkSession, d: str) -> DataFrame:
    """(test_id, function_id) of all artifacts; null and repeated elements are left as they are."""
    entries = table(spark, d, "coverage").select(F.explode("tests").alias("test_id", "functions"))
    return entries.select("test_id", F.explode("functions").alias("function_id"))


def _n_tests(spark: SparkSession, d: str) -> int:
    return table(spark, d, "coverage").select(F.explode(F.map_keys("tests")).alias("test_id")).distinct().count()


def _similar_tests(spark: SparkSession, d: str) -> setjoin.SimilarSets:
    return setjoin.similar_sets(_test_functions(spark, d), "test_id", "function_id", SIMILARITY, min_items=MIN_FUNCTIONS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.record_pairs(_similar_tests(spark, d))
    return pairs.select(F.col("a").alias("test_a"), F.col("b").alias("test_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.record_classes(_similar_tests(spark, d)).withColumnRenamed("record", "test_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _test_functions(spark, d)
    return cooccur.cooccurrence(rows, "test_id", "function_id", _n_tests(spark, d), min_together=MIN_TOGETHER, min_lift=MIN_LIFT)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select(F.col("item_a").alias("function_a"), F.col("item_b").alias("function_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    named = [F.col("item_a").alias("function_a"), F.col("item_b").alias("function_b"), "n_ab", "n_a", "n_b"]
    return _pairs(spark, d).select(*named, F.round("lift", 4).alias("lift"))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return packing.pack_items(sized, "doc_id", F.col("tokens"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed = _containers(spark, d)
    return packed.select("container_id", F.col("id").cast("long").alias("doc_id"), "piece", F.col("size").alias("tokens"), "start")


def p7_assigned(spark: SparkSession, d: str) -> DataFrame:
    packed = _containers(spark, d).groupBy(F.col("id").cast("long").alias("doc_id"))
    return packed.agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n_pieces"))


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    """What was packed, and what must not be: containers over capacity, items split that need not
    be, texts whose pieces do not make up the text. ``near_bound``: at most one container in two
    hundred, and one per part packed apart, more than the tokens would fill."""
    packed = table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    rows = Workspace(spark, "packed").write(packing.pack_items(packed, "doc_id", F.col("tokens")), "rows")
    bins = rows.groupBy("container_id").agg(F.sum("size").alias("load"))
    cap = F.lit(packing.CAPACITY)
    loads = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum(F.when(F.col("load") > cap, 1).otherwise(0)), F.lit(0)).alias("over_full"))
    whole = rows.groupBy("id").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("pieces"))
    asked = packed.groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.sum("tokens").alias("tokens"), F.sum(F.greatest(F.ceil(F.col("tokens") / cap), F.lit(1))).alias("least"))
    both = asked.join(whole, "id", "full")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    sums = both.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        one(~F.col("load").eqNullSafe(F.col("tokens"))).alias("not_whole"),
        one(~F.col("pieces").eqNullSafe(F.col("least"))).alias("split_in_vain"),
    )
    bound = F.ceil(F.col("tokens") / cap)
    parts = F.ceil(F.col("pieces") / (8 * packing.BATCH))
    near = F.col("containers") <= bound + F.ceil(bound / 200) + parts
    return sums.crossJoin(loads).select("tokens", "pieces", "over_full", "not_whole", "split_in_vain", near.alias("near_bound"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Share], int]:
    """Documents with source and size, what each source of ``mix_targets`` is to give, all tokens."""
    ws = Workspace(spark, "sized")
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), token_count(F.col("text")).alias("tokens"))
    sized = ws.write(docs.where(F.col("source").isNotNull()), "documents")
    targets = [(r.source, r.target_share, r.max_repeats) for r in table(spark, d, "mix_targets").orderBy("source").collect()]
    by_source = mixing.source_sizes(sized, "source", "tokens")
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    asked = by_source.where(F.col("source").isin([s for s, _, _ in targets])).collect()
    return sized, mixing.plan_mixture(targets, {r["source"]: (r["n"], r["tokens"]) for r in asked}, total, fill=True), total


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the sources frozen on the way to the target those whose limit is below their own share."""
    _, plan, _ = _mixture(spark, d)
    return spark.createDataFrame([(x.source,) for x in plan if x.frozen and x.capped], "source string")


def _used(sized: DataFrame, plan: list[mixing.Share]) -> DataFrame:
    return mixing.realise(sized, "doc_id", "source", "tokens", [(x.source, x.tokens, x.budget, x.max_repeats) for x in plan])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sized, plan, _ = _mixture(spark, d)
    return _used(sized, plan).select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), "repeats")


def _reached(sized: DataFrame, plan: list[mixing.Share]) -> DataFrame:
    size, times = F.col("size"), F.col("repeats")
    used = _used(sized, plan).groupBy("source").agg(F.sum(size * times).alias("used"), F.max("repeats").alias("most_repeats"), F.max("size").alias("largest"))
    asked = sized.sparkSession.createDataFrame(
        [(x.source, x.target_share, x.max_repeats, x.tokens, x.frozen, x.exponent, round(x.weight, 6), x.budget) for x in plan],
        "source string, target_share double, max_repeats int, tokens long, frozen boolean, exponent double, weight double, budget long",
    )
    return asked.join(F.broadcast(used), "source", "left").fillna(0, ["used", "most_repeats", "largest"])


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked, planned and reached: of all tokens, and of what the mixture really holds."""
    sized, plan, total = _mixture(spark, d)
    both = _reached(sized, plan).drop("largest")
    all_used = F.sum("used").over(Window.partitionBy(F.lit(1)))  # one row per source of the target
    return both.withColumn("share_of_total", F.col("used") / F.lit(float(total or 1))).withColumn("share_of_mixture", F.col("used") / F.greatest(all_used, F.lit(1)))


def p8_budgets(spark: SparkSession, d: str) -> DataFrame:
    """The plan, and whether what is used keeps it: within the limit of repeats, and short of the
    budget by less than one record of the source at most."""
    sized, plan, _ = _mixture(spark, d)
    size = sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    both = _reached(sized, plan).join(size, "source", "left")
    short = F.col("budget") - F.col("used")
    kept = (F.col("most_repeats") <= F.coalesce("max_repeats", "most_repeats")) & (short >= 0) & (short < F.greatest(F.coalesce("longest", F.lit(0)), F.lit(1)))
    return both.select("source", "target_share", "max_repeats", "tokens", "frozen", "budget", "weight", kept.alias("kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = chunking.split_items(table(spark, d, "documents"), "doc_id", "text", texts=False)
    return pieces.where("piece = 1").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_items(table(spark, d, "documents"), "doc_id", "text")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per text that is split: whether its pieces keep the limit, repeat what they should, leave no
    gap, and whether there are at most half as many again as the least number."""
    pieces = chunking.split_items(table(spark, d, "documents"), "doc_id", "text", texts=False).groupBy("doc_id")
    own = F.col("end_token") - F.col("own_token")
    again = (F.col("piece") == 0) | (F.col("own_token") - F.col("start_token") == chunking.OVERLAP)
    sums = pieces.agg(F.sum(own).alias("tokens"), F.max("n_tokens").alias("most"), F.bool_and(again).alias("repeats"), F.count(F.lit(1)).alias("n"), F.max("end_token").alias("upto"), F.max("n_pieces").alias("told"))
    least = F.ceil((F.col("tokens") - chunking.OVERLAP) / (chunking.LIMIT - chunking.OVERLAP))
    whole = (F.col("upto") == F.col("tokens")) & (F.col("n") == F.col("told"))
    return sums.select("doc_id", "tokens", (F.col("most") <= chunking.LIMIT).alias("within"), "repeats", whole.alias("whole"), (F.col("n") * 2 <= least * 3 + 1).alias("few"))


QUERIES = {
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_containers": p7_containers,
    "p7_assigned": p7_assigned,
    "p7_summary": p7_summary,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_budgets": p8_budgets,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
    "p9_kept": p9_kept,
}

_RUNS = """
WITH cells AS (SELECT unnest(map_entries(tests)) AS e FROM coverage),
keys AS (SELECT DISTINCT e.key AS t FROM cells),
runs AS (SELECT DISTINCT t, f FROM (SELECT e.key AS t, unnest(e.value) AS f FROM cells) WHERE f IS NOT NULL),
sizes AS (SELECT t, count(*) AS n FROM runs GROUP BY t HAVING count(*) >= 5),
inter AS (SELECT a.t AS a, b.t AS b, count(*) AS i FROM runs a JOIN runs b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2),
found AS (SELECT a, b FROM inter JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE i * 10 >= 8 * (x.n + y.n - i))
"""

_TOGETHER = """
WITH cells AS (SELECT unnest(map_entries(tests)) AS e FROM coverage),
total AS (SELECT count(DISTINCT e.key) AS n FROM cells),
runs AS (SELECT DISTINCT t, f FROM (SELECT e.key AS t, unnest(e.value) AS f FROM cells) WHERE f IS NOT NULL),
one AS (SELECT f, count(*) AS n FROM runs GROUP BY f),
two AS (SELECT a.f AS fa, b.f AS fb, count(*) AS n FROM runs a JOIN runs b ON a.t = b.t AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 5),
found AS (
  SELECT fa AS function_a, fb AS function_b, two.n AS n_ab, x.n AS n_a, y.n AS n_b, total.n AS n
  FROM two JOIN one x ON x.f = fa JOIN one y ON y.f = fb, total WHERE two.n * total.n >= 3 * x.n * y.n)
"""

_COUNT = f"coalesce(len(regexp_extract_all(text, '{SQL_TOKEN}')), 0)"

SQL = {
    "p4_found": _RUNS + "SELECT a AS test_a, b AS test_b FROM found",
    "p4_classes": _RUNS
    + """, sets AS (SELECT t, list_sort(list(f)) AS s FROM runs WHERE t IN (SELECT t FROM sizes) GROUP BY t),
ends AS (SELECT a AS t FROM found UNION ALL SELECT b FROM found)
SELECT t AS test_id, min(t) OVER (PARTITION BY s) AS class_id, (SELECT count(*) FROM ends e WHERE e.t = sets.t) AS n_links FROM sets""",
    "p6_found": _TOGETHER + "SELECT function_a, function_b FROM found",
    "p6_pairs": _TOGETHER + "SELECT function_a, function_b, n_ab, n_a, n_b, round(n_ab * CAST(n AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 4) AS lift FROM found",
    "p7_assigned": f"SELECT doc_id, CAST(sum({_COUNT}) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil({_COUNT} / 2048.0))) AS BIGINT) AS n_pieces FROM documents GROUP BY doc_id",
    "p7_summary": f"""
SELECT CAST(coalesce(sum({_COUNT}), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(greatest(1, ceil({_COUNT} / 2048.0))), 0) AS BIGINT) AS pieces,
  CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS split_in_vain, TRUE AS near_bound FROM documents""",
    "p8_budgets": f"""
WITH sized AS (SELECT lower(trim(source)) AS s, {_COUNT} AS n FROM documents WHERE source IS NOT NULL),
by_source AS (SELECT s, sum(n) AS n FROM sized GROUP BY s),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM by_source),
asked AS (
  SELECT m.source, target_share AS t, max_repeats, CAST(coalesce(b.n, 0) AS BIGINT) AS tokens, max_repeats * coalesce(b.n, 0) AS most,
    row_number() OVER (ORDER BY max_repeats * coalesce(b.n, 0) / target_share, m.source) AS k
  FROM mix_targets m LEFT JOIN by_source b ON b.s = m.source),
steps AS (
  SELECT asked.*, (total.n - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(t) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM asked, total),
level AS (SELECT coalesce(min(k), 1000) AS k FROM steps WHERE most >= scale * t),
scale AS (SELECT steps.scale AS x FROM steps JOIN level USING (k)),
plan AS (
  SELECT source, t, max_repeats, tokens, steps.k < level.k AS frozen,
    CAST(CASE WHEN steps.k < level.k THEN most ELSE round((SELECT x FROM scale) * t) END AS BIGINT) AS budget FROM steps, level)
SELECT source, t AS target_share, max_repeats, tokens, frozen, budget, round(budget / total.n, 6) AS weight, TRUE AS kept FROM plan, total""",
    "p8_found": f"""
WITH sized AS (SELECT lower(trim(source)) AS s, {_COUNT} AS n FROM documents WHERE source IS NOT NULL),
by_source AS (SELECT s, sum(n) AS n FROM sized GROUP BY s)
SELECT m.source FROM mix_targets m LEFT JOIN by_source b ON b.s = m.source
WHERE m.max_repeats * coalesce(b.n, 0) < m.target_share * (SELECT sum(n) FROM by_source)""",
    "p9_kept": f"SELECT doc_id, CAST({_COUNT} AS BIGINT) AS tokens, TRUE AS within, TRUE AS repeats, TRUE AS whole, TRUE AS few FROM documents WHERE {_COUNT} > 512",
    "p9_found": f"SELECT DISTINCT doc_id FROM documents WHERE {_COUNT} > 512",
}

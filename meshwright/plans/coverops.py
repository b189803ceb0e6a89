"""Operations on the coverage matrix, on history and on similarity."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.functions.ids import file_of, is_test_path, leaf_of, qual_of
from meshwright.functions.words import label_words
from meshwright.operators import churn, cover, linalg, similar, sweeps
from meshwright.operators.graph import Graph, is_test_node, load_graph
from meshwright.operators.kernels import LOCAL_ONES
from meshwright.plans.graphops import degrees, live_set
from meshwright.plans.graphsql import GRAPH, ROOTS, test_path
from meshwright.runtime import Workspace
from meshwright.tables import periods, table

#: Parameters of the registered queries.
ANCHOR = "vendor/testkit/case.py::WorldCase.open_world"
CHANGED = "vendor/corekit/base.py::BaseUnit"
PURPOSE = "drain the parcel queue and emit a marker for every stanza in the ledger"
MODES = 8


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cover.runs(table(spark, d, "coverage"))


def _graph_pairs(spark: SparkSession, d: str, graph: Graph) -> DataFrame:
    """(snapshot, test_id, function_id) of the artifacts of each snapshot, ids as in the graph."""
    return cover.reconcile(cover.runs(table(spark, d, "coverage"), by_snapshot=True), graph.nodes)


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """(commit_id, file): a commit message and the files it is recorded for."""
    docs = table(spark, d, "documents").where(F.lower(F.trim("source")) == "commit_message")
    return docs.where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("commit_id"), "file")


def select_tests(spark: SparkSession, d: str, changed: tuple[str, ...] = (CHANGED, ANCHOR)) -> DataFrame:
    """(snapshot, test_id, how): tests that ran what changes, that lead to it, or both."""
    g = load_graph(spark, d)
    ran = _graph_pairs(spark, d, g).where(F.col("function_id").isin(list(changed))).select("snapshot", "test_id").distinct()
    seeds = g.nodes.where(F.col("id").isin(list(changed))).select("snapshot", "id")
    back = sweeps.reach(sweeps.reverse(g.adjacency()), seeds).where("hops > 0")
    tests = g.nodes.where(F.array_contains("roles", "test")).select("snapshot", "id")
    static = back.join(tests, ["snapshot", "id"], "left_semi").select("snapshot", F.col("id").alias("test_id"))
    both = ran.withColumn("r", F.lit(True)).join(static.withColumn("s", F.lit(True)), ["snapshot", "test_id"], "full")
    how = F.when(F.col("r") & F.col("s"), "both").when(F.col("r"), "runtime_only").otherwise("static_only")
    return both.select("snapshot", "test_id", how.alias("how"))


def co_change(spark: SparkSession, d: str, anchor: str = ANCHOR, limit: int = 20) -> DataFrame:
    found = cover.co_functions(_pairs(spark, d), anchor)
    return found.orderBy(F.desc("score"), F.desc("shared"), "function_id").limit(limit)


def audit_graph(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, test_id, executed, hit, reached, recall): what tests ran against what they lead to.

    A test that is a node leads to what the node does; any other to what those functions do that
    it ran though nothing else it ran calls them.
    """
    g = load_graph(spark, d)
    ids = g.nodes.select("snapshot", "id")
    ran = _graph_pairs(spark, d, g).join(ids.withColumnRenamed("id", "function_id"), ["snapshot", "function_id"], "left_semi")
    adj = g.adjacency()
    own = ran.select("snapshot", "test_id").distinct().join(ids.withColumnRenamed("id", "test_id"), ["snapshot", "test_id"], "left_semi")
    calls = adj.where("s <> d").withColumnsRenamed({"s": "function_id"})
    called = ran.join(calls, ["snapshot", "function_id"]).select("snapshot", "test_id", F.col("d").alias("function_id")).distinct()
    entry = ran.join(own, ["snapshot", "test_id"], "left_anti").join(called, ["snapshot", "test_id", "function_id"], "left_anti")
    seeds = own.select("snapshot", "test_id", F.col("test_id").alias("id")).unionByName(entry.select("snapshot", "test_id", F.col("function_id").alias("id")))
    numbered = sweeps.lanes(seeds.withColumn("group", F.concat_ws("\x1f", F.col("snapshot").cast("string"), "test_id")))
    lane = numbered.select("snapshot", "test_id", F.col("number").alias("lane")).distinct()
    asked = ran.join(lane, ["snapshot", "test_id"]).select("snapshot", "lane", F.col("function_id").alias("id"), F.lit(False).alias("seed"))
    started = numbered.select("snapshot", F.col("number").alias("lane"), "id", F.lit(True).alias("seed"))
    counts = sweeps.lane_counts(adj, started.unionByName(asked), by_node=False).withColumnRenamed("n", "reached")
    executed = ran.groupBy("snapshot", "test_id").agg(F.count(F.lit(1)).alias("executed"))
    out = counts.join(lane, ["snapshot", "lane"]).join(executed, ["snapshot", "test_id"])
    return out.select("snapshot", "test_id", "executed", "hit", "reached", F.round(F.col("hit") / F.col("executed"), 3).alias("recall"))


def find_coupling(spark: SparkSession, d: str) -> DataFrame:
    g = load_graph(spark, d)
    found = cover.hidden_coupling(_pairs(spark, d), g.edges)
    return found.withColumn("common_callers", F.array_join("common_callers", ","))


def find_gaps(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, id, state): functions no test ran, live or dead."""
    g = load_graph(spark, d)
    ran = _graph_pairs(spark, d, g).select("snapshot", F.col("function_id").alias("id")).distinct()
    lost = g.nodes.where(F.col("kind").isin("Function", "Method")).select("snapshot", "id").join(ran, ["snapshot", "id"], "left_anti")
    out = lost.join(live_set(g).withColumn("live", F.lit(True)), ["snapshot", "id"], "left")
    return out.select("snapshot", "id", F.when(F.col("live"), "untested_live").otherwise("untested_dead").alias("state"))


def test_order(spark: SparkSession, d: str) -> DataFrame:
    return cover.greedy_order(_pairs(spark, d), cover.all_tests(table(spark, d, "coverage")))


def redundant_tests(spark: SparkSession, d: str) -> DataFrame:
    return cover.redundant_groups(_pairs(spark, d))


def find_core(spark: SparkSession, d: str) -> DataFrame:
    return cover.core_functions(_pairs(spark, d), cover.all_tests(table(spark, d, "coverage")).count())


def coactivation(spark: SparkSession, d: str) -> DataFrame:
    return cover.coactivation(_pairs(spark, d))


def coverage_drift(spark: SparkSession, d: str, old: int = 1, new: int = 4) -> DataFrame:
    runs = cover.runs(table(spark, d, "coverage"), by_snapshot=True)
    return cover.drift(runs.where(F.col("snapshot") == old), runs.where(F.col("snapshot") == new))


# -- history -----------------------------------------------------------------


def _centrality(graph: Graph, *, product_only: bool) -> DataFrame:
    """(file, mass): certain fan-in of the code a file defines, summed over the snapshots."""
    e = degrees(graph).select("snapshot", "id", "confident_fan_in").where("confident_fan_in > 0")
    own = graph.nodes.where(~is_test_node()) if product_only else graph.nodes
    return e.join(own.select("snapshot", "id", "file"), ["snapshot", "id"]).groupBy("file").agg(F.sum("confident_fan_in").cast("double").alias("mass"))


def _behaviour(pairs: DataFrame, *, product_only: bool) -> DataFrame:
    kept = pairs.where(~is_test_path(F.col("function_id"))) if product_only else pairs
    return kept.groupBy(file_of(F.col("function_id")).alias("file")).agg(F.count(F.lit(1)).cast("double").alias("mass"))


def risk(spark: SparkSession, d: str) -> DataFrame:
    return churn.hotspots(churn.churn(_commits(spark, d)), _centrality(load_graph(spark, d), product_only=False))


def runtime_risk(spark: SparkSession, d: str) -> DataFrame:
    return churn.hotspots(churn.churn(_commits(spark, d)), _behaviour(_pairs(spark, d), product_only=False))


def cochange_orders(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, together): suppliers that stand in the same orders, an order taken as a commit."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file"))
    return churn.cochange(lines, least=5)


def hidden_cochange(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, together): files that change together though nothing links them."""
    e = load_graph(spark, d).edges.select(file_of(F.col("src")).alias("x"), file_of(F.col("dst_id")).alias("y")).distinct()
    linked = e.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return churn.cochange(_commits(spark, d)).join(linked, ["a", "b"], "left_anti")


def find_hotspots(spark: SparkSession, d: str) -> DataFrame:
    value = lambda df, c: df.select("file", F.col(c).cast("double").alias("value"))
    changed = churn.churn(_commits(spark, d)).where(~is_test_path(F.col("file")))
    return churn.converge(
        {
            "churn": value(changed, "churn"),
            "behaviour": value(_behaviour(_pairs(spark, d), product_only=True), "mass"),
            "centrality": value(_centrality(load_graph(spark, d), product_only=True), "mass"),
        }
    )


# -- modes and subsystems ----------------------------------------------------


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, dict, DataFrame, int, Callable[[str | Column], Column]]:
    """(test_id, codes) of all tests with the numbers of tests ``n`` and ``ones``, (function_id) of all
    functions, how many they are and what makes numbers of them."""
    ws, coverage = Workspace(spark, "profiles"), table(spark, d, "coverage")
    names, seen = ws.write_counted(cover.functions(coverage), "functions")
    number = linalg.number_of(names, "function_id")
    profiles, sums = ws.write_counted(cover.profiles(coverage, number), "profiles", ones=F.sum(F.size("codes")))
    return profiles, sums, names, seen["n"], number


def _modes(spark: SparkSession, d: str) -> tuple[linalg.Modes, DataFrame]:
    """The modes, and the profiles of the tests with functions."""
    profiles, seen, names, n_functions, number = _profiles(spark, d)
    ran = profiles.where(F.size("codes") > 0)
    if 0 < (seen["ones"] or 0) <= LOCAL_ONES:
        return linalg.profile_modes(ran, names, number, seen["n"], n_functions, k=MODES), ran
    return linalg.modes(_pairs(spark, d), seen["n"], k=MODES, local_pairs=0), ran


def _unpivot(df: DataFrame, key: str, k: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i + 1).alias("mode"), F.col(f"v{i}").alias("value")) for i in range(k)])
    return df.select(key, F.explode(cells).alias("x")).select(key, "x.mode", "x.value")


def _leading(df: DataFrame, key: str, n: int) -> DataFrame:
    order = (F.desc(F.abs("value")), F.asc(key))
    salted = df.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(64)))
    cut = salted.withColumn("place", F.row_number().over(Window.partitionBy("mode", "salt").orderBy(*order))).where(F.col("place") <= n)
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy(*order))).where(F.col("place") <= n).drop("salt")


def _labels(top: DataFrame, group: str, name: str, everything: DataFrame, total: int, k: int) -> DataFrame:
    """(group, label): the words of a group's names that set it apart from all names."""
    frequency = everything.select(F.explode(F.array_distinct(label_words(F.col("name")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    tf = top.select(group, F.explode(F.array_distinct(label_words(F.col(name)))).alias("w")).groupBy(group, "w").agg(F.count(F.lit(1)).alias("tf"))
    score = (F.col("tf") * F.log(F.lit(total + 1.0) / (F.col("df") + 1))).alias("score")
    best = tf.join(frequency, "w").select(group, "w", score)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "w"))).where(F.col("place") <= k)
    return best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("x")).select(group, F.array_join(F.col("x.w"), " ").alias("label"))


def find_modes(spark: SparkSession, d: str) -> DataFrame:
    """(mode, energy, label, functions, tests): the strongest patterns in which functions run."""
    found, _ = _modes(spark, d)
    k = len(found.energies)
    fns = _leading(_unpivot(found.functions, "function_id", k), "function_id", 8)
    tests = _leading(_unpivot(found.tests, "test_id", k), "test_id", 5)
    names = fns.select("mode", leaf_of(F.col("function_id")).alias("leaf"))
    every = found.names.select(leaf_of(F.col("function_id")).alias("name"))
    label = _labels(names, "mode", "leaf", every, found.n_functions, 4)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])
    energy = spark.createDataFrame([(i + 1, round(e, 4)) for i, e in enumerate(found.energies)], "mode int, energy double")
    out = energy.join(fns.groupBy("mode").agg(ordered("function_id").alias("functions")), "mode").join(tests.groupBy("mode").agg(ordered("test_id").alias("tests")), "mode")
    return out.join(label, "mode", "left")


def mode_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the modes stand on: tests, functions, the energy of the centred matrix, pairs of tests with
    one profile; ``sound``: energies fall, loadings are orthonormal, and the tests' coordinates hold
    just the energies."""
    found, ran = _modes(spark, d)
    k = len(found.energies)
    loads = linalg.gram(found.loads, k) if k else np.zeros((0, 0))
    shared = linalg.gram(found.tests, k) if k else np.zeros((0, 0))
    # tests without functions lie at one point, which the sum over the others gives: all of them add up to 0
    sums = found.tests.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(k)]).first()
    rest = np.array([sums[f"v{i}"] or 0.0 for i in range(k)])
    empty = found.n_tests - sums["n"]
    if empty:
        shared = shared + np.outer(rest, rest) / empty
    size = max(1.0, float(found.singular[0] ** 2)) if k else 1.0
    sound = bool(np.allclose(loads, np.eye(k), atol=1e-6) and np.allclose(shared / size, np.diag(found.singular**2) / size, atol=5e-3) and (np.diff(found.energies) <= 1e-12).all())
    twins = ran.groupBy("codes").agg(F.count(F.lit(1)).alias("n_tests")).agg(F.coalesce(F.sum(F.col("n_tests") * (F.col("n_tests") - 1) / 2), F.lit(0)).cast("long").alias("redundant_pairs"))
    told = spark.createDataFrame([(found.n_tests, found.n_functions, round(found.total, 4), sound)], "n_tests long, n_functions long, energy double, sound boolean")
    return told.crossJoin(twins)  # one row each


def modes_overview(spark: SparkSession, d: str) -> DataFrame:
    """(dimensionality, is_lower_bound, minimal_set): modes up to 90 % of the energy, and tests that
    together run every function."""
    found, ran = _modes(spark, d)
    size, more = found.dimensionality
    if 0 < found.ones <= LOCAL_ONES:
        needed = cover.greedy_profiles(ran)
    else:
        needed = cover.greedy_order(_pairs(spark, d), ran.select("test_id")).where("gain > 0")
    return needed.agg(F.count(F.lit(1)).alias("minimal_set")).select(F.lit(size).alias("dimensionality"), F.lit(more).alias("is_lower_bound"), "minimal_set")


def test_order_kept(spark: SparkSession, d: str) -> DataFrame:
    """What any greedy order must hold: all tests, gains that add up to the functions run, the
    greatest set first and no gain above the size of its test."""
    pairs = _pairs(spark, d)
    order = test_order(spark, d)
    both = order.join(pairs.groupBy("test_id").agg(F.count(F.lit(1)).alias("size")), "test_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_tests"), F.sum("gain").alias("n_functions"), F.max("gain").alias("first_gain"), F.bool_and(F.col("gain") <= F.coalesce("size", F.lit(0))).alias("possible")
    )


def feature_map(spark: SparkSession, d: str) -> DataFrame:
    """(mode, file, functions): the files that a mode's ten leading functions span."""
    found, _ = _modes(spark, d)
    fns = _leading(_unpivot(found.functions, "function_id", len(found.energies)), "function_id", 10)
    per = fns.groupBy("mode", file_of(F.col("function_id")).alias("file")).agg(F.array_sort(F.collect_list("function_id")).alias("functions"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy("file"))).where("place <= 8").drop("place")


def find_outlier_tests(spark: SparkSession, d: str) -> DataFrame:
    found, ran = _modes(spark, d)
    return linalg.outliers(found, ran).orderBy(F.desc("residual"), "test_id").limit(20)


def similar_behaviour(spark: SparkSession, d: str, anchor: str = ANCHOR) -> DataFrame:
    found, _ = _modes(spark, d)
    return linalg.neighbours(found, anchor).orderBy(F.desc("score"), "function_id").limit(10)


def subsystems(graph: Graph, snapshot: int) -> DataFrame:
    """(snapshot, cluster, size, exemplar, label) of the largest component of one snapshot's
    undirected graph; a snapshot without edges has none."""
    adj = graph.adjacency().where((F.col("s") != F.col("d")) & (F.col("snapshot") == snapshot))
    pairs = adj.select("s", "d").unionByName(adj.select(F.col("d").alias("s"), F.col("s").alias("d"))).distinct()
    ids = pairs.select(F.lit(snapshot).alias("snapshot"), F.col("s").alias("id")).distinct()
    comps = sweeps.components(ids, adj)
    giant = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first()
    if giant is None:
        return ids.limit(0).select("snapshot", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("size"), F.col("id").alias("exemplar"), F.lit("").alias("label"))
    members = comps.where(F.col("component") == giant["component"]).select("id")
    values, vectors = linalg.spectral_embedding(members, pairs.join(members.withColumnRenamed("id", "s"), "s", "left_semi"))
    gaps = [(float(values[i + 1] - values[i]), i + 1) for i in range(1, len(values) - 1)]
    k = max(2, max(gaps)[1]) if gaps else 2
    assigned = similar.cluster(vectors, [f"v{i}" for i in range(min(k, len(values)))], k)
    named = assigned.withColumn("name", qual_of(F.col("id")))
    label = _labels(named, "cluster", "name", named.select("name"), named.count(), 5)
    found = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("exemplar")).join(label, "cluster", "left")
    return found.select(F.lit(snapshot).alias("snapshot"), "cluster", "size", "exemplar", "label")


def find_subsystems(spark: SparkSession, d: str) -> DataFrame:
    """Subsystems of every snapshot; each is decomposed by itself, four of them at a time, since a
    decomposition is mostly one task."""
    g = load_graph(spark, d)
    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(lambda p: subsystems(g, p), periods(spark, d)))
    return reduce(DataFrame.unionByName, parts)


# -- similarity --------------------------------------------------------------


def find_similar(spark: SparkSession, d: str) -> DataFrame:
    found = similar.semantic(load_graph(spark, d), PURPOSE).withColumn("score", F.round("score", 6))
    return similar.best_of(found, 10).select("snapshot", "id", "score", "place")


def find_component(spark: SparkSession, d: str) -> DataFrame:
    return similar.best_of(similar.component_scores(load_graph(spark, d), PURPOSE), 5)


def similar_dense(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every twentieth vector, against all."""
    vectors = similar.normalised(table(spark, d, "embeddings"), "vec_id", "embedding")
    return similar.nearest(vectors, vectors.where("id % 20 = 0"), 10).select("query", "id", F.round("score", 4).alias("score"), "place")


QUERIES = {
    "select_tests": select_tests,
    "co_change": co_change,
    "audit_graph": audit_graph,
    "coactivation": coactivation,
    "find_coupling": find_coupling,
    "find_gaps": find_gaps,
    "test_order": test_order,
    "redundant_tests": redundant_tests,
    "find_core": find_core,
    "coverage_drift": coverage_drift,
    "risk": risk,
    "runtime_risk": runtime_risk,
    "hidden_cochange": hidden_cochange,
    "cochange_orders": cochange_orders,
    "find_hotspots": find_hotspots,
    "find_modes": find_modes,
    "mode_summary": mode_summary,
    "modes_overview": modes_overview,
    "test_order_kept": test_order_kept,
    "feature_map": feature_map,
    "find_outlier_tests": find_outlier_tests,
    "similar_behaviour": similar_behaviour,
    "find_subsystems": find_subsystems,
    "find_similar": find_similar,
    "find_component": find_component,
    "similar_dense": similar_dense,
}

_BASE = "regexp_replace(regexp_replace({0}, '\\|(run|setup|teardown)$', ''), '\\[.*\\]$', '')"
_BASE_ID = "CASE WHEN len(string_split({0}, '::')) > 2 THEN string_split({0}, '::')[1] || '::' || array_to_string(string_split({0}, '::')[2:], '.') ELSE {0} END".format(_BASE.format("e.key"))

_RUN = f"""
cells AS (SELECT snapshot, unnest(map_entries(tests)) AS e FROM coverage),
tests_all AS (SELECT DISTINCT {_BASE_ID} AS test_id FROM cells),
runs_s AS (SELECT DISTINCT snapshot, test_id, f AS function_id FROM (SELECT snapshot, {_BASE_ID} AS test_id, unnest(e.value) AS f FROM cells) WHERE f IS NOT NULL),
runs AS (SELECT DISTINCT test_id, function_id FROM runs_s),
fsize AS (SELECT function_id, count(*) AS n FROM runs GROUP BY 1)"""

_PATH, _QUALS = "split_part({0}, '::', 1)", "CASE WHEN strpos({0}, '::') > 0 THEN substr({0}, strpos({0}, '::') + 2) ELSE '' END"
_RECONCILED = f"""
known AS (SELECT DISTINCT id FROM n),
lost AS (SELECT DISTINCT function_id AS id FROM runs_s WHERE function_id NOT IN (SELECT id FROM known)),
single AS (SELECT split_part({_PATH.format('id')}, '/', -1) AS base, {_QUALS.format('id')} AS qual, min(id) AS node FROM known GROUP BY 1, 2 HAVING count(*) = 1),
remap AS (SELECT l.id, s.node FROM lost l JOIN single s ON s.base = split_part({_PATH.format('l.id')}, '/', -1) AND s.qual = {_QUALS.format('l.id')}
  WHERE {_PATH.format('l.id')} = {_PATH.format('s.node')} OR suffix({_PATH.format('l.id')}, '/' || {_PATH.format('s.node')}) OR suffix({_PATH.format('s.node')}, '/' || {_PATH.format('l.id')})),
mapped AS (SELECT DISTINCT r.snapshot, r.test_id, coalesce(m.node, r.function_id) AS function_id FROM runs_s r LEFT JOIN remap m ON m.id = r.function_id)"""

_COACT = """
wide AS (SELECT test_id FROM runs GROUP BY 1 HAVING count(*) <= 400),
coact AS (
  SELECT a.function_id AS a, b.function_id AS b, count(*) AS shared FROM runs a JOIN runs b ON a.test_id = b.test_id AND a.function_id < b.function_id
  WHERE a.test_id IN (SELECT test_id FROM wide) GROUP BY 1, 2 HAVING count(*) >= 3),
scored AS (SELECT a, b, round(shared / sqrt(x.n * y.n), 4) AS score, shared FROM coact JOIN fsize x ON x.function_id = a JOIN fsize y ON y.function_id = b)"""

_COMMITS = """commits AS (SELECT DISTINCT md5(text) AS c, file FROM documents WHERE lower(trim(source)) = 'commit_message' AND text IS NOT NULL AND file IS NOT NULL),
churned AS (SELECT file, count(*) AS churn FROM commits GROUP BY 1)"""


def _hot(mass: str) -> str:
    return f""", hot AS (SELECT file, churn, mass, round(churn * mass, 2) AS risk FROM churned JOIN ({mass}) USING (file) WHERE mass > 0)
SELECT file, churn, round(mass, 2) AS mass, risk, CASE WHEN risk >= (SELECT max(risk) FROM hot) / 2 THEN 'orange' ELSE 'green' END AS urgency FROM hot"""


_SURE = """sure AS (SELECT e.snapshot, e.dst_id AS id, count(*) AS c FROM e JOIN n ON n.snapshot = e.snapshot AND n.id = e.dst_id
  WHERE relation IN ('CALLS','IMPORTS','INHERITS','ROUTES_TO','REFERENCES','RENDERS','EMITS','HANDLES') AND provenance = 'extracted' GROUP BY 1, 2)"""
_MASS = "SELECT n.file, CAST(sum(c) AS DOUBLE) AS mass FROM sure JOIN n USING (snapshot, id) {0} GROUP BY 1"
_RAN_MASS = "SELECT split_part(function_id, '::', 1) AS file, CAST(count(*) AS DOUBLE) AS mass FROM runs {0} GROUP BY 1"


def _lens(name: str, source: str) -> str:
    return f"""{name}_v AS ({source}), {name}_p AS (SELECT file, (2 * rank() OVER (ORDER BY mass) - 1 + count(*) OVER (PARTITION BY mass)) / 2.0 / count(*) OVER () AS {name} FROM {name}_v)"""


def _words(text: str) -> str:
    parted = f"regexp_replace(array_to_string(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*'), ' '), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    stop = "('self','cls','return','def','class','the','a','an','of','to','and','or','if','is','in','for','with','value','result','none')"
    return f"list_filter(list_transform(regexp_extract_all({parted}, '[A-Z]?[a-z0-9]+|[A-Z]+'), lambda w: lower(w)), lambda w: len(w) > 1 AND w NOT IN {stop})"


_SEMANTIC = f"""
code AS (SELECT * FROM n WHERE kind IN ('Function', 'Method', 'Class')),
words AS (
  SELECT snapshot, id, unnest(list_concat({_words('name')}, coalesce({_words('summary')}, []))) AS w FROM code
  UNION ALL SELECT e.snapshot, e.src, unnest({_words('e.dst_symbol')}) FROM e JOIN code ON code.snapshot = e.snapshot AND code.id = e.src WHERE e.relation = 'CALLS'),
post AS (SELECT snapshot, id, w, count(*) AS tf FROM words GROUP BY 1, 2, 3),
asked AS (SELECT w, count(*) AS q FROM (SELECT unnest({_words("'" + PURPOSE + "'")}) AS w) GROUP BY 1),
sim AS (
  SELECT d.snapshot, d.id, dot / (norm * (SELECT sqrt(sum(q * q)) FROM asked)) AS score
  FROM (SELECT snapshot, id, sum(tf * q) AS dot FROM post JOIN asked USING (w) GROUP BY 1, 2) d JOIN (SELECT snapshot, id, sqrt(sum(tf * tf)) AS norm FROM post GROUP BY 1, 2) USING (snapshot, id))"""

SQL = {
    "select_tests": GRAPH
    + ", "
    + _RUN
    + ", "
    + _RECONCILED
    + f""", seeds AS (SELECT snapshot, id FROM n WHERE id IN ('{CHANGED}', '{ANCHOR}')),
back AS (SELECT * FROM seeds UNION SELECT l.snapshot, l.src FROM back b JOIN live l ON l.snapshot = b.snapshot AND l.dst_id = b.id),
st AS (SELECT snapshot, id AS test_id FROM back JOIN n USING (snapshot, id) WHERE list_contains(n.roles, 'test') AND (snapshot, id) NOT IN (SELECT (snapshot, id) FROM seeds)),
rt AS (SELECT DISTINCT snapshot, test_id FROM mapped WHERE function_id IN ('{CHANGED}', '{ANCHOR}'))
SELECT coalesce(rt.snapshot, st.snapshot) AS snapshot, coalesce(rt.test_id, st.test_id) AS test_id,
  CASE WHEN rt.test_id IS NULL THEN 'static_only' WHEN st.test_id IS NULL THEN 'runtime_only' ELSE 'both' END AS how FROM rt FULL OUTER JOIN st ON rt.snapshot = st.snapshot AND rt.test_id = st.test_id""",
    "co_change": "WITH "
    + _RUN
    + f""", own AS (SELECT test_id FROM runs WHERE function_id = '{ANCHOR}')
SELECT function_id, round(shared / sqrt(n * (SELECT count(*) FROM own)), 4) AS score, shared FROM (
  SELECT function_id, count(*) AS shared FROM runs WHERE test_id IN (SELECT test_id FROM own) AND function_id <> '{ANCHOR}' GROUP BY 1) JOIN fsize USING (function_id)
ORDER BY score DESC, shared DESC, function_id LIMIT 20""",
    "audit_graph": GRAPH
    + ", "
    + _RUN
    + ", "
    + _RECONCILED
    + """, ran AS (SELECT * FROM mapped m WHERE EXISTS (SELECT 1 FROM n WHERE n.snapshot = m.snapshot AND n.id = m.function_id)),
own AS (SELECT DISTINCT snapshot, test_id FROM ran WHERE (snapshot, test_id) IN (SELECT (snapshot, id) FROM n)),
called AS (SELECT DISTINCT r.snapshot, r.test_id, l.dst_id AS id FROM ran r JOIN live l ON l.snapshot = r.snapshot AND l.src = r.function_id WHERE l.src <> l.dst_id),
walk AS (
  SELECT snapshot, test_id, test_id AS id FROM own
  UNION SELECT snapshot, test_id, function_id FROM ran r WHERE (snapshot, test_id) NOT IN (SELECT (snapshot, test_id) FROM own)
    AND NOT EXISTS (SELECT 1 FROM called c WHERE c.snapshot = r.snapshot AND c.test_id = r.test_id AND c.id = r.function_id)
  UNION SELECT w.snapshot, w.test_id, l.dst_id FROM walk w JOIN live l ON l.snapshot = w.snapshot AND l.src = w.id)
SELECT r.snapshot, r.test_id, r.executed, coalesce(h.hit, 0) AS hit, w.reached, round(coalesce(h.hit, 0) / r.executed, 3) AS recall
FROM (SELECT snapshot, test_id, count(*) AS executed FROM ran GROUP BY 1, 2) r JOIN (SELECT snapshot, test_id, count(*) AS reached FROM walk GROUP BY 1, 2) w USING (snapshot, test_id)
LEFT JOIN (SELECT ran.snapshot, ran.test_id, count(*) AS hit FROM ran JOIN walk ON walk.snapshot = ran.snapshot AND walk.test_id = ran.test_id AND walk.id = ran.function_id GROUP BY 1, 2) h USING (snapshot, test_id)""",
    "coactivation": "WITH " + _RUN + "," + _COACT + " SELECT a, b, score, shared FROM scored",
    "find_coupling": GRAPH
    + ", "
    + _RUN
    + ","
    + _COACT
    + """, linked AS (SELECT DISTINCT least(src, dst_id) AS a, greatest(src, dst_id) AS b FROM e),
first AS (SELECT *, row_number() OVER (ORDER BY score DESC, shared DESC, a, b) AS place FROM scored WHERE score >= 0.5 AND (a, b) NOT IN (SELECT (a, b) FROM linked) QUALIFY place <= 40),
calls AS (SELECT DISTINCT src, dst_id FROM e WHERE relation = 'CALLS'),
common AS (SELECT f.a, f.b, array_to_string(list_sort(list(DISTINCT x.src))[:3], ',') AS c FROM first f JOIN calls x ON x.dst_id = f.a JOIN calls y ON y.dst_id = f.b AND y.src = x.src GROUP BY 1, 2)
SELECT CAST(place AS INTEGER) AS place, a, b, score, shared, split_part(a, '::', 1) <> split_part(b, '::', 1) AS cross_file, coalesce(c, '') AS common_callers FROM first LEFT JOIN common USING (a, b)""",
    "find_gaps": GRAPH
    + ROOTS
    + ", "
    + _RUN
    + ", "
    + _RECONCILED
    + """ SELECT n.snapshot, n.id, CASE WHEN r.id IS NULL THEN 'untested_dead' ELSE 'untested_live' END AS state FROM n LEFT JOIN reached r USING (snapshot, id)
WHERE n.kind IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.snapshot = n.snapshot AND m.function_id = n.id)""",
    "redundant_tests": "WITH "
    + _RUN
    + """ SELECT min(test_id) AS first_test, count(*) AS n_tests, k AS n_functions FROM (SELECT test_id, list_sort(list(function_id)) AS fs, count(*) AS k FROM runs GROUP BY 1) GROUP BY fs, k HAVING count(*) >= 2""",
    "find_core": "WITH " + _RUN + " SELECT function_id, n, round(n / (SELECT count(*) FROM tests_all), 4) AS fraction FROM fsize ORDER BY n DESC, function_id LIMIT 20",
    "coverage_drift": "WITH "
    + _RUN
    + """, o AS (SELECT DISTINCT function_id FROM runs_s WHERE snapshot = 1), w AS (SELECT DISTINCT function_id FROM runs_s WHERE snapshot = 4)
SELECT 'gained' AS change, function_id FROM w WHERE function_id NOT IN (SELECT function_id FROM o) UNION ALL SELECT 'lost', function_id FROM o WHERE function_id NOT IN (SELECT function_id FROM w)""",
    "risk": GRAPH + ", " + _SURE + ", " + _COMMITS + _hot(_MASS.format("")),
    "runtime_risk": "WITH " + _RUN + ", " + _COMMITS + _hot(_RAN_MASS.format("")),
    "mode_summary": "WITH "
    + _RUN
    + """, size AS (SELECT count(*) AS n FROM tests_all),
twins AS (SELECT count(*) AS k FROM (SELECT test_id, list_sort(list(function_id)) AS fs FROM runs GROUP BY 1) GROUP BY fs)
SELECT size.n AS n_tests, (SELECT count(*) FROM fsize) AS n_functions, (SELECT round(sum(f.n - f.n * f.n / CAST(size.n AS DOUBLE)), 4) FROM fsize f) AS energy, TRUE AS sound,
  (SELECT CAST(coalesce(sum(k * (k - 1) // 2), 0) AS BIGINT) FROM twins) AS redundant_pairs FROM size""",
    "test_order_kept": "WITH "
    + _RUN
    + """ SELECT (SELECT count(*) FROM tests_all) AS n_tests, (SELECT count(*) FROM fsize) AS n_functions, max(c) AS first_gain, TRUE AS possible
FROM (SELECT count(*) AS c FROM runs GROUP BY test_id)""",
    "similar_dense": """
WITH raw AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id, CAST(list_transform(x, lambda e: CAST(e / sqrt(list_inner_product(x, x)) AS FLOAT)) AS DOUBLE[]) AS x FROM raw),
s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_inner_product(q.x, v.x) AS c FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, id, round(round(c, 6), 4) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS INT) AS place FROM s WHERE c > 0) WHERE place <= 10""",
    "hidden_cochange": GRAPH
    + ", "
    + _COMMITS
    + """, small AS (SELECT c FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30),
linked AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT split_part(src, '::', 1) AS x, split_part(dst_id, '::', 1) AS y FROM e) WHERE x <> y)
SELECT a, b, together FROM (SELECT x.file AS a, y.file AS b, count(*) AS together FROM commits x JOIN commits y ON x.c = y.c AND x.file < y.file WHERE x.c IN (SELECT c FROM small) GROUP BY 1, 2 HAVING count(*) >= 2)
WHERE (a, b) NOT IN (SELECT (a, b) FROM linked)""",
    "cochange_orders": """
WITH c AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS f FROM lineitem WHERE l_orderkey IS NOT NULL AND l_suppkey IS NOT NULL), small AS (SELECT k FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)
SELECT x.f AS a, y.f AS b, count(*) AS together FROM c x JOIN c y ON x.k = y.k AND x.f < y.f WHERE x.k IN (SELECT k FROM small) GROUP BY 1, 2 HAVING count(*) >= 5""",
    "find_hotspots": GRAPH
    + ", "
    + ", ".join([_RUN, _SURE, _COMMITS])
    + ", "
    + ", ".join(
        [
            _lens("churn", f"SELECT file, CAST(churn AS DOUBLE) AS mass FROM churned WHERE NOT {test_path('file')}"),
            _lens("behaviour", _RAN_MASS.format(f"WHERE NOT {test_path('function_id')}")),
            _lens("centrality", _MASS.format("WHERE NOT n.is_test")),
        ]
    )
    + """, hot AS (SELECT file, churn, behaviour, centrality, (churn IS NOT NULL)::INT + (behaviour IS NOT NULL)::INT + (centrality IS NOT NULL)::INT AS n_lenses
  FROM churn_p FULL OUTER JOIN behaviour_p USING (file) FULL OUTER JOIN centrality_p USING (file))
SELECT file, round(pow(coalesce(churn, 1) * coalesce(behaviour, 1) * coalesce(centrality, 1), 1.0 / n_lenses), 4) AS score, n_lenses, round(churn, 3) AS churn, round(behaviour, 3) AS behaviour, round(centrality, 3) AS centrality
FROM hot WHERE n_lenses >= 2""",
    "find_similar": GRAPH
    + ", "
    + _SEMANTIC
    + " SELECT snapshot, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY snapshot ORDER BY round(score, 6) DESC, id) AS INTEGER) AS place FROM sim QUALIFY place <= 10",
    "find_component": GRAPH
    + ", "
    + _SEMANTIC
    + f""" SELECT s.snapshot, s.id, n.name, list_contains(n.roles, 'exported') AS exported, round(s.score + CASE WHEN list_contains(n.roles, 'exported') THEN 0.15 ELSE 0 END, 3) AS score,
  CAST(row_number() OVER (PARTITION BY s.snapshot ORDER BY round(s.score + CASE WHEN list_contains(n.roles, 'exported') THEN 0.15 ELSE 0 END, 3) DESC, s.id) AS INTEGER) AS place
FROM sim s JOIN n USING (snapshot, id) WHERE NOT list_contains(n.roles, 'test') AND NOT {test_path('s.id')} QUALIFY place <= 5""",
}

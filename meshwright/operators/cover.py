"""Set algebra over the matrix of tests and the functions they ran.

The matrix is a table (test_id, function_id) of distinct pairs; tests are named without run phase
and parameters. Nothing here builds a matrix in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.ids import base_test_id, file_of, qual_of
from meshwright.operators import kernels
from meshwright.runtime import Workspace

#: Functions of a test that one record holds; wider tests are taken apart into pairs of blocks.
BLOCK = 400


def runs(coverage: DataFrame, *, by_snapshot: bool = False) -> DataFrame:
    """([snapshot,] test_id, function_id): distinct pairs of all artifacts; null functions are none."""
    keep = ["snapshot"] * by_snapshot
    cells = coverage.select(*keep, F.explode("tests").alias("t", "fs")).select(*keep, base_test_id(F.col("t")).alias("test_id"), "fs")
    # ids of tests are cut before functions are laid out: once a test, not once a function
    cells = cells.select(*keep, "test_id", F.explode("fs").alias("function_id"))
    return cells.where(F.col("function_id").isNotNull()).distinct()


def functions(coverage: DataFrame) -> DataFrame:
    """(function_id) of all functions that a test ran."""
    ran = coverage.select(F.explode(F.map_values("tests")).alias("fs")).select(F.explode("fs").alias("function_id"))
    return ran.where(F.col("function_id").isNotNull()).distinct()


def profiles(coverage: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """(test_id, codes) of all tests: the distinct numbers of the functions that a test ran, rising. A
    function's number stands for it from the first, so that ids are not laid out by test."""
    cells = coverage.select(F.explode("tests").alias("t", "fs"))
    cells = cells.select(base_test_id(F.col("t")).alias("test_id"), F.transform(F.array_compact(F.coalesce("fs", F.array().cast("array<string>"))), number).alias("codes"))
    return cells.groupBy("test_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))


def all_tests(coverage: DataFrame) -> DataFrame:
    """(test_id) of all tests, those that ran nothing too."""
    return coverage.select(F.explode(F.map_keys("tests")).alias("t")).select(base_test_id(F.col("t")).alias("test_id")).distinct()


def reconcile(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Function ids brought to those of the graph where the trees differ by a path prefix only:
    file name and qualified name must be one node's, and one path must end in the other."""
    key = [F.substring_index(file_of(F.col("id")), "/", -1).alias("base"), qual_of(F.col("id")).alias("qual")]
    known = nodes.select("id").distinct()
    lost = pairs.select(F.col("function_id").alias("id")).distinct().join(known, "id", "left_anti").select("id", *key)
    single = known.select("id", *key).groupBy("base", "qual").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1")
    a, b = file_of(F.col("id")), file_of(F.col("node"))
    aligned = (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
    remap = lost.join(single, ["base", "qual"]).where(aligned).select(F.col("id").alias("function_id"), "node")
    out = pairs.join(remap, "function_id", "left").withColumn("function_id", F.coalesce("node", "function_id"))
    return out.select(*pairs.columns).distinct()


def sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("function_id").agg(F.count(F.lit(1)).alias("n"))


def co_functions(pairs: DataFrame, anchor: str) -> DataFrame:
    """(function_id, score, shared): functions by the cosine of their tests with the anchor's."""
    own = pairs.where(F.col("function_id") == anchor).select("test_id")
    shared = pairs.join(own, "test_id", "left_semi").where(F.col("function_id") != anchor).groupBy("function_id").agg(F.count(F.lit(1)).alias("shared"))
    n_own = own.count()
    out = shared.join(sizes(pairs), "function_id")
    return out.select("function_id", F.round(F.col("shared") / F.sqrt(F.col("n") * F.lit(n_own)), 4).alias("score"), "shared")


def coactivation(pairs: DataFrame, *, min_shared: int = 3, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, score, shared) of functions a < b that run together in ``min_shared`` tests or more.

    Functions of fewer tests can be in no such pair and are left out before pairs are made. Tests
    of more than ``block`` functions are split into blocks, each paired with itself and with every
    later one, so no record holds more than two blocks. With ``cap``, tests of more functions
    pair none of them, though they count for the sizes.
    """
    ws = Workspace(pairs.sparkSession, "coactivation")
    n = ws.write(sizes(pairs), "sizes")
    kept = pairs.join(n.where(F.col("n") >= min_shared).select("function_id"), "function_id", "left_semi")
    width = pairs.groupBy("test_id").agg(F.count(F.lit(1)).alias("width"))
    if cap is not None:
        width = width.where(F.col("width") <= cap)
    # the hash spreads a wide test over about width / block blocks; a test of one block stays whole
    parts = F.ceil(F.col("width") / block)
    placed = kept.join(width, "test_id").select("test_id", "function_id", parts.alias("parts"), F.pmod(F.xxhash64("function_id"), parts).alias("part"))
    lists = ws.write(placed.groupBy("test_id", "part", "parts").agg(F.sort_array(F.collect_list("function_id")).alias("fs")), "lists")
    tails = F.transform("fs", lambda f, i: F.struct(f.alias("a"), F.slice(F.col("fs"), i + 2, F.size("fs")).alias("bs")))
    two = lists.select(F.explode(tails).alias("x")).select("x.a", F.explode("x.bs").alias("b"))
    wide = lists.where("parts > 1")
    later = wide.select("test_id", F.col("part").alias("part2"), F.col("fs").alias("fs2"))
    across = wide.select("test_id", "part", "fs").join(later, "test_id").where("part < part2")
    across = across.select(F.explode("fs").alias("x"), "fs2").select("x", F.explode("fs2").alias("y"))
    two = two.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    shared = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)
    out = shared.join(n.select(F.col("function_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("function_id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("shared") / F.sqrt(F.col("na") * F.col("nb")), 4).alias("score"), "shared")


def hidden_coupling(pairs: DataFrame, edges: DataFrame, *, min_shared: int = 3, min_score: float = 0.5, limit: int = 40) -> DataFrame:
    """The strongest pairs that run together without an edge either way: (place, a, b, score, shared,
    cross_file, common_callers), at most three callers that call both."""
    strong = coactivation(pairs, min_shared=min_shared).where(F.col("score") >= min_score)
    linked = edges.select(F.least("src", "dst_id").alias("a"), F.greatest("src", "dst_id").alias("b")).distinct()
    order = (F.desc("score"), F.desc("shared"), F.asc("a"), F.asc("b"))
    first = strong.join(linked, ["a", "b"], "left_anti").orderBy(*order).limit(limit)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    calls = edges.where(F.col("relation") == "CALLS").select("src", "dst_id").distinct()
    of_a = first.select("a", "b").join(calls.withColumnRenamed("dst_id", "a"), "a")
    both = of_a.join(calls.withColumnRenamed("dst_id", "b"), ["b", "src"]).groupBy("a", "b")
    callers = both.agg(F.slice(F.array_sort(F.collect_set("src")), 1, 3).alias("common_callers"))
    out = first.join(callers, ["a", "b"], "left")
    none = F.array().cast("array<string>")
    return out.select("place", "a", "b", "score", "shared", (file_of(F.col("a")) != file_of(F.col("b"))).alias("cross_file"), F.coalesce("common_callers", none).alias("common_callers"))


def redundant_groups(pairs: DataFrame) -> DataFrame:
    """(first_test, n_tests, n_functions) of tests that ran one and the same set, two or more.

    A set is compared by the digest of its sorted members, so no set is moved twice.
    """
    profile = pairs.groupBy("test_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("function_id")), "\x1f"), 256).alias("profile"), F.count(F.lit(1)).alias("n_functions"))
    groups = profile.groupBy("profile", "n_functions").agg(F.min("test_id").alias("first_test"), F.count(F.lit(1)).alias("n_tests"))
    return groups.where("n_tests >= 2").select("first_test", "n_tests", "n_functions")


def core_functions(pairs: DataFrame, n_tests: int, top: int = 20) -> DataFrame:
    counted = sizes(pairs).orderBy(F.desc("n"), "function_id").limit(top)
    return counted.select("function_id", "n", F.round(F.col("n") / F.lit(max(1, n_tests)), 4).alias("fraction"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, function_id): functions that gained or lost all their tests."""
    a, b = old.select("function_id").distinct(), new.select("function_id").distinct()
    gained = b.join(a, "function_id", "left_anti").select(F.lit("gained").alias("change"), "function_id")
    return gained.unionByName(a.join(b, "function_id", "left_anti").select(F.lit("lost").alias("change"), "function_id"))


def greedy_order(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, gain): the order of tests by greatest new coverage, ties by least id.

    A test whose gain no test that shares an uncovered function exceeds is taken with just that
    gain in the sequential order too, so all such tests are taken in one round. Sorted by falling
    gain and rising id, the picks are the sequential order; tests without gain come last.
    """
    ws = Workspace(pairs.sparkSession, "greedy")
    left = ws.write(pairs.select("test_id", "function_id").distinct(), "left")
    picks = []
    while not left.isEmpty():
        gain = left.groupBy("test_id").agg(F.count(F.lit(1)).alias("gain"))
        ranked = ws.write(left.join(gain, "test_id"), "ranked")
        best = ranked.groupBy("function_id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "test_id")).alias("best"))
        mine = best.select(F.col("best.test_id").alias("test_id"), (-F.col("best.g")).alias("gain")).groupBy("test_id", "gain").agg(F.count(F.lit(1)).alias("led"))
        pick = ws.write(mine.where("led = gain").select("test_id", "gain"), "picks")
        picks.append(pick)
        gone = left.join(pick, "test_id", "left_semi").select("function_id").distinct()
        rest = ws.write(left.join(gone, "function_id", "left_anti").select("test_id", "function_id"), "left")
        ws.drop(left, ranked)
        left = rest
    if not picks:
        return tests.select("test_id", F.lit(0).cast("long").alias("gain"))
    done = ws.together(picks)
    return done.unionByName(tests.join(done, "test_id", "left_anti").select("test_id", F.lit(0).cast("long").alias("gain")))


def greedy_profiles(profiles: DataFrame) -> DataFrame:
    """(test_id, gain) of the tests that ``greedy_order`` takes with a gain, from (test_id, codes) of tests
    with functions, which one task reads as a stream: for at most ``kernels.LOCAL_ONES`` ones."""
    return profiles.select("test_id", "codes").coalesce(1).mapInArrow(kernels.greedy_order, "test_id string, gain long")

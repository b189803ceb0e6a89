import random
from collections import Counter

from pyspark.sql import functions as F

from meshwright.operators import treeagg


def test_tree_equals_plain(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, ""]), rng.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(23)
    got = treeagg.tree_aggregate(df, ["k"], [treeagg.count_rows("n"), treeagg.sum_of("s", F.col("v")), treeagg.min_of("lo", F.col("v")), treeagg.max_of("hi", F.col("v"))], fan_in=3)
    want = {}
    for k, v in rows:
        n, s, lo, hi = want.get(k, (0, 0, 1000, -1))
        want[k] = (n + 1, s + v, min(lo, v), max(hi, v))
    assert {r.k: (r.n, r.s, r.lo, r.hi) for r in got.collect()} == want


def test_heavy_keys(spark):
    rows = [("s", "d")] * 1 + [(None, "hot")] * 50 + [("x", None)] * 48 + [("a", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "src string, dst_id string, node_id int").repartition(7)
    got = {tuple(r) for r in treeagg.heavy_keys(df, ["dst_id", "src"], "0.01", fan_in=2).collect()}
    assert got == {("dst_id", "hot", 50), ("dst_id", "d", 1), ("dst_id", "b", 1), ("src", "x", 48), ("src", "s", 1), ("src", "a", 1)}
    got = {r.node_id for r in treeagg.heavy_keys(df, ["dst_id", "src"], "0.02", fan_in=2).collect()}
    assert got == {"hot", "x"}
    assert treeagg.heavy_keys(df.limit(0), ["src"], "0.01").collect() == []


def test_degrees(spark):
    rows = [("a", "b"), ("a", "b"), ("a", None), (None, "b"), (None, None), ("c", "b"), ("b", "b"), ("", "c")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "src string, dst_id string, n_in string")
    got = {r.node_id: (r.n_in, r.n_out, r.n_callers, r.n_callees) for r in treeagg.degrees(df).collect()}
    ids = {x for r in rows for x in r if x is not None}
    inn, out = Counter(d for _, d in rows), Counter(s for s, _ in rows)
    want = {i: (inn[i], out[i], len({s for s, d in rows if d == i and s is not None}), len({d for s, d in rows if s == i and d is not None})) for i in ids}
    assert got == want

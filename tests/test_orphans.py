import random

from pyspark.sql import functions as F

from meshwright.operators import orphans as op


def run(spark, nodes, edges, order):
    n = spark.createDataFrame([(*r, "x") for r in nodes], "snapshot int, id string, name string, state string")
    e = spark.createDataFrame([(*r, "x") for r in edges], "snapshot int, seq long, src string, dst_id string, dst_symbol string, key string")
    shared = spark.createDataFrame([("shared", "common")], "id string, name string")
    spaces = {"id": F.col("id"), "name": F.col("name")}
    fields = [("src", "id", F.col("src")), ("dst_id", "id", F.col("dst_id")), ("dst_symbol", "name", F.when(F.col("dst_id").isNull(), F.col("dst_symbol")))]
    out = op.orphans(
        lambda p: op.parent_keys([(n.where(F.col("snapshot") == p), spaces), (shared, spaces)]),
        lambda p: op.reference_keys(e.where(F.col("snapshot") == p), "seq", fields),
        order,
    )
    return sorted((r.period, r.row_id, r.field, r.state) for r in out.collect()), out


def brute(nodes, edges):
    ids, names = {}, {}
    for s, i, m in nodes:
        ids.setdefault(i, set()).add(s)
        names.setdefault(m, set()).add(s)
    out = []
    for s, seq, a, b, c in edges:
        for field, value, where, shared in (("src", a, ids, "shared"), ("dst_id", b, ids, "shared"), ("dst_symbol", c if b is None else None, names, "common")):
            if value is None or value == shared or s in where.get(value, ()):
                continue
            have = where.get(value, set())
            out.append((s, seq, field, "deleted" if any(x < s for x in have) else "later" if any(x > s for x in have) else "never"))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    ids = [f"n{i}" for i in range(12)] + [""]
    nodes = [(s, i, "m" + i) for s in (1, 2, 3, 4) for i in ids if rng.random() < 0.5] * 2 + [(2, None, None), (3, "n1", None)]
    pick = lambda: rng.choice([*ids, None, "shared", "ghost"])
    edges = [(rng.randrange(1, 5), k, pick(), pick(), rng.choice(["mn1", "mn2", "common", "nobody", None, "m"])) for k in range(120)]
    got, out = run(spark, nodes, edges, [1, 2, 3, 4])
    assert got == brute(nodes, edges)
    report = {tuple(r)[1:4]: r.n_references for r in op.period_report(out, "edges").collect()}
    assert sum(report.values()) == len(got)


def test_repeated_rows_and_nothing(spark):
    assert run(spark, [], [(1, 1, "a", None, None), (1, 1, "a", None, None)], [1])[0] == [(1, 1, "src", "never")] * 2
    assert run(spark, [], [], [1, 2])[0] == []
    assert run(spark, [(1, "a", "b")], [], [])[0] == []

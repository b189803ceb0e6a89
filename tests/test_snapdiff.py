import random
from datetime import datetime

from meshwright.operators.snapdiff import record_changes, set_changes

T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def test_record_changes(spark):
    rows = [
        (1, "a", "x", ["r", "s"], T0, "clash"), (1, "a", "old", ["q"], None, "clash"), (2, "a", "x", ["s", "r", "r"], T0, "c"),
        (1, "b", None, [], T0, "c"), (2, "b", "", [], T0, "c"), (3, "b", "", [], T0, "c"),
        (1, "gone", "x", [], T0, "c"), (3, "gone", "x", [], T0, "c"),
        (2, None, "x", None, T0, "c"), (3, None, "x", None, T1, "c"), (3, None, "x", None, T1, "c"),
        (3, "new", None, None, T0, "c"), (None, "lost", "x", [], T0, "c"), (9, "other", "x", [], T0, "c"),
        (2, "v", "late", [], T1, "c"), (2, "v", "early", [], T0, "c"), (3, "v", "late", [], T0, "c"),
    ]
    df = spark.createDataFrame(rows, "snapshot int, id string, summary string, roles array<string>, ingested_at timestamp, at string")
    got = {tuple(r[:3]) + (tuple(r.fields) if r.fields else None,) for r in record_changes(df, "snapshot", ["id"], ["summary", "roles"], [1, 2, 3], version="ingested_at").collect()}
    assert got == {
        (2, "b", "changed", ("summary",)), (2, "gone", "removed", None), (3, "gone", "added", None), (2, None, "added", None),
        (3, "new", "added", None), (3, "a", "removed", None), (2, "v", "added", None),
    }


def test_record_changes_empty(spark):
    df = spark.createDataFrame([], "snapshot int, id string, v string")
    assert record_changes(df, "snapshot", ["id"], ["v"], [1, 2]).collect() == []
    assert record_changes(df, "snapshot", ["id"], ["v"], [1]).collect() == []


def brute(rows, order):
    sets = {}
    for s, k, m in rows:
        sets.setdefault(s, {}).setdefault(k, set()).add(m)
    out = set()
    for a, b in zip(order, order[1:]):
        old, new = sets.get(a, {}), sets.get(b, {})
        for k in old.keys() | new.keys():
            if old.get(k) != new.get(k):
                out.add((b, k, "added" if k not in old else "removed" if k not in new else "changed"))
    return out


def test_set_changes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(1, 5), rng.choice([None, "", "a", "b", "c", "d", "e"]), rng.choice([None, "x", "y", ""])) for _ in range(60)]
    rows += [(2, "hot", "x")] * 200 + [(3, "hot", "x")] * 100
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "snapshot int, k string, m string, seen int, at string")
    for order in ([1, 2, 3, 4], [1, 2], [1, 3, 7], [1]):
        got = [tuple(r) for r in set_changes(df, "snapshot", ["k"], ["m"], order).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, order)


def test_set_changes_long_history(spark):
    rng = random.Random(4)
    order = list(range(1, 141))
    rows = [(s, k, m) for s in order for k in "abc" for m in "xy" if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "snapshot int, k string, m string")
    assert {tuple(r) for r in set_changes(df, "snapshot", ["k"], ["m"], order).collect()} == brute(rows, order)
    assert set_changes(df.limit(0), "snapshot", ["k"], ["m"], order).collect() == []

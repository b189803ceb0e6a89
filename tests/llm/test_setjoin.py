import random

import numpy as np
import pytest

from meshwright.llm import setjoin

SCHEMA = "test string, fn string, n int, band int, side int"


def frame(spark, sets):
    return spark.createDataFrame([(t, f, 1, 2, 3) for t, fs in sets for f in fs], SCHEMA)


def brute(sets, num, den, least=1):
    whole = {}
    for t, fs in sets:
        if t is not None:
            whole.setdefault(t, set()).update(f for f in fs if f is not None)
    whole = {t: s for t, s in whole.items() if len(s) >= least}
    return whole, {(a, b) for a in whole for b in whole if a < b and den * len(whole[a] & whole[b]) >= num * len(whole[a] | whole[b])}


def noisy(seed, n=90):
    rng = random.Random(seed)
    pool, hot = [f"f{i}" for i in range(60)], [f"hot{i}" for i in range(6)]
    sets = []
    for i in range(n):
        if sets and rng.random() < 0.5:
            s = list(rng.choice(sets)[1])
            if rng.random() < 0.6:
                s = s[:-1] + [rng.choice(pool)]
        else:
            s = rng.sample(hot, rng.randrange(4, 7)) + rng.sample(pool, rng.randrange(0, 6))
        sets.append((f"t{i}", s))
    return sets + [("t1", ["f1", None, "f1"]), (None, ["f1"]), ("empty", []), ("nulls", [None]), ("blank", ["", "f1"])]


@pytest.mark.parametrize("bucket", [0, 48])
def test_equals_brute_force(spark, bucket):
    sets = noisy(1)
    found = setjoin.similar_sets(frame(spark, sets), "test", "fn", "0.8", min_items=5, bucket=bucket)
    got = [tuple(r) for r in setjoin.record_pairs(found).collect()]
    whole, want = brute(sets, 8, 10, 5)
    assert len(got) == len(set(got)) and set(got) == want
    classes = {r.record: (r.class_id, r.n_links) for r in setjoin.record_classes(found).collect()}
    assert classes == {t: (min(x for x in whole if whole[x] == s), sum(t in p for p in want)) for t, s in whole.items()}


@pytest.mark.parametrize("t,num", [("0.4", 4), ("1", 10)])
def test_other_thresholds(spark, t, num):
    sets = noisy(7, 50)
    found = setjoin.similar_sets(frame(spark, sets), "test", "fn", t, bucket=8)
    assert {tuple(r) for r in setjoin.record_pairs(found).collect()} == brute(sets, num, 10)[1]


def test_bands_follow_the_threshold():
    assert setjoin.plan_bands(0.8) == (62, 4)
    for t in (0.1, 0.3, 0.5, 0.7, 0.9, 0.99, 1.0):
        bands, rows = setjoin.plan_bands(t)
        assert (1 - t**rows) ** bands <= 1e-14 and rows >= 1
    with pytest.raises(ValueError):
        setjoin.similar_sets(None, "a", "b", "0")


def test_between_two_tables(spark):
    one, two = noisy(2, 40), noisy(3, 40) + noisy(2, 5)
    found = setjoin.similar_sets(frame(spark, one), "test", "fn", "0.7", other=frame(spark, two), bucket=4)
    got = {tuple(r) for r in setjoin.record_pairs(found, within=False).collect()}
    a, b = brute(one, 1, 1)[0], brute(two, 1, 1)[0]
    assert got == {(x, y) for x in a for y in b if 10 * len(a[x] & b[y]) >= 7 * len(a[x] | b[y])}


def test_copies_and_nothing(spark):
    sets = [(f"c{i}", ["a", "b", "c"]) for i in range(40)] + [("x", ["a", "b", "c", "d"])]
    found = setjoin.similar_sets(frame(spark, sets), "test", "fn", "0.8")
    assert found.classes.count() == 2 and found.links.count() == 0
    assert setjoin.record_pairs(found).count() == 40 * 39 // 2
    empty = setjoin.similar_sets(frame(spark, []), "test", "fn", "0.8")
    assert setjoin.record_pairs(empty).collect() == [] and setjoin.record_classes(empty).collect() == []


def test_signature_estimates_similarity():
    a, b = np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)
    words = setjoin.signatures(np.concatenate([a, b]), np.array([0, 90]), 3000, 1)
    assert abs((words[:, 0] == words[:, 1]).mean() - 0.8) < 0.03

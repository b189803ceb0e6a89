import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwright.llm import copies
from meshwright.llm.packing import best_fit, bin_completion, fill, lower_bound, pack_items


def least_bins(sizes, cap):
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        rooms.append(cap - sizes[i])
        go(i + 1, rooms)
        rooms.pop()

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_near_the_optimum(sizes):
    bins = bin_completion(sizes, 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    assert len(bins) <= least_bins(sizes, 20) + 1
    assert len(bins) <= len(best_fit(sorted(sizes, reverse=True), 20))


def test_fills_better_than_best_fit():
    rng = random.Random(2)
    sizes = [rng.randrange(300, 900) for _ in range(2000)]
    assert len(bin_completion(sizes)) <= len(best_fit(sorted(sizes, reverse=True), 2048))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=12), st.integers(0, 40))
def test_fill_is_exact(sizes, room):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= room}
    chosen = fill(room, sorted(set(sizes)), Counter(sizes))
    assert not Counter(chosen) - Counter(sizes) and sum(chosen) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_a_bound(sizes):
    assert lower_bound(sizes, 20) <= least_bins(sizes, 20)


def test_perfect_triples_are_found_again():
    for seed in range(3):
        rng, sizes = random.Random(seed), []
        for _ in range(60):
            a = rng.randint(780, 1000)
            b = rng.randint(520, (2048 - a) // 2 + 100)
            sizes += [a, b, 2048 - a - b]
        assert len(bin_completion(sizes)) == 60
        assert len(best_fit(sorted(sizes, reverse=True), 2048)) > 60


def test_search_backs_out_of_a_bad_filling():
    # the largest sizes first give 60 + 40, 50 + 30 + 20 and leave 50, 30, 20 apart from 45 + 55
    sizes = [60, 55, 50, 50, 45, 40, 30, 30, 20, 20]
    assert len(bin_completion(sizes, 100)) == lower_bound(sizes, 100) == 4


def test_packing_does_not_follow_the_files(spark):
    rng = random.Random(6)
    rows = [(i % 200, rng.randrange(0, 60)) for i in range(500)] + [(7, 9)] * 20
    df = spark.createDataFrame(rows, "doc long, n long")
    laid = [df.repartition(1), df.repartition(5).sortWithinPartitions(F.desc("n"))]
    out = [sorted((r.id, r.size, r.container_id) for r in pack_items(x, "doc", F.col("n"), capacity=100, batch_items=64, items_per_part=128).collect()) for x in laid]
    assert out[0] == out[1]


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(copies, "STRETCH", 3)
    df = spark.createDataFrame([(1, "a")] * 8 + [(2, None)] * 3 + [(3, "b")], "k long, v string")
    out = sorted((r.k, r.copy) for r in copies.numbered_copies(df, ("k", "v")).collect())
    assert out == [(1, i) for i in range(8)] + [(2, i) for i in range(3)] + [(3, 0)]


def check(spark, rows, cap=100, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc long, n long, id string, piece int")
    out = pack_items(df, "doc", F.col("n"), capacity=cap, **options).collect()
    want = Counter()
    for d, n in rows:
        n = max(n or 0, 0)
        for k in range(max(1, -(-n // cap))):
            want[(None if d is None else str(d), k, min(n - k * cap, cap), k * cap)] += 1
    assert Counter((r.id, r.piece, r.size, r.start) for r in out) == want
    load = Counter()
    for r in out:
        load[r.container_id] += r.size
    assert all(v <= cap for v in load.values())
    return load


def test_every_item_once_and_little_waste(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 7, 30, 33, 60, 99, 100, 101, 350])) for i in range(700)] + [(None, 5), (3, None), (4, -2), (5, 9), (5, 9)]
    load = check(spark, rows, batch_items=64, items_per_part=256)
    assert sum(load.values()) > 0.93 * 100 * sum(v > 0 for v in load.values())


def test_copies_and_nothing(spark):
    load = check(spark, [(1, 40)] * 500, batch_items=32, items_per_part=64)
    assert len(load) <= 255
    assert check(spark, []) == {}
    assert len(check(spark, [(1, 0), (2, None)])) == 1

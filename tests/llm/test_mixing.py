import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from meshwright.llm import mixing


def test_exponents():
    q = [0.6, 0.3, 0.1]
    a = mixing.exponent_for_entropy(q, 1.0)
    assert mixing.entropy(mixing.temperature_weights(q, a)) == pytest.approx(1.0, abs=1e-9)
    assert mixing.temperature_weights(q, 0.0) == pytest.approx([1 / 3] * 3)
    t = [0.2, 0.3, 0.5]
    assert mixing.exponent_for_limit(q, t, [9, 9, 9]) == 1.0
    a = mixing.exponent_for_limit(q, t, [1, 1, 2])
    w = mixing.tilted_weights(q, t, a)
    assert max(x / (p * y) for x, y, p in zip(w, q, [1, 1, 2])) == pytest.approx(1.0, abs=1e-6) and 0 < a < 1


def test_plan_caps_what_is_too_small():
    plan = mixing.plan_mixture([("a", 0.5, 2), ("b", 0.3, 1), ("gone", 0.2, 3)], {"a": (5, 100), "b": (9, 900)}, 1000)
    assert [(x.source, x.capped, x.budget) for x in plan] == [("a", True, 200), ("b", False, 300), ("gone", True, 0)]
    assert [x.capped for x in mixing.plan_mixture([("a", 0.5, 2)], {"a": (1, 250)}, 1000)] == [False]
    assert mixing.plan_mixture([("a", 1.0, 2)], {}, 0)[0].budget == 0


def level(target, most):
    """Brute force: the scale at which min(most, scale * target) adds up to 1."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(m, mid * t) for m, t in zip(most, target)) < 1 else (low, mid)
    return [min(m, high * t) for m, t in zip(most, target)]


def test_way_to_the_target_with_limits():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        q, t = [rng.random() + 0.01 for _ in range(n)], [rng.random() + 0.01 for _ in range(n)]
        q, t = [x / sum(q) for x in q], [x / sum(t) for x in t]
        most = [x * rng.choice([0.5, 1, 2, 3, 8]) for x in q]
        path = mixing.follow(q, t, most, True)
        assert path.weights == pytest.approx(level(t, most), abs=1e-7)
        assert all(path.weights[i] == most[i] and 0 <= a <= 1 for i, a in path.frozen.items())
        alone = mixing.follow(q, t, most, False)
        assert alone.weights == pytest.approx([min(m, x) for m, x in zip(most, t)], abs=1e-7)
        assert {i for i in range(n) if most[i] < t[i] * (1 - 1e-9)} <= set(alone.frozen) <= set(range(n))


def test_plan_that_fills_the_total():
    sizes = {"a": (5, 100), "b": (9, 900), "c": (1, 50)}
    plan = mixing.plan_mixture([("a", 0.5, 2), ("b", 0.25, 9), ("gone", 0.15, 3), ("c", 0.1, None)], sizes, 1050, fill=True)
    assert [(x.source, x.frozen, x.capped, x.budget) for x in plan] == [("a", True, True, 200), ("b", False, False, 607), ("gone", True, True, 0), ("c", False, False, 243)]
    pushed = mixing.plan_mixture([("a", 0.4, 1), ("b", 0.6, 1)], {"a": (5, 300), "b": (9, 620)}, 1000, fill=True)
    assert [(x.frozen, x.capped, x.budget) for x in pushed] == [(True, True, 300), (True, False, 620)]
    assert mixing.plan_mixture([("a", None, 2), ("b", 1.0, None)], {"a": (5, 300), "b": (9, 620)}, 1000, fill=True)[0].budget == 0
    assert mixing.plan_mixture([("a", 1.0, 2)], {}, 0, fill=True)[0].budget == 0


def test_mixture_does_not_follow_the_files(spark):
    rng = random.Random(5)
    rows = [(i % 90, "a", rng.randrange(1, 9)) for i in range(300)]
    one = spark.createDataFrame(rows, "doc long, src string, n long").repartition(1)
    budgets = [("a", sum(r[2] for r in rows), 500, 3)]
    got = [sorted(map(tuple, mixing.realise(df, "doc", "src", "n", budgets, block=16).collect())) for df in (one, one.repartition(7).orderBy(F.desc("n")))]
    assert got[0] == got[1]


def rows_of(rng, n):
    return [(i, rng.choice("ab"), rng.randrange(0, 50)) for i in range(n)]


@pytest.mark.parametrize("block", [8, 4096])
def test_budgets_are_met(spark, block):
    rng = random.Random(3)
    rows = rows_of(rng, 400) + [(7, "a", 10)] * 50 + [(None, "b", 5), (8, None, 5), (9, "c", 5), (10, "a", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc long, src string, n long, block int, id string")
    size = Counter()
    for _, s, n in rows:
        size[s] += n or 0
    budgets = [("a", size["a"], int(size["a"] * 2.4), 3), ("b", size["b"], size["b"] // 3, 1), ("none", 0, 0, 4)]
    out = mixing.realise(df, "doc", "src", "n", budgets, block=block).collect()
    for s, _, budget, most in budgets[:2]:
        got = sum(r.size * r.repeats for r in out if r.source == s)
        assert budget - 50 < got <= budget
        assert all(1 <= r.repeats <= most for r in out if r.source == s)
    assert sum(r.source == "a" for r in out) == sum(s == "a" for _, s, _ in rows)
    assert {r.source for r in out} == {"a", "b"}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc long, src string, n long")
    assert mixing.realise(df, "doc", "src", "n", [("a", 0, 0, 1)]).collect() == []
    assert mixing.source_sizes(df, "src", "n").collect() == []

"""Hierarchies against a walk up each node."""

import random

import pytest

from meshwright.operators.forest import WeightedForest, circular_descendants, descendants, hierarchy

SCHEMA = "snapshot int, src string, dst_id string, relation string, depth int, id string, path string"


def walk(links):
    up = {}
    for s, c, p in links:
        if None not in (s, c, p):
            up[(s, c)] = min(p, up.get((s, c), p))
    out = {}
    for s, x in {k for k in up} | {(k[0], p) for k, p in up.items()}:
        way, at = [x], x
        while (s, at) in up:
            at = up[(s, at)]
            if at in way:
                break
            way.append(at)
        else:
            out[(s, x)] = (at, len(way) - 1, way[1:])
            continue
        out[(s, x)] = (min(way[way.index(at):]), -1, None)
    return out


def run(spark, links, **options):
    df = spark.createDataFrame([(s, c, p, "x", 1, "clash", None) for s, c, p in links], SCHEMA)
    rows = hierarchy(df, "snapshot", "src", "dst_id", paths=True, **options).nodes.collect()
    assert len({(r.snapshot, r.id) for r in rows}) == len(rows)
    return {(r.snapshot, r.id): (r.root_id, r.depth, r.path) for r in rows}


def random_links(seed, n):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    out = []
    for s in (1, 2):
        for i, c in enumerate(ids):
            kind = rng.random()
            if kind < 0.7 and i:
                out.append((s, c, ids[rng.randrange(max(0, i - 3), i)]))
            elif kind < 0.78:
                out.append((s, c, rng.choice(ids)))
    return out + out[:5]


@pytest.mark.parametrize("per", [3, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_walk(spark, seed, per):
    links = random_links(seed, 40)
    assert run(spark, links, links_per_partition=per) == walk(links)


def test_long_chain_and_circles_across_partitions(spark):
    links = [(1, f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    links += [(1, f"r{i}", f"r{(i + 1) % 13}") for i in range(13)] + [(1, "tail2", "tail1"), (1, "tail1", "r5"), (1, "leaf", "tail2")]
    links += [(1, "self", "self"), (1, "below", "self")]
    assert run(spark, links, links_per_partition=7) == walk(links)


def test_nulls_duplicates_and_nothing(spark):
    links = [(None, "a", "b"), (1, None, "b"), (1, "a", None), (1, "a", "b"), (1, "a", "b"), (1, "", "a")]
    assert run(spark, links) == walk(links)
    assert run(spark, []) == {}
    assert run(spark, [(None, None, None)]) == {}


def test_hot_base(spark):
    links = [(1, f"k{i}", "base") for i in range(500)] + [(1, "base", "top")] + [(1, f"z{i}", f"k{i % 7}") for i in range(300)]
    assert run(spark, links, links_per_partition=2) == walk(links)


def test_descendants(spark):
    links = random_links(3, 30)
    df = spark.createDataFrame(links, "snapshot int, src string, dst_id string")
    got = {tuple(r) for r in descendants(hierarchy(df, "snapshot", "src", "dst_id", paths=True).nodes, "snapshot").collect()}
    want = {(s, a, x, i + 1) for (s, x), (_, _, way) in walk(links).items() for i, a in enumerate(way or [])}
    assert got == want


@pytest.mark.parametrize("per", [3, 10_000])
def test_circular_descendants(spark, per):
    links = random_links(3, 30) + [(3, "D", "A"), (3, "A", "B"), (3, "B", "C"), (3, "C", "B"), (3, "self", "self"), (3, "below", "self"), (3, "lone", "top")]
    links += [(4, f"r{i:02d}", f"r{(i + 1) % 11:02d}") for i in range(11)] + [(4, "leaf", "tail"), (4, "tail", "r05")]
    up, want = {(s, c): p for s, c, p in reversed(links)}, set()
    for (s, x), (_, depth, _) in walk(links).items():
        way, at = [x], x
        while depth < 0 and up[(s, at)] not in way:
            at = up[(s, at)]
            way.append(at)
        want |= {(s, a, x, i, up[(s, at)] == x) for i, a in enumerate(way) if i}
    df = spark.createDataFrame(links, "snapshot int, src string, dst_id string")
    found = hierarchy(df, "snapshot", "src", "dst_id", paths=True, links_per_partition=per)
    got = [tuple(r) for r in circular_descendants(found, "snapshot", "src", "dst_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(3, "A", "D", 1, False), (3, "B", "D", 2, False), (3, "C", "D", 3, False), (3, "C", "B", 1, True)} <= want
    assert not {x[:3] for x in got} & {tuple(r)[:3] for r in descendants(found.nodes, "snapshot").collect()}
    assert circular_descendants(hierarchy(df.limit(0), "snapshot", "src", "dst_id"), "snapshot", "src", "dst_id").collect() == []


def test_offsets():
    f = WeightedForest()
    for c, p in [("d", "c"), ("b", "a"), ("c", "b"), ("a", "top")]:
        f.add(c, p)
    assert f.find("d") == ("top", 4, "a") and f.find("d") == ("top", 4, "a")
    f.add("top", "c")
    assert f.circles == {"top": "a"}


def test_levels_that_do_not_shrink_are_doubled(spark):
    # more links than a task may hold at every level: the last of them can't be folded into one
    links = random_links(5, 60)
    assert run(spark, links, links_per_partition=1) == walk(links)


def test_links_that_stand_for_several():
    f = WeightedForest()
    f.add("a", "d", 3, "a", ["b", "c", "d"])
    f.add("d", "f", 2, "d", ["e", "f"])
    f.close("x", "w")
    f.add("y", "x", 1, "y", ["x"])
    assert f.find("a") == ("f", 5, "a") and f.walk("a", "f") == ["b", "c", "d", "e", "f"]
    assert f.find("y")[0] == "x" and f.circles["x"] == "w"
    f.add("f", "a", 1, "0", ["a"])
    assert f.circles["f"] == "0"


def test_lookup_takes_hot_keys_apart(spark, monkeypatch):
    from meshwright.operators import lookups

    monkeypatch.setattr(lookups, "FEW", 5)
    rows = [(1, "hot", i) for i in range(40)] + [(1, f"k{i}", i) for i in range(20)] + [(2, None, 0), (2, "hot", 1), (1, "gone", 1)] + [(3, "lost", i) for i in range(30)]
    left = spark.createDataFrame(rows, "g int, k string, v int")
    right = spark.createDataFrame([(1, "hot", "h"), (2, "hot", "h2"), *[(1, f"k{i}", f"x{i}") for i in range(25)]], "g int, k string, name string")
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["g", "k"], how).collect()))
        assert sorted(map(str, lookups.look_up(left, right, ["g", "k"], how).collect())) == want

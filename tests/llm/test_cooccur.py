import random
from collections import Counter
from itertools import combinations

import numpy as np

from meshwright.llm.cooccur import cooccurrence, gram_block


def test_gram_block_is_the_upper_triangle():
    rng = np.random.default_rng(1)
    x = rng.random((30, 12)) < 0.4
    flat, offsets = np.concatenate([np.flatnonzero(r) for r in x]), np.concatenate([[0], np.cumsum(x.sum(1))])
    for stretch in (1, 7, 10_000):
        got = Counter()
        for a, b, n in gram_block(flat, offsets, stretch):
            got.update(dict(zip(zip(a.tolist(), b.tolist()), n.tolist())))
        gram = x.T.astype(int) @ x.astype(int)
        assert got == Counter({(i, j): int(gram[i, j]) for i in range(12) for j in range(i + 1, 12) if gram[i, j]})


def brute(rows, n, together, lift):
    sets = {}
    for r, i in rows:
        if None not in (r, i):
            sets.setdefault(r, set()).add(i)
    one = Counter(i for s in sets.values() for i in s)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    return {(a, b, c, one[a], one[b]) for (a, b), c in two.items() if c >= together and c * n >= lift * one[a] * one[b]}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for r in range(150):
        rows += [(f"r{r}", "hot")] * (rng.random() < 0.7) + [(f"r{r}", f"i{rng.randrange(9) + (r % 5) * 6}") for _ in range(rng.randrange(7))]
    rows += [("r1", None), (None, "i1"), ("r2", ""), ("r3", ""), *rows[:20]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "t string, f string, n_ab int, item string")
    for together, lift in ((1, 0), (3, 2), (2, 3)):
        got = [tuple(r)[:5] for r in cooccurrence(df, "t", "f", 160, min_together=together, min_lift=lift).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 160, together, lift)
    assert cooccurrence(df.limit(0), "t", "f", 0).collect() == []


def test_one_long_record(spark):
    df = spark.createDataFrame([("r", f"i{k}") for k in range(300)] * 2, "t string, f string")
    assert cooccurrence(df, "t", "f", 1).count() == 300 * 299 // 2

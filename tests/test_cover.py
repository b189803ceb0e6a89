import random
import threading
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from meshwright.operators import churn, cover, kernels, linalg, similar
from meshwright.plans import coverops


def coverage(spark, rows):
    return spark.createDataFrame([(i, 1, {t: fs}, "x") for i, (t, fs) in enumerate(rows)], "artifact_id long, snapshot int, tests map<string, array<string>>, test_id string")


ROWS = [("f.py::t[1]|run", ["a", "b", None, "a"]), ("f.py::t[2]", ["c"]), ("f.py::C::m", ["a", "b", "c"]), ("e.py::e", []), ("e.py::n", None), ("g.py::g", ["a", "b", "c"]), ("g.py::h", ["d"])]


def test_normalised_runs(spark):
    cov = coverage(spark, ROWS)
    got = {tuple(r) for r in cover.runs(cov).collect()}
    assert got == {("f.py::t", x) for x in "abc"} | {("f.py::C.m", x) for x in "abc"} | {("g.py::g", x) for x in "abc"} | {("g.py::h", "d")}
    assert {r.test_id for r in cover.all_tests(cov).collect()} == {"f.py::t", "f.py::C.m", "e.py::e", "e.py::n", "g.py::g", "g.py::h"}
    assert [tuple(r) for r in cover.redundant_groups(cover.runs(cov)).collect()] == [("f.py::C.m", 3, 3)]
    assert cover.runs(cov.limit(0)).collect() == []


def test_reconcile_needs_one_aligned_node(spark):
    nodes = spark.createDataFrame([("src/a/x.py::f",), ("tools/u.py::g",), ("p/d.py::h",), ("q/d.py::h",)], "id string")
    pairs = spark.createDataFrame([("t", x) for x in ("ci/src/a/x.py::f", "a/x.py::f", "src/u.py::g", "z/p/d.py::h", "src/a/x.py::f")], "test_id string, function_id string")
    assert {r.function_id for r in cover.reconcile(pairs, nodes).collect()} == {"src/a/x.py::f", "src/u.py::g", "z/p/d.py::h"}


def random_pairs(seed=1, tests=30, fns=14):
    rng = random.Random(seed)
    return sorted({(f"t{rng.randrange(tests):02d}", f"f{min(rng.randrange(fns), rng.randrange(fns)):02d}") for _ in range(150)})


def by_test(pairs):
    out = {}
    for t, f in pairs:
        out.setdefault(t, set()).add(f)
    return out


def test_greedy_order_is_the_sequential_one(spark):
    for seed in (1, 2):
        pairs = random_pairs(seed)
        sets, done, want = by_test(pairs), set(), []
        left = sorted(sets)
        while left:
            best = max(left, key=lambda t: (len(sets[t] - done), [-ord(c) for c in t]))
            want.append((best, len(sets[best] - done)))
            done |= sets[best]
            left.remove(best)
        df = spark.createDataFrame(pairs, "test_id string, function_id string")
        got = cover.greedy_order(df, df.select("test_id").distinct()).collect()
        assert sorted(((r.test_id, r.gain) for r in got), key=lambda x: (-x[1], x[0])) == sorted(want, key=lambda x: (-x[1], x[0]))
        assert [g for _, g in want] == sorted((g for _, g in want), reverse=True)


def test_coactivation_and_coupling(spark):
    pairs = random_pairs(3)
    sets, n = by_test(pairs), Counter(f for _, f in pairs)
    shared = Counter(p for s in sets.values() for p in combinations(sorted(s), 2) if len(s) <= 9)
    want = {(a, b): c for (a, b), c in shared.items() if c >= 3}
    df = spark.createDataFrame(pairs, "test_id string, function_id string")
    got = {(r.a, r.b): (r.shared, r.score) for r in cover.coactivation(df, cap=9).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(abs(v[1] - v[0] / (n[a] * n[b]) ** 0.5) < 1e-4 for (a, b), v in got.items())
    edges = spark.createDataFrame([("f00", "f01", "CALLS"), ("z", "f00", "CALLS"), ("z", "f02", "CALLS"), ("y", "f02", "CALLS")], "src string, dst_id string, relation string")
    found = cover.hidden_coupling(df, edges, min_shared=2, min_score=0.1).collect()
    assert ("f00", "f01") not in {(r.a, r.b) for r in found}
    assert {tuple(r.common_callers) for r in found if (r.a, r.b) == ("f00", "f02")} <= {("z",)}
    near = {r.function_id: r.shared for r in cover.co_functions(df, "f00").collect()}
    assert near == {g: sum("f00" in s and g in s for s in sets.values()) for g in n if g != "f00" and any("f00" in s and g in s for s in sets.values())}
    assert cover.co_functions(df, "never").collect() == []


def test_wide_tests_pair_their_functions(spark):
    wide = [(t, f"g{i:03d}") for t in ("w1", "w2", "w3") for i in range(450)]
    found = cover.coactivation(spark.createDataFrame(wide, "test_id string, function_id string"))
    assert found.count() == 450 * 449 // 2 and found.where("a >= b OR shared <> 3 OR score <> 1").isEmpty()
    pairs = random_pairs(3)
    shared = Counter(p for s in by_test(pairs).values() for p in combinations(sorted(s), 2))
    got = cover.coactivation(spark.createDataFrame(pairs, "test_id string, function_id string"), block=3).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.shared for r in got} == {p: c for p, c in shared.items() if c >= 3}


def planted(tests=60):
    rng = random.Random(5)
    out = set()
    for i in range(tests):
        own = ["parse", "lex", "token"] if i % 3 else ["render", "emit", "format"]
        out |= {(f"t{i:02d}", f) for f in own} | ({(f"t{i:02d}", f"x{rng.randrange(6)}")} if rng.random() < 0.4 else set())
    return sorted(out)


@pytest.mark.parametrize("local", [0, 10_000])
def test_modes_equal_a_dense_decomposition(spark, local):
    pairs = planted()
    tests, fns = sorted({t for t, _ in pairs}), sorted({f for _, f in pairs})
    m = np.zeros((len(tests) + 4, len(fns)))
    for t, f in pairs:
        m[tests.index(t), fns.index(f)] = 1
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    df = spark.createDataFrame(pairs, "test_id string, function_id string")
    found = linalg.modes(df, len(m), k=5, spare=4, rounds=8, local_pairs=local)
    assert found.singular[:3] == pytest.approx(s[:3], rel=1e-3) and found.total == pytest.approx((s**2).sum())
    load = {r.function_id: r.v0 for r in found.functions.collect()}
    assert np.abs([load[f] for f in fns]) == pytest.approx(np.abs(vt[0]), abs=1e-3)
    k90, _ = found.dimensionality
    assert k90 == int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
    near = linalg.neighbours(found, "lex").orderBy("score", ascending=False).collect()
    assert {r.function_id for r in near[:2]} == {"parse", "token"} and linalg.neighbours(found, "never").collect() == []
    assert all(r.kind in ("typical", "unique", "smoke") and 0 <= r.residual <= 1 for r in linalg.outliers(found, df).collect())


@pytest.mark.parametrize("local", [0, 10_000])
def test_two_cliques_are_told_apart(spark, local):
    nodes = [f"{c}{i}" for c in "ab" for i in range(6)]
    pairs = [(x, y) for x in nodes for y in nodes if x != y and x[0] == y[0]] + [("a0", "b0"), ("b0", "a0")]
    ids = spark.createDataFrame([(n,) for n in nodes], "id string")
    values, vectors = linalg.spectral_embedding(ids, spark.createDataFrame(pairs, "s string, d string"), k=4, rounds=30, local_edges=local)
    assert abs(values[0]) < 1e-3 and values[1] < 0.2
    groups = {}
    for r in similar.cluster(vectors, ["v0", "v1"], 2).collect():
        groups.setdefault(r.cluster, set()).add(r.id[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]


def test_size_does_not_change_modes_and_embedding(spark):
    ring = [f"n{i:02d}" for i in range(40)]
    pairs = [(a, b) for i, x in enumerate(ring) for y in (ring[i - 1], ring[i - 2 - i % 3]) for a, b in ((x, y), (y, x))]
    ids, adj = spark.createDataFrame([(x,) for x in ring], "id string"), spark.createDataFrame(sorted(set(pairs)), "s string, d string")
    rng = random.Random(9)
    ran = sorted({(f"t{rng.randrange(80):02d}", f"f{int(30 * rng.random() ** 1.5):02d}") for _ in range(500)})
    df = spark.createDataFrame(ran, "test_id string, function_id string")
    for make in (
        lambda n: linalg.spectral_embedding(ids, adj, k=4, spare=4, rounds=10, local_edges=n),
        lambda n: (lambda found: (found.singular, found.functions))(linalg.modes(df, 80, k=3, spare=4, rounds=4, local_pairs=n)),
    ):
        (v0, far), (v1, near) = make(0), make(10_000)
        assert v0 == pytest.approx(v1, rel=1e-6, abs=1e-9)
        assert {r[0]: list(r[1:]) for r in far.collect()} == {r[0]: pytest.approx(list(r[1:]), abs=1e-5) for r in near.collect()}
    flat = spark.createDataFrame([(f"t{i}", f) for i in range(5) for f in "abc"], "test_id string, function_id string")
    assert all(linalg.modes(flat, 5, k=2, rounds=4, local_pairs=n).singular == pytest.approx([0, 0], abs=1e-6) for n in (0, 100))


def test_churn_percentiles_and_hotspots(spark):
    commits = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", "a"), ("2", "b"), ("3", "a"), ("4", None), (None, "a"), *[("big", f"z{i}") for i in range(40)]], "commit_id string, file string")
    assert {r.file: r.churn for r in churn.churn(commits).collect() if r.file in "ab"} == {"a": 3, "b": 2}
    assert [tuple(r) for r in churn.cochange(commits).collect()] == [("a", "b", 2)]
    values = spark.createDataFrame([("p", 1.0), ("q", 1.0), ("r", 5.0), ("s", 1.0)], "file string, value double")
    assert {r.file: r.percentile for r in churn.tied_percentiles(values, "value").collect()} == {"p": 0.5, "q": 0.5, "s": 0.5, "r": 1.0}
    other = spark.createDataFrame([("r", 1.0), ("lone", 2.0)], "file string, value double")
    assert [(r.file, r.n_lenses, r.score) for r in churn.converge({"x": values, "y": other}).collect()] == [("r", 2, round((1.0 * 0.5) ** 0.5, 4))]
    hot = churn.hotspots(churn.churn(commits), spark.createDataFrame([("a", 2.0), ("b", 0.5), ("z1", 0.0)], "file string, mass double"))
    assert {r.file: (r.risk, r.urgency) for r in hot.collect()} == {"a": (6.0, "orange"), "b": (1.0, "green")}
    assert churn.cochange(commits.limit(0)).collect() == []


def test_nearest_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 5))
    x[3] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None)]
    vectors = similar.normalised(spark.createDataFrame(rows, "vec_id long, e array<float>"), "vec_id", "e")
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    got = similar.nearest(vectors, vectors.where("id % 20 = 0"), 4, block=16).collect()
    for q in range(0, 90, 20):
        score = unit @ unit[q]
        want = [i for i in np.argsort(-score) if i != q and score[i] > 0][:4]
        assert [r.id for r in sorted(got, key=lambda r: r.place) if r["query"] == q] == want


def test_close_eigenvalues_take_few_products():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(600, 600)))[0]
    values = np.sort(np.concatenate([[9.0, 8.0], 5 * (1 - np.linspace(0, 1, 598) ** 0.6)]))[::-1]
    times = 0

    def apply(v):
        nonlocal times
        times += 1
        assert times < 200
        return turn @ (values[:, None] * (turn.T @ v))

    found, vectors = kernels._leading(apply, rng.normal(size=(600, 6)), 5, 10, 0.0)
    assert found == pytest.approx(values[:5], rel=1e-4)
    assert (np.linalg.norm(turn @ (values[:, None] * (turn.T @ vectors)) - vectors * found, axis=0) <= 1.01e-3 * found).all()


def test_subsystems_of_snapshots_are_found_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(coverops, "load_graph", lambda *_: None)
    monkeypatch.setattr(coverops, "periods", lambda *_: [1, 2])
    monkeypatch.setattr(coverops, "subsystems", lambda _, p: met.wait() >= 0 and spark.range(p, p + 1))
    assert [r.id for r in coverops.find_subsystems(spark, "").collect()] == [1, 2]


def test_close_modes_take_few_products_and_are_right(monkeypatch):
    rng = np.random.default_rng(5)
    ones = np.unique(rng.integers(0, [500, 400], size=(5000, 2)), axis=0)
    dense = np.zeros((510, 400))
    dense[ones[:, 0], ones[:, 1]] = 1
    start = pd.DataFrame(rng.uniform(-1, 1, (400, 8)), columns=[f"v{i}" for i in range(8)]).assign(function_id=range(400), all=1)
    times, plain = [], kernels.Sparse.times
    monkeypatch.setattr(kernels.Sparse, "times", lambda m, v: times.append(1) or plain(m, v))
    out = kernels.modes(pd.DataFrame(ones, columns=["test_id", "function_id"]), start, 510, 5, 10, 0.0)
    values = out[out["kind"] == "s"]["v"].iloc[0]
    _, s, right = np.linalg.svd(dense - dense.mean(0))
    assert len(times) < 50 and values == pytest.approx(s[:5] ** 2, rel=1e-8)
    assert np.abs((np.stack(out[out["kind"] == "f"]["v"].to_numpy()) * right[:5].T).sum(0)) == pytest.approx(1, abs=1e-6)


def test_products_by_lines_are_the_dense_ones(monkeypatch):
    rng = np.random.default_rng(3)
    ones = np.unique(np.vstack([rng.integers(0, [900, 300], size=(4000, 2)), np.column_stack([np.arange(700), np.full(700, 7)])]), axis=0)
    weight = rng.uniform(size=len(ones))
    takes, take = [], np.take
    monkeypatch.setattr(np, "take", lambda *a, **k: takes.append(1) or take(*a, **k))
    for w in (None, weight):
        m, dense = kernels.Sparse(ones[:, 0], ones[:, 1], (910, 310), w), np.zeros((910, 310))
        dense[ones[:, 0], ones[:, 1]] = 1 if w is None else w
        for block, got, want in ((rng.normal(size=(310, 12)), m.times, dense), (rng.normal(size=(910, 12)), m.transposed_times, dense.T)):
            takes.clear()
            assert np.allclose(got(block), want @ block)
            assert 0 < len(takes) < 64


def test_blocks_are_made_orthonormal():
    rng = np.random.default_rng(4)
    near = rng.normal(size=(500, 6))
    near[:, 5] = near[:, 4] + 1e-9 * near[:, 5]
    for block in (rng.normal(size=(500, 6)) * 10.0 ** np.arange(-6, 6, 2), near, np.zeros((500, 6))):
        basis, upper = kernels._orthonormal(block)
        assert np.allclose(basis.T @ basis, np.eye(6), atol=1e-10) and np.allclose(basis @ upper, block, rtol=1e-10, atol=1e-12)


def test_modes_know_the_size_of_each_test(spark):
    pairs = planted()
    df = spark.createDataFrame(pairs, "test_id string, function_id string")
    n_tests = len({t for t, _ in pairs}) + 4
    found = linalg.modes(df, n_tests, k=3, spare=4, rounds=4)
    mean = {f: sum(g == f for _, g in pairs) / n_tests for _, f in pairs}
    want = {t: (sum(u == t for u, _ in pairs), pytest.approx(sum(mean[f] for u, f in pairs if u == t))) for t, _ in pairs}
    assert {r.test_id: (r.n, r.m) for r in found.tests.collect()} == want
    plan = linalg.outliers(found, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "pairs" not in plan and "Generate" not in plan


def covered(spark, tmp_path):
    """A folder with a coverage table of ``planted``: phases and parameters, copies, nulls, a test without functions."""
    ran = {}
    for t, f in planted():
        ran.setdefault(f"tests/test_x.py::{t}", []).append(f)
    one = {f"{t}[a-1]|run": [*fs, None, fs[0]] for t, fs in ran.items()}
    two = {t: fs[:1] for t, fs in list(ran.items())[:5]} | {"tests/test_x.py::idle": [], "tests/test_x.py::none": None, "tests/test_x.py::void": [None]}
    spark.createDataFrame([(1, 1, one), (2, 2, two), (3, 2, None)], "artifact_id long, snapshot int, tests map<string, array<string>>").write.parquet(f"{tmp_path}/coverage.parquet")
    return str(tmp_path), ran


def test_outlier_tests_need_no_pairs_of_ids(spark, tmp_path, monkeypatch):
    d, ran = covered(spark, tmp_path)
    names = sorted({f for fs in ran.values() for f in fs})
    dense = np.array([[f in fs for f in names] for fs in ran.values()] + [[False] * len(names)] * 3, float)
    centred = dense - dense.mean(0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    rest = 1 - ((u * s)[:, : coverops.MODES] ** 2).sum(1) / (centred**2).sum(1)
    want = {t: (rest[i], dense[i].mean()) for i, t in enumerate(ran)}
    monkeypatch.setattr(coverops, "_pairs", lambda *_: pytest.fail("pairs of ids are laid out"))
    got = coverops.find_outlier_tests(spark, d).collect()
    assert len(got) == 20 and all((r.residual, r.breadth) == pytest.approx(want[r.test_id], abs=2e-3) for r in got)
    codes = np.array([0, 1, -1, 2**63 - 1, -(2**63), 123456789012345])
    seen = spark.createDataFrame([(int(c),) for c in codes], "c long").select("c", *[linalg._unit("c", i).alias(f"u{i}") for i in range(3)]).collect()
    assert [list(r)[1:] for r in seen] == [pytest.approx([kernels.hash_unit(np.array([r.c]), i)[0] for i in range(3)], abs=1e-12) for r in seen]


def test_profiles_are_read_as_a_stream():
    rng = np.random.default_rng(8)
    ran = {f"t{i:03d}": sorted({int(x) for x in rng.integers(0, 90, rng.integers(1, 9))}) for i in rng.permutation(200)}
    tables = pa.table({"test_id": list(ran), "codes": pa.array(list(ran.values()), pa.list_(pa.int64()))})
    p = kernels.Profiles(iter(tables.to_batches(max_chunksize=7)))
    assert p.tests.to_pylist() == sorted(ran) and [sorted(x.tolist()) for x in np.split(p.functions[p.f], np.cumsum(p.counts)[:-1])] == [ran[t] for t in sorted(ran)]
    dense = np.array([[c in ran[t] for c in range(90)] for t in sorted(ran)] + [[False] * 90] * 3, float)
    rows = [r for b in kernels.profile_modes(iter(tables.to_batches(max_chunksize=7)), 203, 5, 4, 10) for r in b.to_pylist()]
    u, s, vt = np.linalg.svd(dense - dense.mean(0), full_matrices=False)
    last = rows[-1]
    assert last["kind"] == "s" and [last[f"v{i}"] for i in range(5)] == pytest.approx(s[:5] ** 2, rel=1e-6)
    assert (last["n"], last["m"]) == (pytest.approx(dense.mean(0).sum()), pytest.approx((dense.mean(0) ** 2).sum()))
    at = {r["test_id"]: r for r in rows if r["kind"] == "t"}
    assert np.abs([at[t]["v0"] for t in sorted(ran)]) == pytest.approx(np.abs(u[:200, 0] * s[0]), abs=1e-3)
    assert all(at[t]["n"] == len(fs) and at[t]["m"] == pytest.approx(dense.mean(0)[fs].sum()) for t, fs in ran.items())


def test_summary_of_modes_needs_no_pairs_of_ids(spark, tmp_path, monkeypatch):
    d, ran = covered(spark, tmp_path)
    monkeypatch.setattr(coverops, "_pairs", lambda *_: pytest.fail("pairs of ids are laid out"))
    monkeypatch.setattr(cover, "redundant_groups", lambda *_: pytest.fail("sets of ids are laid out"))
    (row,) = coverops.mode_summary(spark, d).collect()
    n, many, twins = len(ran) + 3, Counter(f for fs in ran.values() for f in fs), Counter(frozenset(fs) for fs in ran.values())
    energy = round(sum(k - k * k / n for k in many.values()), 4)
    assert tuple(row) == (n, len(many), pytest.approx(energy, abs=1e-3), True, sum(k * (k - 1) // 2 for k in twins.values()))


def test_minimal_set_of_profiles_is_the_sequential_one(spark, tmp_path, monkeypatch):
    d, ran = covered(spark, tmp_path)
    wide = {f"t{i}": [int(x) for x in np.random.default_rng(i).choice(60, 1 + i % 7, replace=False)] for i in range(150)}
    for sets in (ran, wide):
        left, want = {t: set(fs) for t, fs in sets.items()}, {}
        while any(left.values()):
            best = min(left, key=lambda t: (-len(left[t]), t))
            want[best], new = len(left[best]), set(left[best])
            left = {t: fs - new for t, fs in left.items()}
        codes = {f: i for i, f in enumerate(sorted({f for fs in sets.values() for f in fs}))}
        rows = spark.createDataFrame([(t, [codes[f] for f in fs]) for t, fs in sets.items()], "test_id string, codes array<long>").repartition(3)
        assert {r.test_id: r.gain for r in cover.greedy_profiles(rows).collect()} == want
        if sets is ran:
            needed = len(want)
    monkeypatch.setattr(cover, "greedy_order", lambda *_: pytest.fail("rounds of joins"))
    (row,) = coverops.modes_overview(spark, d).collect()
    assert row.minimal_set == needed and row.dimensionality > 0

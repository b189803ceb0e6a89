"""Leading modes of large sparse matrices by subspace iteration.

A block of vectors is a table with one column per vector. A product with the matrix is a join and
a sum per column, all in the JVM; what reaches the driver are k x k products of the block with
itself. Centring is applied to the products, so the matrix stays sparse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators import kernels
from meshwright.operators.kernels import LOCAL_ONES
from meshwright.runtime import Workspace


def _columns(k: int) -> list[str]:
    return [f"v{i}" for i in range(k)]


def gram(block: DataFrame, k: int) -> np.ndarray:
    names = _columns(k)
    cells = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    row = block.agg(*cells).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def combine(block: DataFrame, keys: list[str], by: np.ndarray) -> DataFrame:
    """The block times a small matrix."""
    old = _columns(by.shape[0])

    def mixed(j: int) -> Column:
        total = F.lit(0.0)
        for i, name in enumerate(old):
            total = total + F.col(name) * F.lit(float(by[i, j]))
        return total.alias(f"v{j}")

    return block.select(*keys, *[mixed(j) for j in range(by.shape[1])])


def _whiten(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from large to small, matrix that makes a block with this Gram matrix orthonormal)."""
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    keep = values > max(values[0], 1e-300) * 1e-14
    scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)
    return values, vectors * scale


def _unit(key: str | Column, i: int, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 1000 + i), key), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1


def start_block(keys: DataFrame, key: str, k: int, seed: int = 1, of: Column | None = None) -> DataFrame:
    """Pseudo-random vectors that follow from the keys, or from ``of`` them, alone."""
    return keys.select(key, *[_unit(key if of is None else of, i, seed).alias(f"v{i}") for i in range(k)])


def subspace(
    ws: Workspace, block: DataFrame, key: str, k: int, step: Callable[[DataFrame], DataFrame], rounds: int, *, keep: int, least: float = 0.0, of: Column | None = None
) -> tuple[np.ndarray, DataFrame]:
    """The ``keep`` leading eigenvalues and vectors of the symmetric positive operator that ``step``
    applies to blocks of ``k``, iterated until they are settled (``kernels.ritz``), which is looked at
    every ``rounds`` rounds. A vector's sign is that of its product with the first of ``start_block``."""
    cur = ws.write(block, "block")
    cur = combine(cur, [key], _whiten(gram(cur, k))[1])
    done, held = 0, ()
    while True:
        cur = ws.write(cur, "basis")
        ws.drop(*held)
        nxt, done = ws.write(step(cur), "product"), done + 1
        g = gram(nxt, k)
        if done % rounds == 0:
            both = cur.join(nxt.withColumnsRenamed({f"v{j}": f"w{j}" for j in range(k)}), key)
            row = both.agg(*[F.sum(F.col(f"v{a}") * F.col(f"w{b}")).alias(f"c{a}_{b}") for a in range(k) for b in range(k)]).first()
            small = np.array([[row[f"c{a}_{b}"] or 0.0 for b in range(k)] for a in range(k)])
            values, turn, settled = kernels.ritz(small, g, keep, least)
            if settled:
                vectors = ws.write(combine(cur, [key], turn[:, :keep]), "vectors")
                lean = vectors.agg(*[F.sum(F.col(c) * _unit(key if of is None else of, 0)).alias(c) for c in _columns(keep)]).first()
                signs = np.where(np.array([lean[c] or 0.0 for c in _columns(keep)]) < 0, -1.0, 1.0)
                return values[:keep], vectors.select(key, *[(F.col(c) * F.lit(float(x))).alias(c) for c, x in zip(_columns(keep), signs)])
        held = (cur, nxt)
        cur = combine(nxt, [key], _whiten(g)[1])


@dataclass
class Modes:
    """``energies``: share of the total per mode; ``functions``: (function_id, v0..) unit loadings;
    ``tests``: (test_id, v0.., n, m) the tests' coordinates, u times s, the number of their functions and
    the sum of these functions' means; ``loads``: ``functions`` by any key; ``names``: (function_id) of the
    ``n_functions``; ``ones`` of the matrix; ``squares``: sum of the functions' squared means; ``total``: its energy."""

    energies: list[float]
    singular: np.ndarray
    functions: DataFrame
    tests: DataFrame
    loads: DataFrame
    names: DataFrame
    n_tests: int
    n_functions: int
    ones: int
    squares: float
    total: float

    @property
    def dimensionality(self) -> tuple[int, bool]:
        """Modes up to 90 % of the energy; True if even all that were computed hold less."""
        cum = np.cumsum(self.energies)
        if not len(cum) or self.total <= 0:
            return 0, False
        return (int(np.searchsorted(cum, 0.9)) + 1, False) if cum[-1] >= 0.9 else (len(cum), True)


def _in_one_task(ws: Workspace, rows: DataFrame, start: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> tuple[np.ndarray, DataFrame]:
    """The values of a kernel over all rows and a start block, and its rows (kind, code, v). Rows are two
    columns of numbers, the block one and its vectors."""

    def run(ones: pa.Table, block: pa.Table) -> pa.Table:
        done = kernel(*(x.drop_columns("all").to_pandas(split_blocks=True) for x in (ones, block)))
        return pa.table({"kind": pa.array(done["kind"], pa.string()), "code": pa.array(done["key"], pa.int64()), "v": pa.array(done["v"], pa.list_(pa.float64()))})

    one, two = (df.withColumn("all", F.lit(1)).groupBy("all") for df in (rows, start))
    out = ws.write(one.cogroup(two).applyInArrow(run, "kind string, code long, v array<double>"), "kernel")
    first = out.where("kind = 's'").first()
    return np.array(first["v"] if first else []), out


def _named(out: DataFrame, kind: str, codes: DataFrame, *columns: str) -> DataFrame:
    """(id, columns): the cells of a kernel's rows of one kind, with ids for codes."""
    ident = next(c for c in codes.columns if c != "code")
    return out.where(F.col("kind") == kind).join(codes, "code").select(ident, *[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def _coded(ws: Workspace, ids: DataFrame, name: str) -> DataFrame:
    """(name, code): a number for each id of a table of distinct ones."""
    return ws.write(ids.select(name).withColumn("code", F.monotonically_increasing_id()), "codes")


def _numbered(seed: int) -> Callable[[str | Column], Column]:
    return lambda c: F.xxhash64(F.lit(seed), c)


def number_of(ids: DataFrame, name: str) -> Callable[[str | Column], Column]:
    """A number that follows from an id alone and is another one for each of a table's distinct ids."""
    for seed in range(100):
        number = _numbered(seed)
        row = ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(number(name)).alias("k")).first()
        if row["n"] == row["k"]:
            return number
    raise ValueError(f"{name}: no numbers without collisions; are the ids distinct?")


def profile_modes(profiles: DataFrame, names: DataFrame, number: Callable[[str | Column], Column], n_tests: int, n_functions: int, *, k: int = 16, spare: int = 4, rounds: int = 10) -> Modes:
    """``modes`` in one task, which reads the profiles as a stream.

    ``profiles``: (test_id, codes) of tests with functions, the distinct numbers of each test's functions;
    ``names``: (function_id) of all ``n_functions`` with these numbers.
    """
    ws, shown = Workspace(profiles.sparkSession, "modes"), [f"{c} double" for c in (*_columns(k), "n", "m")]
    alone = profiles.select("test_id", "codes").coalesce(1)
    out = ws.write(alone.mapInArrow(lambda batches: kernels.profile_modes(batches, n_tests, k, spare, rounds), f"kind string, test_id string, code long, {', '.join(shown)}"), "kernel")
    first, kept = out.where("kind = 's'").first(), _columns(min(k, n_functions))
    values, total = np.maximum([first[c] for c in kept], 0.0), float(n_tests) * (first["n"] - first["m"])
    loads = out.where("kind = 'f'").select("code", *kept)
    functions = loads.join(names.select("function_id", number("function_id").alias("code")), "code").select("function_id", *kept)
    tests = out.where("kind = 't'").select("test_id", *kept, "n", "m")
    return Modes([float(x / total) if total > 0 else 0.0 for x in values], np.sqrt(values), functions, tests, loads, names, n_tests, n_functions, round(first["n"] * n_tests), first["m"], total)


def modes(pairs: DataFrame, n_tests: int, *, k: int = 16, spare: int = 4, rounds: int = 10, local_pairs: int = LOCAL_ONES) -> Modes:
    """Modes of the mean-centred matrix of tests and functions: the right singular vectors.

    A matrix of at most ``local_pairs`` ones is iterated in one task, from the same start and to the
    same residual, which is looked at every ``rounds`` rounds.

    ``pairs``: distinct (test_id, function_id); tests without functions count in ``n_tests``.
    """
    ws = Workspace(pairs.sparkSession, "modes")
    pairs, seen = ws.write_counted(pairs.select("test_id", "function_id"), "pairs")
    means = ws.write(pairs.groupBy("function_id").agg((F.count(F.lit(1)) / F.lit(float(max(1, n_tests)))).alias("mean")), "means")
    row = means.agg(F.sum("mean").alias("a"), F.sum(F.col("mean") * F.col("mean")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    names_of, number, ones = means.select("function_id"), number_of(means, "function_id"), seen["n"]
    if 0 < ones <= local_pairs:
        profiles = pairs.groupBy("test_id").agg(F.sort_array(F.collect_list(number("function_id"))).alias("codes"))
        return profile_modes(profiles, names_of, number, n_tests, row["n"], k=k, spare=spare, rounds=rounds)
    total = float(n_tests) * ((row["a"] or 0.0) - (row["b"] or 0.0))
    width = max(1, min(k + spare, int(row["n"] or 1)))
    names, keep = _columns(width), min(k, width)
    start, least = start_block(means, "function_id", width, of=number("function_id")), 1e-9 * ones

    def scores(v: DataFrame, shown: list[str]) -> tuple[DataFrame, list[float]]:
        drop = means.join(v, "function_id").agg(*[F.sum(F.col("mean") * F.col(c)).alias(c) for c in shown]).first()
        shift = [float(drop[c] or 0.0) for c in shown]
        return pairs.join(v, "function_id").groupBy("test_id").agg(*[F.sum(c).alias(c) for c in shown]), shift

    held: list[DataFrame] = []

    def step(v: DataFrame) -> DataFrame:
        y, shift = scores(v, names)
        ws.drop(*held)
        y = ws.write(y.select("test_id", *[(F.col(c) - F.lit(s)).alias(c) for c, s in zip(names, shift)]), "scores")
        held[:] = [y]
        # tests without functions have the score -shift and meet no function; they count in the sum
        sums = y.agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("n")).first()
        whole = [float(sums[c] or 0.0) - s * (n_tests - sums["n"]) for c, s in zip(names, shift)]
        z = pairs.join(y, "test_id").groupBy("function_id").agg(*[F.sum(c).alias(c) for c in names])
        return z.join(means, "function_id").select("function_id", *[(F.col(c) - F.col("mean") * F.lit(w)).alias(c) for c, w in zip(names, whole)])

    values, vectors = subspace(ws, start, "function_id", width, step, rounds, keep=keep, least=least, of=number("function_id"))
    kept = _columns(keep)
    vectors = ws.write(vectors.select("function_id", *kept), "functions")
    _, shift = scores(vectors, kept)
    own = pairs.join(vectors.join(means, "function_id"), "function_id").groupBy("test_id").agg(*[F.sum(c).alias(c) for c in kept], F.count(F.lit(1)).cast("double").alias("n"), F.sum("mean").alias("m"))
    tests = ws.write(own.select("test_id", *[(F.col(c) - F.lit(s)).alias(c) for c, s in zip(kept, shift)], "n", "m"), "tests")
    values = np.maximum(values, 0.0)
    return Modes([float(x / total) if total > 0 else 0.0 for x in values], np.sqrt(values), vectors, tests, vectors.drop("function_id"), names_of, n_tests, row["n"], ones, row["b"] or 0.0, total)


def outliers(found: Modes, pairs: DataFrame) -> DataFrame:
    """(test_id, residual, breadth, kind): the share of a test that the modes do not explain, and
    whether a poorly explained one is broad (smoke) or has something to itself (unique)."""
    captured = sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(len(found.energies))), F.lit(0.0))
    both = found.tests.select(
        "test_id", (F.col("n") - 2 * F.col("m") + F.lit(float(found.squares))).alias("energy"), captured.alias("captured"), (F.col("n") / F.lit(float(found.n_functions or 1))).alias("breadth")
    )
    high = both.agg(F.percentile("breadth", 0.9).alias("q90")).first()["q90"] or 0.0
    residual = F.when(F.col("energy") <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("captured") / F.col("energy")))
    smoke = F.col("breadth") >= F.lit(max(float(high), 0.5))
    out = both.withColumn("residual", residual)
    kind = F.when(F.col("residual") < 0.5, "typical").when(smoke, "smoke").otherwise("unique")
    return out.select("test_id", F.round("residual", 4).alias("residual"), F.round("breadth", 4).alias("breadth"), kind.alias("kind"))


def neighbours(found: Modes, anchor: str) -> DataFrame:
    """(function_id, score): functions by cosine with the anchor in the space of the modes."""
    k = len(found.energies)
    scaled = found.functions.select("function_id", *[(F.col(f"v{i}") * F.lit(float(found.singular[i]))).alias(f"v{i}") for i in range(k)])
    at = scaled.where(F.col("function_id") == anchor).first()
    if at is None:
        return scaled.limit(0).select("function_id", F.lit(0.0).alias("score"))
    v = [float(at[f"v{i}"]) for i in range(k)]
    dot = sum((F.col(f"v{i}") * F.lit(v[i]) for i in range(k)), F.lit(0.0))
    norm = F.sqrt(sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(k)), F.lit(0.0))) * F.lit(float(np.linalg.norm(v)))
    out = scaled.where(F.col("function_id") != anchor).select("function_id", F.round(dot / F.when(norm > 0, norm).otherwise(1.0), 4).alias("score"))
    return out.where("score > 0")


def spectral_embedding(nodes: DataFrame, adj: DataFrame, *, k: int = 12, spare: int = 8, rounds: int = 24, local_edges: int = LOCAL_ONES) -> tuple[np.ndarray, DataFrame]:
    """Smallest eigenvalues of the normalised Laplacian with their vectors (id, v0..).

    ``adj``: (s, d) undirected pairs in both directions; iterates (I + D^-1/2 A D^-1/2) / 2, whose
    largest eigenvalues are the Laplacian's smallest. Nodes without a pair have no row. At most
    ``local_edges`` pairs are iterated in one task, from the same start and to the same residual,
    which is looked at every ``rounds`` rounds.
    """
    ws = Workspace(nodes.sparkSession, "spectral")
    adj = ws.write(adj.select("s", "d"), "adjacency")
    degree = ws.write(adj.groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "degree")
    ids = ws.write(nodes.select("id").join(degree, "id", "left_semi"), "ids")
    width = max(1, min(k + spare, ids.count()))
    keep, start = min(k, width), start_block(ids, "id", width)
    if 0 < adj.count() <= local_edges:
        codes = _coded(ws, ids, "id")
        coded = adj.join(codes.withColumnsRenamed({"id": "s", "code": "a"}), "s").join(codes.withColumnsRenamed({"id": "d", "code": "b"}), "d").select(F.col("a").alias("s"), F.col("b").alias("d"))
        begun = start.join(codes, "id").select(F.col("code").alias("id"), *_columns(width))
        values, out = _in_one_task(ws, coded, begun, lambda pdf, block: kernels.spectral(pdf, block, keep, rounds))
        return 2 - 2 * values, ws.write(_named(out, "f", codes, *_columns(len(values))), "vectors")
    scaled = adj.join(degree.withColumnsRenamed({"id": "s", "deg": "ds"}), "s").join(degree.withColumnsRenamed({"id": "d", "deg": "dd"}), "d")
    links = ws.write(scaled.select("s", "d", (F.lit(1.0) / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")), "links")
    names = _columns(width)

    def step(v: DataFrame) -> DataFrame:
        moved = links.join(v.withColumnRenamed("id", "s"), "s").groupBy(F.col("d").alias("id")).agg(*[F.sum(F.col(c) * F.col("w")).alias(f"m{c}") for c in names])
        return v.join(moved, "id", "left").select("id", *[((F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))) / 2).alias(c) for c in names])

    values, vectors = subspace(ws, start, "id", width, step, rounds, keep=keep)
    return 2 - 2 * values, vectors

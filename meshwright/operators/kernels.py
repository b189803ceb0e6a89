"""Sweeps over one graph that fits into a task: the bounded twin of the rounds in ``sweeps``.

A round of joins costs about a third of a second whatever it moves, so a graph whose edges are few
can be swept by one Arrow task per snapshot instead, on request or, for lanes, by default. The bound
is checked before; both ways give the same rows, and tests hold them against each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Edges, of all snapshots together, up to which a sweep is one task per snapshot.
LOCAL_EDGES = 1_000_000
#: Ones of a matrix up to which its modes are iterated in one task: 30 bytes each, with numbers for ids.
LOCAL_ONES = 10_000_000


class Csr:
    """Nodes as numbers with the successors of each in one array."""

    def __init__(self, src: pd.Series, dst: pd.Series, extra: pd.Series | None = None, weights: np.ndarray | None = None):
        parts = [src, dst] + ([extra] if extra is not None else [])
        codes, self.ids = pd.factorize(pd.concat(parts, ignore_index=True), sort=True)
        n = len(src)
        self.s, self.d, self.extra = codes[:n], codes[n : 2 * n], codes[2 * n :]
        order = np.argsort(self.s, kind="stable")
        self.to = self.d[order]
        self.w = weights[order] if weights is not None else None
        self.start = np.searchsorted(self.s[order], np.arange(len(self.ids) + 1))

    def edges_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, position in ``to``) of all edges out of some nodes."""
        first, n = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        at = np.repeat(np.arange(len(nodes)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def strong_components(start: list[int], to: list[int]) -> list[int]:
    """Component numbers of nodes 0..n-1 by two stacks (path-based search); the successors of a
    node are ``to[start[node]:start[node + 1]]``."""
    n = len(start) - 1
    order, component, at = [-1] * n, [-1] * n, start[:n]
    open_nodes: list[int] = []
    bounds: list[int] = []
    counter = found = 0
    for root in range(n):
        if order[root] >= 0:
            continue
        order[root], counter = counter, counter + 1
        open_nodes.append(root)
        bounds.append(root)
        work = [root]
        while work:
            node = work[-1]
            i = at[node]
            if i < start[node + 1]:
                at[node] = i + 1
                nxt = to[i]
                if order[nxt] < 0:
                    order[nxt], counter = counter, counter + 1
                    open_nodes.append(nxt)
                    bounds.append(nxt)
                    work.append(nxt)
                elif component[nxt] < 0:
                    while order[bounds[-1]] > order[nxt]:
                        bounds.pop()
            else:
                work.pop()
                if bounds[-1] == node:
                    bounds.pop()
                    while True:
                        member = open_nodes.pop()
                        component[member] = found
                        if member == node:
                            break
                    found += 1
    return component


def _snapshot(*frames: pd.DataFrame):
    return next(f["snapshot"].iloc[0] for f in frames if len(f))


def reach(adj: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    g = Csr(adj["s"], adj["d"], seeds["id"])
    hops = np.full(len(g.ids), -1)
    frontier = np.unique(g.extra)
    hops[frontier], step = 0, 0
    while len(frontier):
        step += 1
        reached = np.unique(g.to[g.edges_of(frontier)[1]])
        frontier = reached[hops[reached] < 0]
        hops[frontier] = step
    found = np.flatnonzero(hops >= 0)
    return pd.DataFrame({"snapshot": _snapshot(seeds, adj), "id": np.asarray(g.ids)[found], "hops": hops[found]})[["snapshot", "id", "hops"]]


def lane_reach(adj: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    g = Csr(adj["s"], adj["d"], seeds["id"])
    words, masks = seeds["word"].to_numpy(), seeds["mask"].to_numpy().astype(np.int64)
    out = []
    for word in np.unique(words):
        own = words == word
        seen = np.zeros(len(g.ids), np.int64)
        np.bitwise_or.at(seen, g.extra[own], masks[own])
        fresh = seen.copy()
        while (frontier := np.flatnonzero(fresh)).size:
            at, edge = g.edges_of(frontier)
            came = np.zeros_like(seen)
            np.bitwise_or.at(came, g.to[edge], fresh[frontier][at])
            fresh = came & ~seen
            seen |= fresh
        found = np.flatnonzero(seen)
        out.append(pd.DataFrame({"snapshot": _snapshot(seeds, adj), "word": word, "id": np.asarray(g.ids)[found], "mask": seen[found]}))
    columns = ["snapshot", "word", "id", "mask"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


#: Bytes of the lanes that one pass over a graph holds.
LANE_BYTES = 64_000_000


def _layers(s: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Of the nodes of a graph without circles, the length of the longest way that ends there."""
    order = np.argsort(s, kind="stable")
    to, start = d[order], np.searchsorted(s[order], np.arange(n + 1))
    missing, layer, step = np.bincount(d, minlength=n), np.zeros(n, np.int64), 0
    frontier = np.flatnonzero(missing == 0)
    while frontier.size:
        layer[frontier] = step
        many = start[frontier + 1] - start[frontier]
        ends = to[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[frontier], many)]
        np.subtract.at(missing, ends, 1)
        ends = np.unique(ends)
        frontier, step = ends[missing[ends] == 0], step + 1
    return layer


def lane_counts(adj: pd.DataFrame, lanes: pd.DataFrame, by_node: bool) -> pd.DataFrame:
    """Sizes of closures. ``lanes``: (lane, code, seed); rows with ``seed`` start a lane, the others are
    looked up in it. By node: (key, n, hit) has of each node the lanes that reach it; else of each
    lane the nodes it reaches and how many of those looked up are among them.

    Circles are one node each, so that one pass along the layers of what is left closes many lanes.
    """
    ids, ends = np.unique(np.concatenate([adj["s"].to_numpy(), adj["d"].to_numpy(), lanes["code"].to_numpy()]), return_inverse=True)
    m = len(adj)
    start = np.concatenate([[0], np.cumsum(np.bincount(ends[:m], minlength=len(ids)))])
    of = np.array(strong_components(start.tolist(), ends[m : 2 * m][np.argsort(ends[:m], kind="stable")].tolist()), dtype=np.int64)
    n = int(of.max()) + 1 if len(of) else 0
    size = np.bincount(of, minlength=n)
    links = np.unique(of[ends[:m]] * n + of[ends[m : 2 * m]]) if m else np.empty(0, np.int64)
    s, d = links // max(n, 1), links % max(n, 1)
    s, d = s[s != d], d[s != d]
    layer = _layers(s, d, n)
    order = np.lexsort((d, layer[d]))
    s, d = s[order], d[order]
    at, seed = of[ends[2 * m :]], lanes["seed"].to_numpy().astype(bool)
    names, lane = np.unique(lanes["lane"].to_numpy(), return_inverse=True)
    words = -(-len(names) // 64)
    together = max(1, min(words, LANE_BYTES // (8 * max(n, 1))))
    reached, hit, hits = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(n, np.int64)
    for first in range(0, words, together):
        own = (lane >= first * 64) & (lane < (first + together) * 64)
        begin, ask = own & seed, own & ~seed
        word, bit = lane // 64 - first, np.left_shift(np.uint64(1), (lane % 64).astype(np.uint64))
        seen = np.zeros((n, min(together, words - first)), np.uint64)
        np.bitwise_or.at(seen, (at[begin], word[begin]), bit[begin])
        marked = seen.any(axis=1)
        for low, high in _steps(layer[d]):
            live = marked[s[low:high]]
            if live.any():
                a, b = s[low:high][live], d[low:high][live]
                into = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                for x in range(0, len(into), 20_000):
                    cut = slice(into[x], into[x + 20_000] if x + 20_000 < len(into) else len(b))
                    seen[b[into[x : x + 20_000]]] |= np.bitwise_or.reduceat(seen[a[cut]], into[x : x + 20_000] - into[x], axis=0)
                marked[b[into]] = True
        if by_node:
            hits += np.bitwise_count(seen).sum(axis=1, dtype=np.int64)
        else:
            rows = np.flatnonzero(marked)
            for k in range(seen.shape[1]):
                some = rows[seen[rows, k] != 0]
                column, weight = seen[some, k], size[some]
                for i in range(min(64, len(names) - (first + k) * 64)):
                    reached[(first + k) * 64 + i] = weight[(column >> np.uint64(i)) & np.uint64(1) != 0].sum()
            np.add.at(hit, lane[ask], (seen[at[ask], word[ask]] & bit[ask]) != 0)
    if by_node:
        found = np.flatnonzero(hits[of])
        return pd.DataFrame({"key": ids[found], "n": hits[of][found], "hit": 0})
    return pd.DataFrame({"key": names, "n": reached, "hit": hit})


def _steps(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else []
    return list(zip(cuts, cuts[1:]))


def pagerank(nodes: pd.DataFrame, adj: pd.DataFrame, damping: float, rounds: int) -> pd.DataFrame:
    g = Csr(adj["s"], adj["d"], nodes["id"])
    n = len(nodes)
    out = np.bincount(g.s, minlength=len(g.ids)).astype(float)
    inside = np.zeros(len(g.ids), bool)
    inside[g.extra] = True
    rank = np.where(inside, 1.0 / max(1, n), 0.0)
    share = 1.0 / out[g.s]
    for _ in range(rounds):
        given = np.bincount(g.d, weights=rank[g.s] * share, minlength=len(g.ids))
        rank = np.where(inside, (1 - damping) / max(1, n) + damping * given, 0.0)
    return pd.DataFrame({"snapshot": nodes["snapshot"].to_numpy(), "id": nodes["id"].to_numpy(), "rank": rank[g.extra]})


def components(nodes: pd.DataFrame, adj: pd.DataFrame) -> pd.DataFrame:
    g = Csr(adj["s"], adj["d"], nodes["id"])
    label = np.arange(len(g.ids))  # ids are in order, so the least number is the least id
    while True:
        before = label.copy()
        np.minimum.at(label, g.d, before[g.s])
        np.minimum.at(label, g.s, before[g.d])
        label = label[label]
        if (label == before).all():
            break
    ids = np.asarray(g.ids)
    return pd.DataFrame({"snapshot": nodes["snapshot"].to_numpy(), "id": nodes["id"].to_numpy(), "component": ids[label[g.extra]]})


def best_paths(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    after: dict = {}
    for s, d, w in zip(edges["s"], edges["d"], edges["w"]):
        after.setdefault(s, {})
        after[s][d] = max(w, after[s].get(d, 0.0))
    heap = [(-1.0, 0, (x,)) for x in sorted(set(seeds["id"]))]
    done: dict = {}
    while heap:
        k, hops, path = heapq.heappop(heap)
        if path[-1] in done:
            continue
        done[path[-1]] = (-k, hops, list(path))
        for d, w in after.get(path[-1], {}).items():
            if d not in done:
                heapq.heappush(heap, (k * w, hops + 1, (*path, d)))
    rows = [(_snapshot(seeds, edges), x, *v) for x, v in done.items()]
    return pd.DataFrame(rows, columns=["snapshot", "id", "score", "hops", "path"])


class Sparse:
    """A binary matrix given by the places of its ones, for products with blocks of vectors. Lines of at
    most ``WIDE`` ones are sorted by their number and a block of them takes the j-th one of each at once."""

    WIDE, LINES = 64, 4096

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int], weight: np.ndarray | None = None):
        self.shape = shape
        self.counts = [np.bincount(x, minlength=n) for x, n in zip((row, col), shape)]
        self.parts = [self._laid(row, col, shape[0], weight), self._laid(col, row, shape[1], weight)]

    def _laid(self, out_of: np.ndarray, into: np.ndarray, n: int, weight: np.ndarray | None) -> tuple[list, list]:
        order = np.argsort(out_of, kind="stable")
        into, weight = into[order].astype(np.int32, copy=False), None if weight is None else weight[order][:, None]
        count = np.bincount(out_of, minlength=n)
        first = np.cumsum(count) - count
        places = lambda at: (into[at], None if weight is None else weight[at])
        narrow = np.flatnonzero((count > 0) & (count <= self.WIDE))
        narrow, blocks = narrow[np.argsort(-count[narrow], kind="stable")], []
        for i in range(0, len(narrow), self.LINES):
            lines = narrow[i : i + self.LINES]
            n_of = count[lines]
            longer = [np.searchsorted(-n_of, -j) for j in range(n_of[0])]
            blocks.append((lines, [places(first[lines[:k]] + j) for j, k in enumerate(longer)]))
        return blocks, [(line, *places(slice(first[line], first[line] + count[line]))) for line in np.flatnonzero(count > self.WIDE)]

    def _times(self, which: int, block: np.ndarray) -> np.ndarray:
        blocks, wide = self.parts[which]
        block, room = np.ascontiguousarray(block), np.empty((self.LINES, block.shape[1]))
        out = np.zeros((self.shape[which], block.shape[1]))

        def taken(into: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
            got = np.take(block, into, axis=0, out=room[: len(into)], mode="clip")
            return got if weight is None else np.multiply(got, weight, out=got)

        for lines, ones in blocks:
            total = np.zeros((len(lines), block.shape[1]))
            for into, weight in ones:
                total[: len(into)] += taken(into, weight)
            out[lines] = total
        for line, into, weight in wide:
            for i in range(0, len(into), self.LINES):
                out[line] += taken(into[i : i + self.LINES], None if weight is None else weight[i : i + self.LINES]).sum(0)
        return out

    def times(self, block: np.ndarray) -> np.ndarray:
        return self._times(0, block)

    def transposed_times(self, block: np.ndarray) -> np.ndarray:
        return self._times(1, block)


#: A vector is settled when the operator moves it out of its own line by at most this share of its eigenvalue.
CLOSE = 1e-3


def ritz(small: np.ndarray, moved: np.ndarray, keep: int, least: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ritz values from large to small, the turn to their vectors, and whether the first ``keep`` are
    settled. ``small``: basis times moved basis; ``moved``: Gram matrix of the moved basis. Eigenvalues
    under a thousandth of the greatest or under ``least``, where rounding begins, count as that."""
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    residual = np.sqrt(np.maximum((turn * (moved @ turn)).sum(0) - values**2, 0.0))
    return values, turn, _settled(residual, values, keep, least)


#: Plain rounds after which what is not settled goes on in a Krylov space, and the share of ``CLOSE`` that
#: modes are then iterated to: they lie close together, and a Krylov space has them after a few products more,
#: from the start too.
PLAIN, MODES_PLAIN, FINER = 60, 0, 1e-2
#: Lines of a block that are worked on at a time, so that they stay in the cache.
SLAB = 16_384


def _orthonormal(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.linalg.qr``, by Cholesky factors of Gram matrices where the columns are well apart."""
    basis, upper = block, np.eye(block.shape[1])
    try:
        for _ in range(3):
            gram = basis.T @ basis
            size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            factor = np.linalg.cholesky(gram / np.outer(size, size)) * size[:, None]
            if (np.diag(factor) < 1e-6 * size).any():
                break
            basis, upper = basis @ np.linalg.inv(factor).T, factor.T @ upper
            if np.abs(gram - np.eye(len(gram))).max() < 1e-10:
                return basis, upper
    except np.linalg.LinAlgError:
        pass
    return np.linalg.qr(block)


def _settled(residual: np.ndarray, values: np.ndarray, keep: int, least: float, share: float = 1.0) -> bool:
    return bool((residual[:keep] <= share * CLOSE * np.maximum(np.maximum(values[:keep], 1e-3 * values[0]), least)).all())


def _leading(apply, start: np.ndarray, keep: int, rounds: int, least: float, plain: int = PLAIN, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from large to small and vectors of a symmetric positive operator: iterated from
    ``start`` until settled, which is looked at every ``rounds`` rounds. Where eigenvalues lie so close
    that this takes more than ``plain`` rounds, the Krylov space of the block goes on to ``share`` of the residual."""
    basis, at = _orthonormal(start)[0], 0
    krylov = len(start) > 8 * start.shape[1]
    if not plain and krylov:
        values, vectors = _krylov(apply, basis, keep, least, share)
        return values, vectors * np.where(start[:, 0] @ vectors < 0, -1.0, 1.0)
    while True:
        out, at = apply(basis), at + 1
        if at % rounds == 0:
            values, turn, settled = ritz(basis.T @ out, out.T @ out, keep, least)
            if not settled and at >= plain and krylov:
                values, vectors = _krylov(apply, _orthonormal(out)[0], keep, least, share)
            elif settled:
                values, vectors = values[:keep], (basis @ turn)[:, :keep]
            else:
                basis = _orthonormal(out)[0]
                continue
            return values, vectors * np.where(start[:, 0] @ vectors < 0, -1.0, 1.0)
        basis = _orthonormal(out)[0]


def _products(space: np.ndarray, block: np.ndarray) -> np.ndarray:
    return sum(space[i : i + SLAB].T @ block[i : i + SLAB] for i in range(0, len(block), SLAB))


def _cleared(block: np.ndarray, space: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Takes what lies in ``space`` out of ``block``, in place and twice; ``seen``, their products."""
    again = np.zeros_like(seen)
    for i in range(0, len(block), SLAB):
        part, lines = space[i : i + SLAB], block[i : i + SLAB]
        lines -= part @ seen
        again += part.T @ lines
    for i in range(0, len(block), SLAB):
        block[i : i + SLAB] -= space[i : i + SLAB] @ again
    return seen


def _krylov(apply, block: np.ndarray, keep: int, least: float, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Block Lanczos with full orthogonalisation, started again from twice the block's number of Ritz
    vectors whenever the space has four to six times as many."""
    n, width = block.shape
    most = (6 if n <= 300_000 else 4) * width
    room = np.empty((n, most), order="F")
    room[:, :width], small, held, size = block, np.zeros((width, width)), 0, width
    while True:
        space = room[:, :size]
        out = apply(space[:, held:])
        seen = _cleared(out, space, _products(space, out))
        small[:, held:], small[held:, :] = seen, seen.T
        block, rest = _orthonormal(out)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residual = np.linalg.norm(rest @ turn[held:], axis=0)
        if _settled(residual, values, keep, least, share):
            return values[:keep].copy(), space @ turn[:, :keep]
        if size + width > most:
            size, small = 2 * width, np.diag(values[: 2 * width])
            for i in range(0, n, SLAB):  # in place: the space is not held twice
                room[i : i + SLAB, :size] = space[i : i + SLAB] @ turn[:, :size]
        held, size = size, size + width
        room[:, held:size] = block
        small = np.pad(small, (0, width))


def _placed(start: pd.DataFrame, key: str, ids) -> np.ndarray:
    return start.drop(columns=["all", key], errors="ignore").to_numpy()[pd.Index(start[key]).get_indexer(ids)]


def _rows(kind: str, keys, block: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "key": keys, "v": list(block)})


def _decomposed(m: Sparse, start: np.ndarray, n_tests: int, k: int, rounds: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, loadings of functions, coordinates of tests with the sum of their functions' means, means."""
    n, mean = m.shape[0], m.counts[1] / max(1, n_tests)

    def centred(v: np.ndarray) -> np.ndarray:
        y = m.times(v)
        y -= mean @ v
        return y

    def apply(v: np.ndarray) -> np.ndarray:
        y = centred(v)
        whole = y.sum(0) - (n_tests - n) * (mean @ v)
        z = m.transposed_times(y)
        for i in range(0, len(z), SLAB):
            z[i : i + SLAB] -= mean[i : i + SLAB, None] * whole
        return z

    values, vectors = _leading(apply, start, k, rounds, least, MODES_PLAIN, FINER)
    return values, vectors, np.column_stack([centred(vectors), m.times(mean[:, None])]), mean


def modes(pairs: pd.DataFrame, start: pd.DataFrame, n_tests: int, k: int, rounds: int, least: float) -> pd.DataFrame:
    """Rows (kind, key, v): of functions their loadings, of tests their coordinates, number of functions
    and sum of the functions' means, one of values."""
    t, tests = pd.factorize(pairs["test_id"], sort=True)
    f, functions = pd.factorize(pairs["function_id"], sort=True)
    m = Sparse(t, f, (len(tests), len(functions)))
    values, vectors, places, _ = _decomposed(m, _placed(start, "function_id", functions), n_tests, k, rounds, least)
    own = np.insert(places, -1, m.counts[0], axis=1)
    return pd.concat([_rows("f", np.asarray(functions), vectors), _rows("t", np.asarray(tests), own), _rows("s", [0], values[None, :])])


class Profiles:
    """Tests by rising id, each with the functions it ran: ``codes`` of all of them one after the other as
    numbers ``f`` of ``functions``, which are told in the order of these tests, so that what runs together
    lies together; ``counts``: functions of each test."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        held = [(b.column(0), b.column(1).flatten(), b.column(1).value_lengths()) for b in batches]
        self.tests, codes, counts = (pa.chunked_array(list(x)).combine_chunks() for x in zip(*held))
        del held
        counts, codes = counts.to_numpy(), codes.to_numpy()
        order = pc.sort_indices(self.tests).to_numpy()
        self.tests, self.counts = self.tests.take(pa.array(order)), counts[order].astype(np.int64)
        at = np.repeat((np.cumsum(counts) - counts)[order] - np.cumsum(self.counts) + self.counts, self.counts)
        at += np.arange(len(at))
        f, self.functions = pd.factorize(codes[at])
        self.f = f.astype(np.int32)

    @property
    def t(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)


def profile_modes(batches: Iterator[pa.RecordBatch], n_tests: int, k: int, spare: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Modes of profiles (test_id, codes of functions): rows (kind, test_id, code, v0.., n, m) of functions
    ('f': loadings), of tests ('t': coordinates, number of functions, sum of their means) and one of all
    ('s': values, sum of the means and of their squares)."""
    p = Profiles(batches)
    width = max(1, min(k + spare, len(p.functions)))
    keep, least = min(k, width), 1e-9 * len(p.f)
    m = Sparse(p.t, p.f, (len(p.counts), len(p.functions)))
    tests, counts, functions = p.tests, p.counts, p.functions
    del p
    start = np.column_stack([hash_unit(functions, i) for i in range(width)])
    values, vectors, places, mean = _decomposed(m, start, n_tests, keep, rounds, least)
    del start, m

    def rows(kind: str, n: int, at: slice, test_id: pa.Array | None = None, code: np.ndarray | None = None, cells: np.ndarray | None = None, n_of: np.ndarray | None = None, m_of: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(n, pa.float64())
        cut = lambda x: none if x is None else pa.array(x[at].astype(float))
        columns = [pa.array([kind] * n), pa.nulls(n, pa.string()) if test_id is None else test_id[at], pa.nulls(n, pa.int64()) if code is None else pa.array(code[at])]
        columns += [cut(cells[:, i]) if i < cells.shape[1] else none for i in range(k)] + [cut(n_of), cut(m_of)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "test_id", "code", *[f"v{i}" for i in range(k)], "n", "m"])

    for i in range(0, len(functions), SLAB):
        yield rows("f", min(SLAB, len(functions) - i), slice(i, i + SLAB), code=functions, cells=vectors)
    for i in range(0, len(counts), SLAB):
        yield rows("t", min(SLAB, len(counts) - i), slice(i, i + SLAB), tests, cells=places[:, :keep], n_of=counts, m_of=places[:, keep])
    yield rows("s", 1, slice(0, 1), cells=values[None, :], n_of=np.array([mean.sum()]), m_of=np.array([mean @ mean]))


def greedy(p: Profiles) -> np.ndarray:
    """The gain of each test in the order of ``cover.greedy_order``, 0 for one that runs nothing new; its
    rounds, with the ones of functions not yet run held by function."""
    n = len(p.counts)
    order = np.argsort(p.f, kind="stable")
    t, size, taken = p.t[order], np.bincount(p.f), np.zeros(n, np.int64)
    del order
    rank = np.arange(n)[::-1].copy()
    while len(t):
        gain = np.bincount(t, minlength=n)
        best = np.maximum.reduceat((gain * n + rank)[t], np.cumsum(size) - size)
        first = n - 1 - best % n
        picked = (np.bincount(first, minlength=n) == gain) & (gain > 0)
        taken[picked] = gain[picked]
        rest = ~picked[first]
        t, size = t[np.repeat(rest, size)], size[rest]
    return taken


def greedy_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(test_id, gain) of the tests of profiles (test_id, codes of functions) that run something new."""
    p = Profiles(batches)
    gain = greedy(p)
    taken = np.flatnonzero(gain)
    for i in range(0, len(taken), SLAB):
        yield pa.RecordBatch.from_arrays([p.tests.take(pa.array(taken[i : i + SLAB])), pa.array(gain[taken[i : i + SLAB]])], ["test_id", "gain"])


def hash_unit(codes: np.ndarray, i: int, seed: int = 1) -> np.ndarray:
    """``linalg._unit`` of a column of longs: numbers from -1 to 1 by Spark's ``xxhash64(int, long)``."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * p2
        x = (x ^ (x >> np.uint64(29))) * p3
        return x ^ (x >> np.uint64(32))

    first = np.array([42], np.uint64) + p5 + np.uint64(4)
    first = mixed(turned(first ^ (np.array([seed * 1000 + i], np.uint64) * p1), 23) * p2 + p3)
    x = (first + p5 + np.uint64(8)) ^ (turned(codes.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    return mixed(turned(x, 27) * p1 + p4).view(np.int64) % 2_000_003 / 1_000_001.5 - 1


def spectral(adj: pd.DataFrame, start: pd.DataFrame, k: int, rounds: int) -> pd.DataFrame:
    g = Csr(adj["s"], adj["d"])
    degree = np.bincount(g.s, minlength=len(g.ids)).astype(float)
    p = Sparse(g.s, g.d, (len(g.ids), len(g.ids)), 1 / np.sqrt(degree[g.s] * degree[g.d]))
    values, vectors = _leading(lambda v: (v + p.times(v)) / 2, _placed(start, "id", g.ids), k, rounds, 0.0)
    return pd.concat([_rows("f", np.asarray(g.ids), vectors), _rows("s", [0], values[None, :])])

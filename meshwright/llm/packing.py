"""Filling fixed-capacity containers with items.

Bin completion, in two steps. The descent fills a container around the largest item that is left
with the largest sizes whose sum comes nearest to the room; that is exact, by a table of reachable
sums. Its packing, or the best-fit-decreasing one if that is smaller, is the incumbent. Where it
has more containers than a lower bound, a branch and bound looks for one container less: it
branches on the size with the fewest fillings left, passes over dominated fillings, ends a branch
whose waste exceeds what one container less allows, and begins again with other ties after a
while. What it searches is the tail: the containers with waste and as many full ones as make up
``TAIL`` items. It lays at most ``BRANCHES`` fillings; beyond that the incumbent stands, so the
number bounds time and never what is packed.

Batches have a bounded number of items and are packed apart from each other, whatever order or
skew the table has; the containers of a batch that could still take much are opened again in the
task's next batch, so that batches cost next to no room. The search is made in a task's last batch.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.copies import numbered_copies

CAPACITY = 2048
#: Items that are packed together; items of a tail and fillings laid to take one container off it.
BATCH, TAIL, BRANCHES = 4096, 240, 10_000
#: Fillings that are looked at, and of those with the fewest items listed, with one size as their largest.
SEEN, LISTED = 256, 24


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over sizes sorted from large to small: containers of positions."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for at, size in enumerate(sizes):
        k = bisect_left(rooms, (size, -1))
        if k == len(rooms):
            bins.append([at])
            insort(rooms, (capacity - size, len(bins) - 1))
        else:
            room, b = rooms.pop(k)
            bins[b].append(at)
            insort(rooms, (room - size, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by the total, and by items over a size that share none."""
    order = sorted(sizes, reverse=True)
    best = -(-sum(order) // capacity)
    n_large = sum(2 * s > capacity for s in order)
    for least in sorted({s for s in order if 2 * s <= capacity}):
        alone = sum(s > capacity - least for s in order[:n_large])
        room = sum(capacity - s for s in order[alone:n_large])
        middle = sum(s for s in order[n_large:] if s >= least)
        best = max(best, n_large + max(0, -(-(middle - room) // capacity)))
    return max(best, n_large)


def fill(room: int, sizes: list[int], counts: dict[int, int]) -> list[int]:
    """Sizes, each at most ``counts`` times, whose sum comes nearest to ``room``: of the exact ones
    the first found with the sizes taken in from large to small. ``sizes`` ascend."""
    mask, reach, taken = (1 << (room + 1)) - 1, [1], []
    for k in range(bisect_left(sizes, room + 1) - 1, -1, -1):
        size, bits = sizes[k], reach[-1]
        for _ in range(min(counts[size], room // size)):
            bits |= (bits << size) & mask
        reach.append(bits)
        taken.append(size)
        if bits >> room & 1:
            break
    left, out = reach[-1].bit_length() - 1, []
    for size, before in zip(reversed(taken), reversed(reach[:-1])):
        while not before >> left & 1:
            out.append(size)
            left -= size
    return out


def descend(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of sizes, each filled around the largest that is left."""
    counts = Counter(sizes)
    distinct = sorted(counts)
    bins = []
    while distinct:
        chosen = [distinct[-1]]
        counts[distinct[-1]] -= 1
        if not counts[distinct[-1]]:
            distinct.pop()
        for size in fill(capacity - chosen[0], distinct, counts):
            chosen.append(size)
            counts[size] -= 1
            if not counts[size]:
                del distinct[bisect_left(distinct, size)]
        bins.append(chosen)
    return bins


def _upward(bits: int, by: int) -> int:
    """The sums in ``bits`` and all up to ``by`` above one."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def fillings(capacity: int, counts: dict[int, int], waste: int) -> list[tuple[int, dict[int, int], int]]:
    """(waste, {size: times}, sizes that make it dominated) of whole containers, waste at most as given.

    A container is dominated while a size outside it is free that could take the place of some of
    its items: of two or more that sum to at most that size, or of one smaller, within the waste.
    """
    distinct = sorted(counts)
    reach, bits, mask = [1], 1, (1 << (capacity + 1)) - 1
    for size in distinct:
        for _ in range(min(counts[size], capacity // size)):
            bits |= (bits << size) & mask
        reach.append(bits)
    out: list[tuple[int, dict[int, int], int]] = []

    def walk(k: int, left: int, chosen: list[int]) -> Iterator[list[int]]:
        if not left:
            yield chosen
            return
        while k and reach[k] >> left & 1:
            k -= 1
            size = distinct[k]
            for times in range(min(counts[size], left // size), 0, -1):
                if reach[k] >> (left - times * size) & 1:
                    yield from walk(k, left - times * size, chosen + [size] * times)

    for k, big in enumerate(distinct, 1):
        found = []
        for lost in range(waste + 1):
            for times in range(min(counts[big], (capacity - lost) // big), 0, -1):
                rest = capacity - lost - times * big
                if len(found) < SEEN and reach[k - 1] >> rest & 1:
                    found += [(lost, chosen) for chosen in islice(walk(k - 1, rest, [big] * times), SEEN - len(found))]
        found.sort(key=lambda x: (len(x[1]), x[0]))
        for lost, chosen in found[:LISTED]:
            sums, several, one = 1, 0, 0
            for size in chosen:
                several |= (sums & ~1) << size
                sums |= sums << size
                one |= 1 << size
            beaten = _upward(several, lost) | (_upward(one << 1, lost - 1) if lost else 0)
            out.append((lost, dict(Counter(chosen)), beaten))
    return out


def complete(sizes: list[int], capacity: int, n_bins: int, branches: int = BRANCHES) -> list[list[int]] | None:
    """``n_bins`` containers that hold all sizes, or None where the search finds none.

    Fillings of at most the usual number of items are tried by themselves first: there are few of
    them, so a search among them goes far.
    """
    allowed = n_bins * capacity - sum(sizes)
    if allowed < 0 or n_bins < lower_bound(sizes, capacity):
        return None
    counts = dict(Counter(sizes))
    options = fillings(capacity, counts, min(allowed, capacity // 32))
    # items beyond the usual number of a container can be no more than others fall short of it
    usual, n_items = len(sizes) // n_bins, [sum(chosen.values()) for _, chosen, _ in options]
    fewest: dict[int, int] = {}
    for (_, chosen, _), n in zip(options, n_items):
        fewest[max(chosen)] = max(fewest.get(max(chosen), 0), usual - n)
    spare = len(sizes) - usual * n_bins + sum(v * counts[s] for s, v in fewest.items())
    for most in sorted({0, max(0, spare)}):
        kept = [o for o, n in enumerate(n_items) if n - usual <= most]
        found = _search([options[o] for o in kept], [max(0, n_items[o] - usual) for o in kept], dict(counts), allowed, spare, branches)
        if found is not None:
            return found
    return None


def _search(options: list[tuple[int, dict[int, int], int]], above: list[int], counts: dict[int, int], allowed: int, spare: int, branches: int) -> list[list[int]] | None:
    """Fillings that use up all counts with at most ``allowed`` waste and ``spare`` items above the usual."""
    needs: dict[int, dict[int, list[int]]] = {s: {} for s in counts}
    for o, (_, chosen, _) in enumerate(options):
        for size, times in chosen.items():
            needs[size].setdefault(times, []).append(o)
    full, rng = dict(counts), random.Random(len(options))
    short, degree, free = [0] * len(options), {}, 0
    laid, left, now = [], branches, 0

    def turn(o: int, sign: int) -> None:
        nonlocal free
        for size, times in options[o][1].items():
            for _ in range(times):
                at = counts[size] if sign < 0 else counts[size] + 1
                for p in needs[size].get(at, ()):
                    was = short[p]
                    short[p] -= sign
                    if not was or not short[p]:
                        for other in options[p][1]:
                            degree[other] += sign
                counts[size] += sign
            free = free | 1 << size if counts[size] else free & ~(1 << size)

    def search(waste: int, more: int) -> bool:
        nonlocal left, now, free
        if not free:
            return True
        pick = min((s for s in counts if counts[s]), key=lambda s: (degree[s], -s))
        usable = [o for found in needs[pick].values() for o in found if not short[o] and waste + options[o][0] <= allowed and more + above[o] <= spare]
        rng.shuffle(usable)
        usable.sort(key=lambda o: (options[o][0] + above[o], sum(degree[s] for s in options[o][1])))
        for o in usable:
            outside = free
            for size, times in options[o][1].items():
                if counts[size] == times:
                    outside &= ~(1 << size)
            if options[o][2] & outside:
                continue
            left, now = left - 1, now - 1
            if min(left, now) < 0:
                return False
            turn(o, -1)
            laid.append(o)
            if search(waste + options[o][0], more + above[o]):
                return True
            laid.pop()
            turn(o, 1)
            if min(left, now) < 0:
                return False
        return False

    run = 0
    while left > 0:
        run += 1
        counts.update(full)
        short[:] = [0] * len(options)
        degree = {s: sum(map(len, needs[s].values())) for s in counts}
        free, now = sum(1 << s for s in counts), 300 + 30 * run
        laid.clear()
        if search(0, 0):
            return [[s for s, times in options[o][1].items() for _ in range(times)] for o in laid]
        if now >= 0:
            return None  # all of it was searched
    return None


def bin_completion(sizes: list[int], capacity: int = CAPACITY, branches: int = BRANCHES, tail: int = TAIL) -> list[list[int]]:
    """Containers of positions into ``sizes`` (each between 0 and ``capacity``, in any order).

    ``branches`` = 0 leaves the search out.
    """
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (-sizes[i], i))
    zeros = [i for i in range(len(sizes)) if sizes[i] == 0]
    used = [sizes[i] for i in order]
    bins = descend(used, capacity)
    simple = best_fit(used, capacity)
    if len(simple) < len(bins):
        bins = [[used[k] for k in b] for b in simple]
    bound = lower_bound(used, capacity) if branches else len(bins)
    while len(bins) > bound:
        bins.sort(key=lambda b: (sum(b), -len(b)))
        n, items = 0, 0
        while n < len(bins) and (sum(bins[n]) < capacity or items < tail) and items + len(bins[n]) <= 2 * tail:
            items += len(bins[n])
            n += 1
        better = complete([s for b in bins[:n] for s in b], capacity, n - 1, branches) if n > 1 else None
        if better is None:
            break
        bins = better + bins[n:]
    at: dict[int, list[int]] = {}
    for i in reversed(order):
        at.setdefault(sizes[i], []).append(i)
    out = [[at[s].pop() for s in b] for b in bins]
    if zeros:
        out = out or [[]]
        out[-1] += zeros
    return out


def _pack(capacity: int, batch_items: int, branches: int):
    schema = pa.schema([("id", pa.string()), ("piece", pa.int32()), ("size", pa.int64()), ("part", pa.int32()), ("bin", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_bins, held = None, 0, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def close(last: bool) -> list[tuple]:
            nonlocal n_bins, held
            rows, again = [], []
            for chosen in bin_completion([x[2] for x in held], capacity, branches if last else 0):
                if not last and sum(held[i][2] for i in chosen) < capacity - capacity // 64 and len(again) < batch_items // 4:
                    again += [held[i] for i in chosen]
                    continue
                rows += [(*held[i], part, n_bins) for i in chosen]
                n_bins += 1
            held = again
            return rows

        for batch in batches:
            for ident, piece, size, p in zip(*(batch.column(c).to_pylist() for c in ("id", "piece", "size", "part"))):
                part = p
                held.append((ident, piece, size))
                if len(held) >= batch_items and (rows := close(False)):
                    yield out(rows)
        if held and (rows := close(True)):
            yield out(rows)

    return pack


def pack_items(
    items: DataFrame, ident: str, size: Column, *, capacity: int = CAPACITY, batch_items: int = BATCH, branches: int = BRANCHES, items_per_part: int = 8 * BATCH
) -> DataFrame:
    """(id, piece, size, start, container_id): every item in a container, none over capacity.

    An item larger than the capacity, and only such a one, is split: into pieces of the full
    capacity, each a container of its own, and a rest that is packed like any item. ``start`` is
    the piece's offset in the item. Every row is an item, rows with the same id or a null id too;
    an item of null, negative or no size takes part with size 0 and no room. No rows, no
    containers. Which of many equally good packings comes out follows from ids and sizes alone.
    """
    base = items.select(F.col(ident).cast("string").alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    parts = max(1, -(-items.count() // items_per_part))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int") - 1)
    cut = numbered_copies(base, ("id", "size")).select("id", "copy", F.explode(pieces).alias("piece"), "size").select(
        "id", "copy", "piece", F.least(F.col("size") - F.col("piece") * F.lit(capacity), F.lit(capacity)).cast("long").alias("size")
    )
    spread = F.xxhash64("id", "piece", "size", "copy")
    laid = cut.withColumn("h", spread).withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    laid = laid.repartition(parts, "part").sortWithinPartitions("part", "h", "id", "piece", "size").select("id", "piece", "size", "part")
    kinds = "id string, piece int, size long, part int, bin long"
    packed = laid.mapInArrow(_pack(capacity, batch_items, branches), kinds)
    start = (F.col("piece").cast("long") * F.lit(capacity)).alias("start")
    return packed.select("id", "piece", "size", start, F.concat_ws("-", F.col("part").cast("string"), F.col("bin").cast("string")).alias("container_id"))

"""Mixing sources to target weights.

Weights come from a family with one exponent: ``temperature_weights`` raises the sources' shares
to a power between 1, their natural mixture, and 0, all equal; ``tilted_weights`` leads from the
natural mixture q to a given target t, w ~ q (t/q)^a. The exponent is bisected until the weights
meet a target entropy, or as far as no source must be repeated more often than it may. With a
target, the source that stands in the way there is frozen at its limit, the weights of the others
are normalised over what is left, and the exponent is bisected on until the target is reached.

A source's weight is a budget of tokens. It is spent on whole passes over the source and one
partial pass, a block permutation: records are spread over blocks of bounded size by a hash, blocks
are taken one after the other and only the block in which the budget ends is ordered and cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.copies import numbered_copies
from meshwright.runtime import Workspace

#: Records of a block of a permutation; what stands for no limit of repeats.
BLOCK, NO_LIMIT = 4096, (1 << 31) - 1


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature_weights(shares: list[float], exponent: float) -> list[float]:
    raised = [s**exponent if s > 0 else 0.0 for s in shares]
    return [x / sum(raised) for x in raised]


def tilted_weights(natural: list[float], target: list[float], exponent: float) -> list[float]:
    raised = [q * (t / q) ** exponent if q > 0 and t > 0 else 0.0 for q, t in zip(natural, target)]
    total = sum(raised)
    return [x / total if total else 0.0 for x in raised]


def bisect_exponent(holds: Callable[[float], bool], low: float = 0.0, high: float = 1.0, rounds: int = 60) -> float:
    """The greatest exponent in [low, high] up to which ``holds`` is true; ``low`` if it never is."""
    if holds(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent_for_entropy(shares: list[float], goal: float) -> float:
    """The exponent at which the weights have the entropy ``goal``: it falls from that of equal
    weights at 0 to that of the natural mixture at 1."""
    return bisect_exponent(lambda a: entropy(temperature_weights(shares, a)) >= goal)


def exponent_for_limit(natural: list[float], target: list[float], passes: list[float]) -> float:
    """How far the mixture can lead to the target before a source needs more than ``passes``
    times its share; 1 if the target itself is within all limits."""
    return bisect_exponent(lambda a: all(w <= p * q * (1 + 1e-12) for w, q, p in zip(tilted_weights(natural, target, a), natural, passes)))


@dataclass(frozen=True)
class Path:
    """Weights at the end of the way to a target. ``frozen``: {index: exponent at which the source
    met its limit}, ``scale``: what the targets of all others are multiplied by."""

    weights: list[float]
    frozen: dict[int, float]
    scale: float


def follow(natural: list[float], target: list[float], most: list[float], fill: bool) -> Path:
    """From the natural mixture to the target, no weight above ``most``.

    A source at its limit is frozen there and the next stretch of the way starts at the exponent
    reached. With ``fill`` the others share what the frozen leave, in the ratio of their targets, and
    a source that the finished mixture would not bring to its limit after all is set free again; if
    all are frozen the weights add up to less than 1. Without it every source goes its own way.
    """
    frozen = {i: 0.0 for i, (q, t) in enumerate(zip(natural, target)) if q <= 0 or t <= 0}
    none = set(frozen)
    reached = 0.0

    def at(exponent: float) -> dict[int, float]:
        free = [i for i in range(len(target)) if i not in frozen]
        if not fill:
            return {i: natural[i] * (target[i] / natural[i]) ** exponent for i in free}
        left = max(0.0, 1 - sum(most[i] for i in frozen if i not in none))
        return {i: left * w for i, w in zip(free, tilted_weights([natural[i] for i in free], [target[i] for i in free], exponent))}

    def holds(exponent: float) -> bool:
        return all(w <= most[i] * (1 + 1e-12) for i, w in at(exponent).items())

    while not holds(1.0):
        reached = bisect_exponent(holds, reached)
        beyond = at(reached) if not holds(reached) else at(min(1.0, reached + 1e-9))
        tightest = max(w / most[i] if most[i] else math.inf for i, w in beyond.items())
        frozen |= {i: reached for i, w in beyond.items() if (w / most[i] if most[i] else math.inf) >= tightest * (1 - 1e-9)}
    while True:
        free = sum(t for i, t in enumerate(target) if i not in frozen)
        scale = 1.0 if not fill else max(0.0, 1 - sum(most[i] for i in frozen if i not in none)) / free if free else math.inf
        loose = [i for i in frozen if i not in none and scale * target[i] < most[i] * (1 - 1e-12)]
        over = [i for i, t in enumerate(target) if i not in frozen and scale * t > most[i] * (1 + 1e-12)]
        if not loose and not over:
            break
        for i in loose:  # neither step lowers the scale, so this ends
            del frozen[i]
        frozen |= dict.fromkeys(over, 1.0)
    weights = [0.0 if i in none else most[i] if i in frozen else scale * t for i, t in enumerate(target)]
    return Path(weights, {i: a for i, a in frozen.items() if target[i] > 0}, scale)


@dataclass(frozen=True)
class Share:
    """What one source gets. ``wanted`` = target_share * total; ``frozen``: it met its limit on the
    way to the target, at ``exponent``; ``capped``: the limit is below what is wanted, so it did
    so whatever the others gave; ``weight`` of the mixture and ``budget`` in tokens."""

    source: str
    target_share: float
    max_repeats: int | None
    n_records: int
    tokens: int
    wanted: float
    frozen: bool
    capped: bool
    exponent: float
    weight: float
    budget: int


def plan_mixture(targets: list[tuple[str, float | None, int | None]], sizes: dict[str, tuple[int, int]], total: int, *, fill: bool = False) -> list[Share]:
    """Budgets of the target's sources. ``sizes``: source -> (records, tokens); ``total``: all tokens.

    A source that its target share would take beyond ``max_repeats`` passes gets these passes. With
    ``fill`` the mixture has as many tokens as there are in all, if the limits allow that: what such
    a source can't give is shared by the others in the ratio of their targets. Without it they keep
    their share of the total. A null share is none, a null limit is none either; a source without
    tokens gets nothing.
    """
    shares = [max(share or 0.0, 0.0) for _, share, _ in targets]
    tokens = [sizes.get(s, (0, 0))[1] for s, _, _ in targets]
    limits = [math.inf if m is None else max(m, 0) * n for n, (_, _, m) in zip(tokens, targets)]
    path = follow([n / total if total else 0.0 for n in tokens], shares, [x / total if total else 0.0 for x in limits], fill)
    out = []
    for i, ((s, _, most), share, size) in enumerate(zip(targets, shares, tokens)):
        frozen = i in path.frozen
        budget = (limits[i] if size else 0) if frozen else round(path.weights[i] * total)
        out.append(Share(s, share, most, sizes.get(s, (0, 0))[0], size, share * total, frozen, frozen and (limits[i] if size else 0) < share * total, path.frozen.get(i, 1.0), budget / total if total else 0.0, budget))
    return out


def source_sizes(records: DataFrame, source: str, size: str) -> DataFrame:
    """(source, n, tokens): combined on the map side, so a source with most rows is no burden."""
    return records.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("tokens"))


def _fill(block: pa.Table) -> pa.Table:
    """Takes the records of one block in their order as far as each fits into what is left."""
    block = block.sort_by([("h", "ascending"), ("id", "ascending"), ("size", "ascending")])
    left, more = block.column("room")[0].as_py() if block.num_rows else 0, []
    for size in block.column("size").to_pylist():
        fits = size <= left
        left -= size if fits else 0
        more.append(int(fits))
    return block.select(["id", "source", "size", "passes", "most"]).append_column("more", pa.array(more, pa.int32()))


def realise(records: DataFrame, ident: str, source: str, size: str, budgets: list[tuple[str, int, int, int | None]], *, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(id, source, size, repeats) of the records that are used, at least once each.

    ``budgets``: (source, tokens of one pass, budget, max_repeats). A record is used once per
    whole pass and once more if its block comes before the one in which the budget ends; of that
    block records are taken in order as far as they fit. So a source misses its budget by less
    than the smallest record left out there, and none is used more often than max_repeats.
    Which records are used follows from their ids and sizes and from nothing else. Records of
    equal id and size are records of their own; a null or negative size counts as 0.
    Empty input gives no rows.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "mixture")
    base = records.select(F.col(ident).alias("id"), F.col(source).alias("source"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    plan = [(s, int(b // t) if t else 0, int(b - (b // t) * t) if t else 0, NO_LIMIT if m is None else int(m)) for s, t, b, m in budgets]
    wanted = spark.createDataFrame(plan, "source string, passes int, rest long, most int")
    chosen = numbered_copies(base.join(F.broadcast(wanted), "source"), ("id", "source", "size", "passes", "rest", "most"))
    chosen = chosen.withColumn("h", F.xxhash64(F.lit(seed), F.col("id"), F.col("size"), F.col("copy")))
    counts = {r["source"]: r["count"] for r in chosen.groupBy("source").count().collect()}
    blocks = spark.createDataFrame([(s, max(1, -(-n // block))) for s, n in counts.items()], "source string, blocks long")
    placed = chosen.join(F.broadcast(blocks), "source").withColumn("block", F.pmod("h", "blocks"))
    placed = ws.write(placed.select("id", "source", "size", "passes", "rest", "most", "h", "block"), "placed")

    sums = placed.groupBy("source", "block").agg(F.sum("size").alias("tokens")).withColumn("group", F.floor(F.col("block") / block))
    groups = sums.groupBy("source", "group").agg(F.sum("tokens").alias("in_group"))
    ahead = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "group", F.coalesce(F.sum("in_group").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("source", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("local", F.coalesce(F.sum("tokens").over(before), F.lit(0))).join(groups, ["source", "group"])
    starts = starts.select("source", "block", (F.col("base") + F.col("local")).alias("start"), F.col("tokens").alias("in_block"))
    state = placed.join(starts, ["source", "block"])
    whole = F.col("start") + F.col("in_block") <= F.col("rest")
    cut = ~whole & (F.col("start") < F.col("rest"))
    kinds = ", ".join(f"{n} {placed.schema[n].dataType.simpleString()}" for n in ("id", "source", "size")) + ", passes int, most int, more int"
    edge = state.where(cut).select("id", "source", "size", "passes", "most", "h", (F.col("rest") - F.col("start")).alias("room"))
    edge = edge.groupBy("source").applyInArrow(_fill, kinds)
    clear = state.where(~cut).withColumn("more", (whole & (F.col("rest") > 0)).cast("int"))
    columns = ["id", "source", "size", F.least(F.col("passes") + F.col("more"), F.col("most")).alias("repeats")]
    return edge.select(*columns).unionByName(clear.select(*columns)).where("repeats > 0")

"""All similar pairs between set-valued records.

Records with equal sets form a class, and classes are what is compared: copies cost one row.
A class gets a minwise signature, cut into bands; classes that share a bucket of any band are
candidates, once, and the exact overlap of the sets decides. With ``bands`` bands of ``rows`` a
pair of similarity s is missed with probability (1 - s^rows)^bands; both follow from the threshold
so that this is at most ``MISSED`` for every pair that counts (62 bands of 4 rows at 0.8).

A bucket of more than ``bucket`` classes is not paired as a whole. There, two sets that are
similar enough must share one of their rarest items: of x, the smaller, one of the first
|x| - ceil(2t/(1+t)|x|) + 1 and of y one of the first |y| - ceil(t|y|) + 1, items ordered from
rare to frequent. Splitting the bucket by those items keeps every similar pair, and a handful of
items that a third of all records have in common no longer pairs them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm.itemcodes import code, safe_seed
from meshwright.runtime import Workspace

#: Probability that a pair just at the threshold shares no bucket; bands that are made for it.
MISSED, MOST_BANDS = 1e-14, 64
#: Classes of a bucket up to which it is paired as it is.
BUCKET = 48
#: Most frequent items that are ordered by frequency; the order of all others is their code's.
#: It bounds what is broadcast and decides nothing about the result.
ORDERED_ITEMS = 2048


def plan_bands(threshold: float, missed: float = MISSED, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest chance candidates, within ``most`` bands;
    one row and as many bands as it takes where even that needs more."""
    for rows in range(8, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(missed) / math.log1p(-hit))
        if bands <= most or rows == 1:
            return bands, rows
    raise AssertionError


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that leaves no structure (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket of each band for sets laid end to end in ``flat``, each beginning at ``starts``."""
    base = _mix(flat.astype(np.uint64))
    out = np.empty((bands, len(starts)), np.uint64)
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for band in range(bands):
        word = np.full(len(starts), seeds[band], np.uint64)
        for seed in seeds[band * rows : (band + 1) * rows]:
            word = _mix(word ^ np.minimum.reduceat(_mix(base ^ seed), starts))
        out[band] = word
    return out


def _band_rows(bands: int, rows: int):
    schema = pa.schema([("bucket", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("side", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                items = batch.column("items")
                offsets = items.offsets.to_numpy()
                flat = items.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
                words = signatures(flat, offsets[:-1] - offsets[0], bands, rows)
                columns = [words.reshape(-1).view(np.int64), *(np.tile(batch.column(c).to_numpy(), bands) for c in ("cid", "n", "side"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return emit


#: Stands for the partner of a class of a large bucket, whose pairs are made otherwise.
APART = -1


def _pair_up(bucket: int, t: Fraction, two_sided: bool):
    """Rows sorted by bucket and size -> the candidate pairs of small buckets, and the classes of
    large ones, each with ``APART``. A large bucket is passed on as it comes and never held."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

    def out(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (a, b, key)], schema=schema)

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, cid, n, side = rows
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        apart = size > bucket
        yield from out(cid[apart], np.full(apart.sum(), APART), key[apart])
        key, cid, n, side = (x[(size > 1) & ~apart] for x in rows)
        for step in range(1, bucket):
            met = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else ()
            if not len(met):
                return
            far = met + step
            good = n[met] * t.denominator >= n[far] * t.numerator
            if two_sided:
                good &= side[met] != side[far]
            yield from out(cid[met[good]], cid[far[good]], key[met[good]])

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "cid", "n", "side")]
            if hot is not None:
                more = rows[0] == hot
                yield from out(rows[1][more], np.full(more.sum(), APART), rows[0][more])
                if more.all():
                    continue
                rows, hot = [x[~more] for x in rows], None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = rows[0] == rows[0][-1]
            if last.sum() > bucket:
                held, hot = None, rows[0][-1]
                yield from pairs(rows)
            else:
                held = [x[last] for x in rows]
                yield from pairs([x[~last] for x in rows])
        if held is not None:
            yield from pairs(held)

    return pair_up


def _fraction(threshold: float | str) -> Fraction:
    return Fraction(str(threshold))


def _at_least(n: Column, share: Fraction) -> Column:
    """ceil(share * n) in whole numbers."""
    return F.floor((n * F.lit(share.numerator) + F.lit(share.denominator - 1)) / F.lit(share.denominator)).cast("int")


@dataclass
class SimilarSets:
    """``classes``: (cid, side, items, n, rep, n_records); ``members``: (record, cid, side);
    ``links``: (a, b, shared, total) between classes whose sets differ or lie on two sides."""

    classes: DataFrame
    members: DataFrame
    links: DataFrame


def _sides(tables: list[DataFrame], record: str, item: str) -> DataFrame:
    out = None
    for side, df in enumerate(tables):
        part = df.select(F.lit(side).alias("side"), F.col(record).cast("string").alias("record"), F.col(item).cast("string").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out.dropna()


def similar_sets(
    rows: DataFrame,
    record: str,
    item: str,
    threshold: float | str,
    *,
    other: DataFrame | None = None,
    min_items: int = 1,
    bucket: int = BUCKET,
) -> SimilarSets:
    """Classes of equal sets and the links between classes of Jaccard similarity >= threshold.

    ``rows`` holds a row per record and item; the set of a record is that of its distinct
    non-null items, in whatever rows they come. Rows with a null record or item are ignored, so
    a record without items has no set and no links; sets of fewer than ``min_items`` are left
    out. Items are compared exactly, the empty string is an item. The threshold is compared in
    whole numbers and included. With ``other``, pairs have one record of either table and those
    within one table are not looked for. Further columns are ignored; no rows, no pairs.
    """
    t = _fraction(threshold)
    if not 0 < t <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    bands, rows_per_band = plan_bands(float(t))
    ws = Workspace(rows.sparkSession, "setjoin")
    long = _sides([rows] if other is None else [rows, other], record, item)
    counted = ws.write(long.groupBy("item").count(), "items")
    seed = safe_seed(counted, "item")
    frequent = counted.orderBy(F.desc("count"), "item").limit(ORDERED_ITEMS).orderBy("count", F.desc("item")).collect()
    ordered = rows.sparkSession.createDataFrame([(r["item"], i) for i, r in enumerate(frequent)], "item string, place long")
    coded = long.join(F.broadcast(ordered), "item", "left").select("side", "record", F.coalesce("place", code(F.col("item"), seed)).alias("h"))
    sets = ws.write(coded.groupBy("side", "record").agg(F.sort_array(F.collect_set("h")).alias("items")).where(F.size("items") >= min_items), "sets")

    grouped = sets.groupBy("side", "items").agg(F.min("record").alias("rep"), F.count(F.lit(1)).alias("n_records"))
    classes = ws.write(grouped.select(F.monotonically_increasing_id().alias("cid"), "side", "items", F.size("items").alias("n"), "rep", "n_records"), "classes")
    members = sets.join(classes.select("side", "items", "cid"), ["side", "items"]).select("record", "cid", "side")

    banded = classes.select("cid", "items", "n", "side").mapInArrow(_band_rows(bands, rows_per_band), "bucket long, cid long, n int, side int")
    laid = banded.repartition("bucket").sortWithinPartitions("bucket", "n", "cid")
    met = ws.write(laid.mapInArrow(_pair_up(bucket, t, other is not None), "a long, b long, bucket long"), "met")

    large = met.where(F.col("b") == APART).select(F.col("a").alias("cid"), "bucket").join(classes.select("cid", "items", "n", "side"), "cid")
    first = large.withColumn("item", F.explode(F.slice("items", F.lit(1), F.col("n") - _at_least(F.col("n"), 2 * t / (1 + t)) + 1))).drop("items")
    probe = large.withColumn("item", F.explode(F.slice("items", F.lit(1), F.col("n") - _at_least(F.col("n"), t) + 1))).drop("items")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    match = smaller & (F.col("x.n") * F.lit(t.denominator) >= F.col("y.n") * F.lit(t.numerator)) & (F.lit(True) if other is None else F.col("x.side") != F.col("y.side"))
    match = match & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.item") == F.col("y.item"))
    split = first.alias("x").join(probe.alias("y"), match).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    found = met.where(F.col("b") != APART).select("a", "b").unionByName(split).distinct()

    left = classes.select(F.col("cid").alias("a"), F.col("items").alias("ia"), F.col("n").alias("na"))
    right = classes.select(F.col("cid").alias("b"), F.col("items").alias("ib"), F.col("n").alias("nb"))
    held = found.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("ia", "ib"))).withColumn("total", F.col("na") + F.col("nb") - F.col("shared"))
    links = held.where(F.col("shared") * F.lit(t.denominator) >= F.col("total") * F.lit(t.numerator)).select("a", "b", "shared", "total")
    return SimilarSets(classes, members, ws.write(links, "links"))


def record_pairs(found: SimilarSets, *, within: bool = True) -> DataFrame:
    """(a, b) of records: links spread over the members of both classes, and the pairs of equal
    sets. Within one table a < b; between two tables (``within=False``) a is of the first."""
    m = found.members
    ma, mb = m.select(F.col("cid").alias("a"), F.col("record").alias("ra"), F.col("side").alias("sa")), m.select(F.col("cid").alias("b"), F.col("record").alias("rb"))
    across = found.links.select("a", "b").join(ma, "a").join(mb, "b")
    if not within:
        turn = F.col("sa") == 0
        return across.select(F.when(turn, F.col("ra")).otherwise(F.col("rb")).alias("a"), F.when(turn, F.col("rb")).otherwise(F.col("ra")).alias("b"))
    many = found.classes.where("n_records > 1").select(F.col("cid").alias("a"))
    again = m.select(F.col("cid").alias("a"), F.col("record").alias("rb"))
    same = many.join(ma, "a").join(again, "a").where(F.col("ra") < F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return across.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).unionByName(same)


def record_classes(found: SimilarSets) -> DataFrame:
    """(record, class_id, n_links): the class, named by its least record, and how many records
    it is similar to, copies included; no pair of copies is made."""
    sizes = found.classes.select(F.col("cid").alias("b"), "n_records")
    both = found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n_records").alias("linked"))
    classes = found.classes.join(linked, "cid", "left").select("cid", F.col("rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("n_records") - 1).alias("n_links"))
    return found.members.join(classes, "cid").select("record", "class_id", "n_links")

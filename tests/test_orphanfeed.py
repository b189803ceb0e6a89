import os
import random

from meshwright.streaming.orphanfeed import FEED_SCHEMA, OrphanFeed


def brute(batches):
    alive, refs, events = {}, {}, []
    for k, rows in enumerate(batches):
        new = {}
        for seq, _, kind, space, key, row, field in sorted((r for r in rows if None not in (r[3], r[4])), key=lambda r: r[0]):
            if kind in ("parent", "gone"):
                alive[(space, key)] = kind == "parent"
            else:
                new[(row, field, space, key)] = kind == "reference"
        for ref, there in new.items():
            if there:
                refs.setdefault(ref, None)
            else:
                refs.pop(ref, None)
        for ref, was in list(refs.items()):
            now = not alive.get(ref[2:], False)
            if was is None and now:
                events.append((k, *ref, "opened"))
            elif was is not None and was != now:
                events.append((k, *ref, "reopened" if now else "resolved"))
            refs[ref] = now
    return sorted(r for r, o in refs.items() if o), sorted(events)


def feed(seed, n_batches):
    rng, seq, out = random.Random(seed), 0, []
    for period in range(n_batches):
        rows = []
        for _ in range(40):
            seq += 1
            kind = rng.choice(["parent", "gone", "reference", "reference", "withdrawn"])
            ref = kind in ("reference", "withdrawn")
            rows.append((seq, period, kind, rng.choice(["id", "name"]), rng.choice([*"abcdefgh", "", "hot", "hot", None]), rng.randrange(12) if ref else None, "src" if ref else None))
        out.append(rows + rows[:3])
    return out


def test_deletions_reopen(spark, tmp_path):
    batches = feed(2, 5)
    watch = OrphanFeed(spark, f"file://{tmp_path}/state", buckets=4)
    for k, rows in enumerate(batches):
        watch.apply(spark.createDataFrame(rows, FEED_SCHEMA), k)
    watch.apply(spark.createDataFrame(batches[-1], FEED_SCHEMA), len(batches) - 1)  # run again after a failure
    open_, events = brute(batches)
    assert sorted(map(tuple, OrphanFeed(spark, watch.folder, 4).open_references().collect())) == open_
    assert sorted((r.batch, r.row_id, r.field, r.space, r.key, r.event) for r in watch.events().collect()) == events
    assert {"opened", "resolved", "reopened"} == {e[-1] for e in events}


def test_only_touched_buckets_are_written(spark, tmp_path):
    watch = OrphanFeed(spark, f"file://{tmp_path}/state", buckets=16)
    watch.apply(spark.createDataFrame([(i, 0, "parent", "id", f"k{i}", None, None) for i in range(100)], FEED_SCHEMA), 0)
    watch.apply(spark.createDataFrame([(101, 1, "reference", "id", "k1", 7, "src"), (102, 1, "gone", "id", "k1", None, None)], FEED_SCHEMA), 1)
    assert len([x for x in os.listdir(f"{tmp_path}/state/parents/v=1") if x.startswith("bucket=")]) == 1
    assert [tuple(r) for r in watch.open_references().collect()] == [(7, "src", "id", "k1")]
    watch.apply(spark.createDataFrame([], FEED_SCHEMA), 2)
    assert watch.version == 2 and watch.open_references().count() == 1
    assert OrphanFeed(spark, f"file://{tmp_path}/none", 4).open_references().count() == 0


def test_as_a_stream(spark, tmp_path):
    batches = feed(3, 3)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(FEED_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    watch = OrphanFeed(spark, f"file://{tmp_path}/state", buckets=4)
    watch.start(stream, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, watch.open_references().collect())) == brute(batches)[0]

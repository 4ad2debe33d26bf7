import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import merges, pacing
from lumenfold.streaming import flows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def starts(rows, most, window):
    """(id, start) call by call."""
    out, last = {}, {}
    for key, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        own = last.setdefault(key, [])
        own.append(max(at, own[-most] + window) if len(own) >= most else at)
        out[i] = own[-1]
    return out


@pytest.mark.parametrize(("most", "window"), [(1, 7), (3, 50)])
def test_paced_equals_a_queue(spark, most, window):
    rng = random.Random(most)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(0, 3000), i) for i in range(500)] + [("hot", 1000, 500 + i) for i in range(40)] + [("hot", None, 900)]
    out = pacing.paced(spark.createDataFrame(rows, "key string, arrival long, id long"), "key", "arrival", "id", most, window).collect()
    assert {r["id"]: r["start"] for r in out} == starts(rows, most, window) | {900: None} and len(out) == len(rows)
    with pytest.raises(ValueError):
        pacing.paced(spark.createDataFrame(rows, "key string, arrival long, id long"), "key", "arrival", "id", 0, 1)


def test_unforgiven_equals_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.choice(["bad", "good", "other"]), i) for i in range(300)]
    events = spark.createDataFrame(rows, "key long, at long, kind string, id long")
    got = {r["id"] for r in pacing.unforgiven(events, "key", "at", F.col("kind") == "bad", F.col("kind") == "good", 5).collect()}
    want = {i for k, a, kind, i in rows if kind == "bad" and not any(k is not None and a is not None and x == "good" and k == h and b is not None and a <= b <= a + 5 for h, b, x, _ in rows)}
    assert got == want


def test_canonical_ids_through_chains_and_circles(spark):
    frame = lambda rows: spark.createDataFrame(rows, "old long, kept long")
    chain = [(i, i - 1) for i in range(1, 40)] + [(100, 101), (102, 101), (101, 5), (7, 6), (200, 200), (None, 3), (3, None)]
    got = {r["old"]: r["kept"] for r in merges.canonical(frame(chain)).collect()}
    assert got == dict.fromkeys([*range(1, 40), 100, 101, 102], 0)
    for circle in ([(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 1), (9, 1)], [(i, (i + 1) % 7) for i in range(7)] + [(20, 3)], [(i, (i + 1) % 8) for i in range(8)]):
        with pytest.raises(ValueError, match="circle"):
            merges.canonical(frame(circle))
    with pytest.raises(ValueError, match="several"):
        merges.canonical(frame([(1, 2), (1, 3)]))
    assert merges.canonical(frame([])).collect() == []


def test_members_meet_once_under_their_group(spark):
    members = spark.createDataFrame([(0, 1, "own"), (1, 1, "moved"), (2, 1, "later"), (2, 2, "first"), (3, 2, "second"), (9, 1, "apart"), (None, 1, "null")], "group_id long, file_id long, note string")
    steps = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "old long, kept long")
    got = sorted((tuple(r) for r in merges.reparented(members, steps).collect()), key=str)
    assert got == sorted([(0, 1, "own"), (0, 2, "first"), (9, 1, "apart"), (None, 1, "null")], key=str)
    groups = spark.createDataFrame([(5, "k", 2), (6, "k", 1), (7, "k", 1), (8, None, 0), (9, None, 0)], "group_id long, key string, since long")
    assert sorted(tuple(r) for r in merges.merges_by_key(groups, "key", ["since"]).collect()) == [(5, 6), (7, 6)]


def files(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_paced_stream_restarts_where_it_was(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng = random.Random(8)
    rows = sorted([(rng.choice(["a", "b"]), i, rng.randrange(0, 900)) for i in range(120)], key=lambda r: r[2])
    schema, out = "key string, id long, arrival long", {}
    for part in (rows[:50], rows[50:]):
        files(spark, part, schema, tmp_path / "in")
        stream = flows.paced_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3, 60)
        query = stream.writeStream.foreachBatch(lambda df, _: out.update({r["id"]: r["start"] for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    assert out == starts([(k, a, i) for k, i, a in rows], 3, 60)


def test_final_failures_come_once_after_grace_and_restart(spark, tmp_path):
    t0, out = datetime(2024, 1, 1, 12), []
    at = lambda minutes: t0 + timedelta(minutes=minutes)
    schema = "file string, at timestamp, job long"
    bad = [[("saved", at(0), 1), ("lost", at(0), 2), ("late", at(1), 3)], [("again", at(20), 4), ("end", at(60), 90)], [("end", at(200), 91)]]
    good = [[("saved", at(4), 11), ("other", at(1), 12)], [("late", at(7), 13), ("end", at(60), 92)], [("end", at(200), 93)]]
    for a, b in zip(bad, good):  # each round is a restart from the checkpoint
        files(spark, a, schema, tmp_path / "bad")
        files(spark, b, schema, tmp_path / "good")
        read = lambda which: spark.readStream.schema(schema).parquet(str(tmp_path / which))
        stream = flows.final_failures(read("bad"), read("good"), "file", "at")
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(r["job"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    assert sorted(j for j in out if j < 90) == [2, 3, 4] and len(out) == len(set(out))


def test_keyed_sink_replays_and_restarts(spark, tmp_path):
    schema, path = "id long, version long, text string", str(tmp_path / "sink")
    sink = flows.KeyedSink(path, ["id"], ["version"], F.length("text") < 9)
    rounds = [[(1, 1, "one"), (2, 1, "two"), (1, 2, "one b"), (None, 1, "x"), (3, 1, "far too long")], [(2, 0, "older"), (3, 2, "three"), (1, 3, None)], [(4, 1, "four"), (2, 5, "two b")]]
    seen = {}

    def each(df, number):
        sink(df, number)
        seen[number] = [tuple(r) for r in df.collect()]
        if number == 1:
            sink(df, number)  # the batch comes again

    for k, rows in enumerate(rounds):
        files(spark, rows, schema, tmp_path / "in")
        query = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        if k == 1:
            sink.compact(spark, 0)
            sink.compact(spark, 1)
            sink.compact(spark, 1)
    sink(spark.createDataFrame(seen[2], schema), 2)
    want = {1: (2, "one b"), 2: (5, "two b"), 3: (2, "three"), 4: (1, "four")}
    assert {r["id"]: (r["version"], r["text"]) for r in sink.current(spark).collect()} == want
    failed = sorted((tuple(r[c] for c in ("id", "error", "status", "batch")) for r in sink.failed(spark).collect()), key=str)
    assert failed == sorted([(None, "no key", "failed", 0), (3, "not valid", "failed", 0), (1, "not valid", "failed", 1)], key=str)


def test_insert_if_absent(spark, tmp_path):
    sink = flows.KeyedSink(str(tmp_path / "sink"), ["id"], ["at"], absent_only=True)
    frame = lambda rows: spark.createDataFrame(rows, "id long, at long")
    for number, rows in ((0, [(1, 9), (1, 5)]), (1, [(1, 1), (2, 3)]), (1, [(1, 1), (2, 3)]), (2, [(2, 1), (3, 1)])):
        sink(frame(rows), number)
    sink.compact(spark, 1)
    assert sorted((r["id"], r["at"]) for r in sink.current(spark).collect()) == [(1, 5), (2, 3), (3, 1)]


def test_counters_of_the_same_pass(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "failed").when(F.col("id") % 3 == 0, "skipped").otherwise("applied").alias("outcome"))
    spark.sparkContext.setJobGroup("counted", "one write")
    got = flows.written_with_counters(rows, str(tmp_path / "out"), {x: F.col("outcome") == x for x in ("applied", "skipped", "failed", "unknown")})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setJobGroup("rest", "")
    counts = {r["outcome"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count().collect()}
    assert got == counts | {"unknown": 0}

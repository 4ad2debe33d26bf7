import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from lumenfold.plans.registry import QUERIES
from lumenfold.streaming import states


def brute(rows):
    out = {}
    for key, _, target in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out[key] = states.step(*out.get(key, (None, 0)), target)
    return out


@pytest.mark.parametrize("ranges", [1, 23])
def test_fold_of_long_logs(spark, ranges):
    """Keys over many ranges, keys of one event, negative places, ties, a null key, more failures than the machine distinguishes."""
    rng = random.Random(2)
    targets = [*states.TRANSITIONS, "failed_retryable", "failed_retryable", "unknown", None]
    rows = [(rng.randrange(3), i * 5 - 900, rng.choice(targets)) for i in range(600)] + [(9, 5, "failed_retryable"), (9, 6, "processing"), (9, 7, "failed_retryable"), (None, 3, "processing"), (None, 4, "completed")]
    rows += [(100 + i, rng.randrange(9), rng.choice(targets)) for i in range(60)] + [(50, 7, "processing"), (50, 7, "completed")]
    rows = [(k, s, t if t in states.TRANSITIONS else None) for k, s, t in rows]
    got = states.fold(spark.createDataFrame(rows, "key long, seq long, target string").repartition(3), ranges)
    found = {r["key"]: (r["state"], r["failures"], r["moves"]) for r in got.collect()}
    want = brute(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or "")))
    assert {k: v[:2] for k, v in found.items()} == want and {k: v[2] for k, v in found.items()} == {k: sum(r[0] == k for r in rows) for k in want}
    assert states.fold(got.select("key", F.lit(1).alias("seq"), F.col("state").alias("target")).where("false")).collect() == []


def test_fold_equals_steps(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), (F.col("event_id") * 1000).alias("seq"), states.target_of(F.col("event_type")).alias("target"))
    rows = [tuple(r) for r in events.collect()]
    assert {r["key"]: (r["state"], r["failures"]) for r in states.fold(events).collect()} == brute(rows)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), states.target_of(F.col("event_type")).alias("target")).where("key < 40")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = states.stream_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    want = brute([tuple(r) for r in events.collect()])
    for _ in range(120):  # state with a time to live keeps the query going
        got = {r["key"]: (r["state"], r["failures"]) for r in spark.table("states").collect()}
        if got == want or query.awaitTermination(1):
            break
    query.stop()
    assert got == want


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    last = events.agg((F.max("at") + F.expr("INTERVAL 30 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("user_id"), "at")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = states.debounced(stream, "at", "user_id", "4 hours").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("sessions").agg(F.count("*").alias("n"), F.sum("n").alias("events")).first()
    want = QUERIES["session_debounce"](spark, SF).agg(F.count("*").alias("n"), F.sum("n").alias("events")).first()
    assert tuple(got) == tuple(want)

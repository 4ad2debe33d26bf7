from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenfold.operators import moves
from lumenfold.streaming import states


def test_outcomes_and_placements(spark):
    files = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (None, "a")], "file_id long, subject_id string")
    subjects = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "subject_id string")
    blocking = spark.createDataFrame([(2,), (2,), (3,), (None,)], "file_id long")
    wanted = spark.createDataFrame([(1, "b", True, None, "x"), (2, "b", None, None, "x"), (2, "a", False, True, "x"), (3, None, True, True, "x"), (9, "b", True, True, "x"), (None, "b", True, True, "x")], "file_id long, subject_id string, by_person boolean, confirmed boolean, outcome_note string")
    out = moves.move_outcomes(wanted, files, subjects, blocking)
    assert sorted((str(r["file_id"]), str(r["subject_id"]), r["outcome"]) for r in out.collect()) == sorted([("1", "b", "moved"), ("2", "b", "needsConfirmation"), ("2", "a", "moved"), ("3", "None", "failed"), ("9", "b", "notFound"), ("None", "b", "notFound")])
    history = spark.createDataFrame([(1, "a", "low", 0.2)], "file_id long, subject_id string, level string, confidence double")
    assert sorted(tuple(r) for r in moves.placements(history, out).collect()) == [(1, "a", "low", 0.2), (1, "b", "high", 1.0), (2, "a", "medium", 0.75)]
    assert moves.move_outcomes(wanted.limit(0), files, subjects, blocking).count() == 0


def test_expiry(spark):
    now = datetime(2024, 3, 1)
    rows = [(i, now + timedelta(days=days) if days is not None else None, status) for i, (days, status) in enumerate([(1, "pending"), (-1, "pending"), (-1, "done"), (-31, "done"), (-31, "pending"), (None, "pending"), (-30, "pending"), (-1, None)])]
    out = moves.expire(spark.createDataFrame(rows, "id long, until timestamp, status string"), "until", F.lit(now).cast("timestamp"))
    assert {r["id"]: r["status"] for r in out.collect()} == {0: "pending", 1: "expired", 2: "done", 5: "pending", 6: "expired", 7: None}


def test_messages_that_come_again_are_dropped_after_a_restart(spark, tmp_path):
    t0, seen = datetime(2024, 1, 1), []
    schema = "account string, message long, at timestamp"
    for rows in ([("a", 1, t0), ("a", 1, t0), ("b", 1, t0)], [("a", 1, t0 + timedelta(hours=2)), ("a", 2, t0 + timedelta(hours=2))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = states.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", ["account", "message"])
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r["account"], r["message"]) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(seen) == [("a", 1), ("a", 2), ("b", 1)]

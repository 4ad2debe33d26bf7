import pytest
from pyspark.sql import functions as F

from lumenfold.operators import lifecycle as L
from lumenfold.sources import sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_appended_keeps_what_is_there(spark):
    history = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), (None, 2, 1)], "k string, v int, revision long")
    new = spark.createDataFrame([("a", 9), ("a", 7), ("b", 3), (None, 4)], "k string, v int")
    assert rows(L.appended(history, new, "k", "v")) == sorted([("a", 1, 1), ("a", 5, 2), (None, 2, 1), ("a", 7, 3), ("a", 9, 4), ("b", 3, 1), (None, 4, 2)], key=repr)
    assert rows(L.appended(history, new.where("false"), "k", "v")) == rows(history)


def test_archive_and_cascade(spark):
    files = spark.createDataFrame([(1, "active"), (2, "active"), (None, "active")], "id long, status string")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    proposals = spark.createDataFrame([(1, "pending"), (1, "approved"), (2, "pending"), (None, "pending")], "id long, status string")
    assert rows(L.archived(files, gone, "id")) == sorted([(1, "archived"), (2, "active"), (None, "active")], key=repr)
    assert rows(L.cascaded(proposals, gone, "id")) == sorted([(1, "rejected"), (1, "approved"), (2, "pending"), (None, "pending")], key=repr)
    assert rows(L.archived(files, gone.where("false"), "id")) == rows(files)


def test_guard_names_children_first(spark):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert rows(L.delete_guard(one(1, 2, 3, 4), one(1, 1, 2), one(2, 3, 3), "id")) == [(1, "has_children"), (2, "has_children"), (3, "has_files"), (4, None)]


def test_lost_jobs_are_taken_up_again(spark):
    files = spark.sql("select id, timestamp_ntz'2024-01-01 00:00:00' as created from range(4) union all select 9, timestamp_ntz'2024-02-01 00:00:00'")
    jobs = spark.sql("select 1L as id, timestamp_ntz'2024-01-09 13:00:00' as started union all select 2L, timestamp_ntz'2024-01-09 11:00:00'")
    done = spark.sql("select 3L as id")
    scan = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert rows(L.unprocessed(files, done, jobs, "id", scan).select("id")) == [(0,), (2,)]


def test_recognition_gates(spark):
    words = spark.createDataFrame([(1, "w" * 30, 60.0), (1, None, -1.0), (2, "w" * 30, 20.0), (3, "ab", 99.0), (4, "w" * 30, -1.0), (4, "x", None)], "page long, word string, c double")
    assert rows(L.recognition(words, "page", "c", "word")) == [(1, 30, 0.6, "named"), (2, 30, 0.2, "uncertain"), (3, 2, 0.99, "too_short"), (4, 31, None, "uncertain")]


def test_report_counts_copies_and_jobs(spark):
    files = spark.createDataFrame([(1, "pdf", "t", 100), (2, "pdf", "t", 100), (3, "pdf", None, None), (4, "txt", "u", 3)], "id long, ext string, text string, n long")
    jobs = spark.createDataFrame([(1,), (1,), (4,), (8,)], "id long")
    got = L.progress_report(files, jobs, "id", "ext", "text", "n", F.col("n") >= 10)
    assert rows(got) == [("pdf", 3, 2, 0.666667, 100.0, 1, 0.666667), ("txt", 1, 0, 0.0, None, 0, 1.0)]
    assert rows(L.progress_report(files.where("false"), jobs, "id", "ext", "text", "n", F.lit(True))) == []


def test_replay_and_zero_filled(spark):
    files = spark.createDataFrame([(1, "active", "x"), (2, "archived", "y"), (3, None, "z")], "file_id long, status string, text string")
    stages = {"metadata": F.length("text"), "text": F.upper("text"), "other": F.lit(1)}
    assert rows(L.replay(files, stages)) == [(1, "metadata", "1"), (1, "text", "X")]
    with pytest.raises(ValueError):
        L.replay(files, stages, ["nothing"])
    assert rows(L.zero_filled(spark.createDataFrame([("b", 3), ("z", 1)], "r string, n long"), ["a", "b"], "r")) == [("a", 0), ("b", 3)]


def test_candidates_are_linear(spark):
    files = spark.createDataFrame([(i, "s") for i in range(2, 40)] + [(1, ""), (50, None), (60, "t"), (2, "s")], "id long, stem string")
    assert rows(L.version_candidates(files, "id", F.col("stem"))) == sorted([(2, i) for i in range(3, 40)], key=repr)


def test_new_numbers_pass_those_that_are_there(spark):
    paths = ["x.pdf", "X.pdf", "x (2).pdf", "x.pdf", "x (2).pdf", "y", "y", "a.b/x", "a.b/x", None, None]
    got = [r["path"] for r in sinks.disambiguated(spark.createDataFrame(list(enumerate(paths)), "id int, path string"), "path", "id").orderBy("id").collect()]
    assert got == ["x.pdf", "X (3).pdf", "x (2).pdf", "x (4).pdf", "x (2) (2).pdf", "y", "y (2)", "a.b/x", "a.b/x (2)", None, None]

"""What happens to files over time: histories that only grow, archives with their proposals, delete guards, recovery, gates and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def appended(history: DataFrame, new: DataFrame, key: str, order: str, number: str = "revision") -> DataFrame:
    """``history`` as it is, and ``new`` after it: numbers go on from each key's last. Earlier rows are never changed.

    Null keys are a key of their own. Numbers come from a sort by key, of the new rows only."""
    last = history.groupBy(F.col(key).alias("_key")).agg(F.max(number).alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fresh = new.withColumn("_place", place).join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    return history.unionByName(fresh.withColumn(number, (F.coalesce("_last", F.lit(0)) + F.col("_place")).cast("long")).select(history.columns))


def archived(files: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Files of ``gone`` get the status archived, no row is deleted. Repeated or null keys of ``gone`` change nothing more."""
    marks = gone.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return files.join(marks, key, "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def cascaded(proposals: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Pending proposals of archived files are rejected; decided ones and those of other files stay."""
    marks = gone.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    changed = F.when(F.col("_gone") & (F.col("status") == "pending"), "rejected").otherwise(F.col("status"))
    return proposals.join(marks, key, "left").withColumn("status", changed).drop("_gone")


def delete_guard(nodes: DataFrame, children: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Adds ``guard``: has_children, has_files, or null where a node may be deleted. Children and files are reduced to their keys first."""
    some = lambda df, name: df.select(F.col(key)).distinct().withColumn(name, F.lit(True))
    joined = nodes.join(some(children, "_children"), key, "left").join(some(files, "_files"), key, "left")
    return joined.withColumn("guard", F.when(F.col("_children"), "has_children").when(F.col("_files"), "has_files")).drop("_children", "_files")


def unprocessed(files: DataFrame, done: DataFrame, jobs: DataFrame, key: str, scan: Column, hours: int = 24) -> DataFrame:
    """Files from before the scan without a result and without a job that is younger than ``hours``; older jobs are taken as lost."""
    alive = jobs.where(F.col("started") > scan - F.make_dt_interval(hours=F.lit(hours))).select(key)
    return files.where(F.col("created") < scan).join(done.select(key), key, "left_anti").join(alive, key, "left_anti")


#: Below this mean confidence a recognised text gives no name; so few characters are no text.
NAMING_FLOOR, LEAST_CHARS = 0.55, 20


def recognition(words: DataFrame, key: str, confidence: str, word: str) -> DataFrame:
    """(key, chars, confidence, gate): the mean of the words' confidences of 0 or more, as a share of 100; null if there are none.

    Gate: too_short, uncertain or named. Null words have no characters."""
    known = F.when(F.col(confidence) >= 0, F.col(confidence))
    found = words.groupBy(key).agg(F.coalesce(F.sum(F.length(word)), F.lit(0)).cast("long").alias("chars"), (F.avg(known) / 100).alias("mean"))
    gate = F.when(F.col("chars") < LEAST_CHARS, "too_short").when(F.col("mean") >= NAMING_FLOOR, "named").otherwise("uncertain")
    return found.select(key, "chars", F.round("mean", 6).alias("confidence"), gate.alias("gate"))


def progress_report(files: DataFrame, jobs: DataFrame, key: str, group: str, content: str, chars: str, readable: Column) -> DataFrame:
    """By ``group``: files, how many of them are readable and that share, mean characters of the readable, copies of a content, jobs a file.

    Jobs are counted by file before the join; copies come from two aggregations, so a much-copied content is one row. Null contents are no copies."""
    by_file = jobs.groupBy(key).agg(F.count("*").alias("_jobs"))
    rows = files.join(by_file, key, "left").withColumn("_readable", F.coalesce(readable, F.lit(False)))
    sums = [F.count("*").alias("n"), F.count_if("_readable").alias("r"), F.sum(F.when(F.col("_readable"), F.col(chars))).alias("c"), F.sum(F.coalesce("_jobs", F.lit(0))).alias("j")]
    contents = rows.groupBy(group, F.sha2(F.col(content).cast("binary"), 256).alias("h")).agg(*sums)
    copies = F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1).otherwise(0)).alias("copies")
    total = contents.groupBy(group).agg(F.sum("n").alias("files"), F.sum("r").alias("readable"), F.sum("c").alias("c"), copies, F.sum("j").alias("jobs"))
    return total.select(group, "files", "readable", F.round(F.col("readable") / F.col("files"), 6).alias("recall"), F.round(F.col("c") / F.col("readable"), 6).alias("mean_chars"), "copies", F.round(F.col("jobs") / F.col("files"), 6).alias("jobs_per_file"))


#: What a replay does where no stages are named.
REPLAYED = ("metadata", "text")


def replay(files: DataFrame, stages: dict[str, Column], names: Sequence[str] = REPLAYED) -> DataFrame:
    """Runs the named stages again over the active files: a row a file and stage with what the stage gives, as a string. An unknown stage raises."""
    if unknown := set(names) - set(stages):
        raise ValueError(f"no such stages: {sorted(unknown)}")
    results = F.array(*(F.struct(F.lit(n).alias("stage"), stages[n].cast("string").alias("result")) for n in names))
    return files.where("status = 'active'").select("file_id", F.inline(results))


def zero_filled(counts: DataFrame, domain: Sequence[str], name: str) -> DataFrame:
    """One row for each value of a fixed domain, 0 where ``counts`` (name, n) has none."""
    every = counts.sparkSession.createDataFrame([(x,) for x in domain], f"{name} string")
    return F.broadcast(every).join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def version_candidates(files: DataFrame, key: str, stem: Column) -> DataFrame:
    """(older, newer): each file with the first of its stem. Pairs grow with the files, not with the square of a stem's group. Blank stems have none."""
    named = files.select(F.col(key).alias("newer"), stem.alias("stem")).where("stem <> ''")
    first = named.groupBy("stem").agg(F.min("newer").alias("older"))
    return named.join(first, "stem").where("older <> newer").select("older", "newer").distinct()

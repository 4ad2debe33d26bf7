"""Bulk moves of files with their outcomes, and rows that expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a placement by a person or by a rule is worth.
BY_PERSON, BY_RULE = ("high", 1.0), ("medium", 0.75)


def move_outcomes(moves: DataFrame, files: DataFrame, subjects: DataFrame, blocking: DataFrame) -> DataFrame:
    """``moves`` (file_id, subject_id, by_person, confirmed) with their ``outcome``: notFound, failed (no such subject), needsConfirmation (something stands against it, and nobody has confirmed), or moved.

    files: file_id, subject_id. blocking: file_id of every file with a blocking finding, repeats allowed. Every side is reduced to its keys before its join; null ids are never found. A file that is there already is moved again,
    as a person's choice is a fact of its own."""
    known = files.select("file_id").distinct().withColumn("_there", F.lit(True))
    places = subjects.select("subject_id").distinct().withColumn("_place", F.lit(True))
    stopped = blocking.select("file_id").distinct().withColumn("_stop", F.lit(True))
    joined = moves.join(known, "file_id", "left").join(places, "subject_id", "left").join(stopped, "file_id", "left")
    outcome = F.when(F.col("_there").isNull(), "notFound").when(F.col("_place").isNull(), "failed").when(F.col("_stop") & ~F.coalesce("confirmed", F.lit(False)), "needsConfirmation").otherwise("moved")
    return joined.select(*moves.columns, outcome.alias("outcome"))


def placements(history: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``history`` (file_id, subject_id, level, confidence) as it is, and a new row for each file that was moved: high and 1.0 by a person, else medium and 0.75."""
    person = F.coalesce("by_person", F.lit(False))
    new = outcomes.where("outcome = 'moved'").select("file_id", "subject_id", F.when(person, BY_PERSON[0]).otherwise(BY_RULE[0]).alias("level"), F.when(person, BY_PERSON[1]).otherwise(BY_RULE[1]).alias("confidence"))
    return history.unionByName(new)


def expire(rows: DataFrame, expires: str, now: Column, status: str = "status", keep_days: int = 30) -> DataFrame:
    """Rows whose time is over get the status ``expired``, settled ones (any status but pending) keep theirs; rows that are over for more than ``keep_days`` go. Null times never end."""
    over = F.coalesce(F.col(expires) < now, F.lit(False))
    gone = F.coalesce(F.col(expires) < now - F.make_dt_interval(days=F.lit(keep_days)), F.lit(False))
    return rows.where(~gone).withColumn(status, F.when(over & (F.col(status) == "pending"), "expired").otherwise(F.col(status)))

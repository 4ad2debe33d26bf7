"""Rename proposals: what to propose, what is superseded, reviews by confidence, and what may be applied by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"low": 0, "medium": 1, "high": 2}


def rank(level: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[level], F.lit(-1))


def decided(files: DataFrame, history: DataFrame) -> DataFrame:
    """files: file_id, current_name, proposed_name, confidence, readable, has_title. history: file_id, proposal_id, proposed_name, status.

    Adds decision: unreadable, uncertain, unchanged, rejected_before, pending_already or propose. History is reduced to one row a file before the join."""
    same = history.join(files.select("file_id", F.col("proposed_name").alias("_now")), "file_id").groupBy("file_id").agg(
        F.bool_or((F.col("status") == "rejected") & (F.col("proposed_name") == F.col("_now"))).alias("_rejected"),
        F.bool_or((F.col("status") == "pending") & (F.col("proposed_name") == F.col("_now"))).alias("_pending"),
    )
    rule = (
        F.when(~F.col("readable"), "unreadable")
        .when((F.col("confidence") == "low") & ~F.col("has_title"), "uncertain")
        .when(F.col("proposed_name").isNull() | (F.col("proposed_name") == F.col("current_name")), "unchanged")
        .when(F.coalesce("_rejected", F.lit(False)), "rejected_before")
        .when(F.coalesce("_pending", F.lit(False)), "pending_already")
        .otherwise("propose")
    )
    return files.join(same, "file_id", "left").withColumn("decision", rule).drop("_rejected", "_pending")


def superseded(history: DataFrame, new: DataFrame) -> DataFrame:
    """Other pending proposals of files that get a new one are superseded; nothing else changes."""
    fresh = new.where("decision = 'propose'").select("file_id", F.lit(True).alias("_new"))
    changed = F.when((F.col("status") == "pending") & F.col("_new"), "superseded").otherwise(F.col("status"))
    return history.join(fresh, "file_id", "left").withColumn("status", changed).drop("_new")


def reviewed(history: DataFrame, band: Column, status: str) -> DataFrame:
    """Pending proposals inside a confidence band are approved or rejected; others are left alone."""
    return history.withColumn("status", F.when((F.col("status") == "pending") & band, status).otherwise(F.col("status")))


def auto_applies(opted_in: Column, read_only: Column, level: Column, least: str = "high") -> Column:
    return opted_in & read_only & (rank(level) >= RANKS[least])


def applied(files: DataFrame, proposals: DataFrame) -> DataFrame:
    """Approved proposals: a read-only file gets a canonical name, another one a new current name; each says what happened."""
    chosen = proposals.where("status = 'approved'").groupBy("file_id").agg(F.max_by("proposed_name", "proposal_id").alias("_name"))
    joined = files.join(chosen, "file_id", "left")
    ready = F.col("_name").isNotNull()
    return joined.withColumns({
        "canonical_name": F.when(ready & F.col("is_read_only"), F.col("_name")).otherwise(F.col("canonical_name")),
        "current_name": F.when(ready & ~F.col("is_read_only"), F.col("_name")).otherwise(F.col("current_name")),
        "outcome": F.when(~ready, "skipped").when(F.col("is_read_only"), "named").otherwise("renamed"),
    }).drop("_name")

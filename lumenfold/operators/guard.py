"""What stands against a move: copies and versions of the moved file that are somewhere already."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.groups import hot_keys, join_facts

#: Version findings that are reported for a file; lists up to this length are broadcast.
MOST, SHORT_LIST = 10, 64


def move_findings(moves: DataFrame, files: DataFrame, dismissed: DataFrame, most: int = MOST) -> DataFrame:
    """(file_id, kind, group_id, members, blocking, place) of moves (file_id, destination).

    files: file_id, owner, content_key, stem, location. dismissed: pairs (a, b) that a person has cleared. A finding is a content of the same owner, by
    its smallest file id, with the number of its files that aren't cleared for this file; one without any is none.
    ``exact`` (place 0): the file's own content, whatever the number of its copies; it blocks. ``version``: another content with the same stem, the first ``most`` by group_id
    (places from 1, counted after clearing); it blocks if such a file lies at the destination. Files without a content key match nothing."""
    files = files.where("content_key is not null and owner is not null")
    own = moves.join(files.select("file_id", "owner", "content_key", "stem"), "file_id")
    a, b = F.col("a"), F.col("b")
    pairs = dismissed.select(a.alias("file_id"), b.alias("other_id")).unionByName(dismissed.select(b.alias("file_id"), a.alias("other_id"))).distinct()
    other = files.select(F.col("file_id").alias("other_id"), "owner", F.col("content_key").alias("other_key"), F.col("stem").alias("other_stem"), F.col("location").alias("other_location"))
    cleared = pairs.join(other, "other_id").join(own.select("file_id", "owner", "stem", "destination"), ["file_id", "owner"])

    # Copies: a row a content, so that a group of any size adds no pairs.
    key = F.concat_ws(" ", "owner", "content_key")
    contents = files.groupBy(key.alias("key")).agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    gone = cleared.groupBy("file_id", F.col("other_key").alias("content_key")).agg(F.count("*").alias("gone"))
    copies = join_facts(own.withColumn("key", key), hot_keys(contents), "key").where("group_id is not null").join(gone, ["file_id", "content_key"], "left")
    exact = copies.withColumn("members", F.col("n") - 1 - F.coalesce("gone", F.lit(0))).where("members > 0")
    exact = exact.select("file_id", F.lit("exact").alias("kind"), "group_id", "members", F.lit(True).alias("blocking"), F.lit(0).alias("place"))

    # Versions: of each stem so many contents that clearing leaves the first ``most``.
    by_stem = files.where("stem is not null")
    # A stem is listed with as many more as any of its own files has cleared contents.
    spare = cleared.where("stem = other_stem").groupBy("owner", "stem", "file_id").agg(F.count_distinct("other_key").alias("k")).groupBy("owner", "stem").agg(F.max("k").alias("spare"))
    w = Window.partitionBy("owner", "stem").orderBy("group_id")
    first = by_stem.groupBy("owner", "stem", "content_key").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n"))
    placed = first.withColumn("_r", F.row_number().over(w)).join(spare, ["owner", "stem"], "left")
    first = placed.where(F.col("_r") <= most + 1 + F.coalesce("spare", F.lit(0))).drop("_r", "spare")
    stem_key = F.concat_ws(" ", "owner", "stem")
    facts = first.groupBy(stem_key.alias("key")).agg(F.collect_list(F.struct(F.col("content_key").alias("other_key"), "group_id", "n")).alias("others"))
    sizes = by_stem.groupBy(stem_key.alias("key")).agg(F.count("*").alias("files"))
    # Of stems that very many files share, short lists are broadcast.
    marked = hot_keys(facts.join(sizes, "key"), "files").withColumn("hot", F.col("hot") & (F.size("others") <= SHORT_LIST))
    joined = join_facts(own.where("stem is not null").withColumn("key", stem_key), marked, "key")
    found = joined.select("file_id", "owner", "stem", "content_key", "destination", F.inline("others")).where("other_key <> content_key")
    at = F.col("destination").eqNullSafe(F.col("other_location"))
    gone = cleared.groupBy("file_id", "other_key", F.col("other_stem").alias("stem")).agg(F.count("*").alias("gone"), F.count_if(at).alias("gone_there"))
    there = by_stem.groupBy("owner", "stem", F.col("content_key").alias("other_key"), F.col("location").alias("_at")).agg(F.count("*").alias("there")).alias("t")
    f = found.join(gone, ["file_id", "other_key", "stem"], "left").alias("f")
    same = [F.col(f"f.{c}") == F.col(f"t.{c}") for c in ("owner", "stem", "other_key")]
    placed = f.join(there, [*same, F.col("f.destination").eqNullSafe(F.col("t._at"))], "left").select("f.*", "there")
    left = placed.withColumn("members", F.col("n") - F.coalesce("gone", F.lit(0))).where("members > 0")
    listed = left.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("group_id"))).where(F.col("place") <= most)
    blocking = F.coalesce(F.col("there") > F.coalesce("gone_there", F.lit(0)), F.lit(False))
    return exact.unionByName(listed.select("file_id", F.lit("version").alias("kind"), "group_id", "members", blocking.alias("blocking"), "place"))

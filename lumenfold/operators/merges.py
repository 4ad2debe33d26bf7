"""Merged groups: canonical ids through chains of merges, and members under them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.groups import written


def canonical(merges: DataFrame) -> DataFrame:
    """(old, kept): of each merged id the id at the end of its chain of merges (old -> kept).

    A round doubles what every id has followed, so chains of n merges take log2(n) rounds of an equi-join. Repeated rows are one merge; a merge into itself or with a null end is none.
    An id that is merged into two different ones, or a circle of merges, raises a ValueError."""
    real = written(merges.where("old <> kept").select("old", "kept").distinct(), "merges")
    if twice := real.groupBy("old").count().where("count > 1").select("old").limit(5).collect():
        raise ValueError(f"merged into several: {[r['old'] for r in twice]}")
    now, open_ = real, -1
    while True:
        onward = now.select(F.col("old").alias("_at"), F.col("kept").alias("_next"))
        followed = now.join(onward, F.col("kept") == F.col("_at"), "left")
        now = written(followed.select("old", F.coalesce("_next", "kept").alias("kept"), F.col("_next").isNotNull().alias("moved")), "merges")
        if now.where("old = kept").limit(1).count():
            raise ValueError("a circle of merges")
        left = now.where("moved").count()
        if not left:
            return now.select("old", "kept")
        if left == open_:
            # A chain's ids settle from its end on; those that never do run into a circle.
            raise ValueError(f"a circle of merges below {left} ids")
        open_ = left


def merges_by_key(groups: DataFrame, key: str, order: Sequence[str], group: str = "group_id") -> DataFrame:
    """(old, kept): groups with an equal key go into the first of them by ``order``, then id. Groups without a key stay. No key is gathered: the first is an aggregate."""
    first = groups.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(group, F.struct(*order, group)).alias("kept"), F.count("*").alias("n")).where("n > 1")
    return groups.join(first, key).where(F.col(group) != F.col("kept")).select(F.col(group).alias("old"), "kept")


def reparented(members: DataFrame, merges: DataFrame, group: str = "group_id", member: str = "file_id") -> DataFrame:
    """``members`` under canonical groups, a row a group and member: of several the one that was there before the merges, then the one from the smallest group.

    Columns stay as they are. Null groups and members are kept apart like any value."""
    ends = canonical(merges)
    moved = members.join(ends, F.col(group) == F.col("old"), "left").withColumn("_to", F.coalesce("kept", group))
    others = [c for c in members.columns if c not in (group, member)]
    first = F.min_by(F.struct(F.lit(0).alias("_"), *others), F.struct(F.col("old").isNotNull(), F.col(group)))
    best = moved.groupBy("_to", member).agg(first.alias("_first"))
    return best.select(*(F.col("_to").alias(group) if c == group else F.col(c) if c == member else F.col("_first")[c].alias(c) for c in members.columns))

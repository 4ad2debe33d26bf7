"""Latest-wins views, decorations, hierarchies and dashboards, as plain DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.groups import written


def latest_wins(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of each key with the largest ``order`` (nulls smallest); end ``order`` with a unique column.

    An aggregate with a partial step on the map side: no sort, and a key with a third of the rows doesn't
    meet in one task."""
    best = F.max_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_latest")).select(*key, *(F.col("_latest")[c].alias(c) for c in keep))


def latest_non_null(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """As latest_wins, but a later row with a null value doesn't hide an earlier value; keys without any value have none."""
    best = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    return df.groupBy(*key).agg(best.alias(value))


def earliest_wins(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    best = F.min_by(F.struct(*keep), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("_first")).select(*key, *(F.col("_first")[c].alias(c) for c in keep))


def naming_state(canonical: Column, proposal_status: Column) -> Column:
    return (
        F.when(canonical.isNotNull(), "named")
        .when(proposal_status.isin("pending", "approved"), "pending")
        .when(proposal_status == "rejected", "rejected")
        .when(proposal_status == "applied", "named")
        .otherwise("none")
    )


def zero_filled(df: DataFrame, key: str, domain: Sequence[str], count: str = "n") -> DataFrame:
    """Counts of every value of a domain, 0 where there are none; values outside of it are left out."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{key} string")
    return values.join(df.groupBy(key).agg(F.count("*").alias(count)), key, "left").select(key, F.coalesce(count, F.lit(0)).alias(count))


def calendar(df: DataFrame, day: str, days: DataFrame, values: Sequence[Column]) -> DataFrame:
    """Aggregates by day, with a row of zeros for each day without any; ``days`` has first_day and last_day."""
    every = days.select(F.explode(F.sequence("first_day", "last_day")).alias(day))
    found = df.groupBy(day).agg(*values)
    return every.join(found, day, "left").na.fill(0)


def path_table(nodes: DataFrame, faults: str = "raise") -> DataFrame:
    """Adds path (slugs from the root down, joined by dots) and depth to nodes (id, parent_id, slug), of any depth.

    Each round doubles the distance that every node has looked up its branch: a node's path is that of the ancestor it has reached, and its own part behind
    it; so a depth of n takes log2(n) rounds of an equi-join. Nodes that no root reaches lie on or below a cycle, or below a parent that isn't there: they
    raise a ValueError that names some, or with ``faults="keep"`` they have null path and depth. A null slug adds nothing to a path. Ids are unique."""
    if faults not in ("raise", "keep"):
        raise ValueError(f"faults: raise or keep, not {faults!r}")
    now = written(nodes.select("id", "parent_id", "slug", F.col("parent_id").alias("_up"), F.concat_ws(".", "slug").alias("path"), F.lit(0).alias("depth")), "paths")
    open_ = now.where("_up is not null").count()
    while open_:
        above = now.select(F.col("id").alias("_id"), F.col("_up").alias("_next"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        met = now.join(above, F.col("_up") == F.col("_id"), "left")
        found = F.col("_id").isNotNull()
        path = F.when(found, F.concat_ws(".", F.nullif("_path", F.lit("")), F.nullif("path", F.lit("")))).otherwise(F.col("path"))
        depth = F.when(found, F.col("depth") + F.col("_depth") + 1).otherwise(F.col("depth"))
        # A parent that isn't there stays where it is, and so does whoever has reached it.
        now = written(met.select("id", "parent_id", "slug", F.when(found, F.col("_next")).otherwise(F.col("_up")).alias("_up"), path.alias("path"), depth.alias("depth")), "paths")
        left = now.where("_up is not null").count()
        if left == open_:
            # Every branch that ends at a root loses nodes in each round.
            if faults == "raise":
                some = [r["id"] for r in now.where("_up is not null").select("id").limit(5).collect()]
                raise ValueError(f"{left} nodes that no root reaches (a cycle or a parent that isn't there): {some}")
            break
        open_ = left
    rooted = F.col("_up").isNull()
    return now.select("id", "parent_id", "slug", F.when(rooted, F.col("path")).alias("path"), F.when(rooted, F.col("depth")).alias("depth"))


def ancestor_paths(path: Column) -> Column:
    """The path itself and all above it: equi-joins on these replace joins on path prefixes."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, 1, i)))


def roll_up(counts: DataFrame, path: str = "path", n: str = "direct") -> DataFrame:
    """Totals over each path and all below it, of direct counts by path."""
    return counts.withColumn("_up", F.explode(ancestor_paths(F.col(path)))).groupBy(F.col("_up").alias(path)).agg(F.sum(n).alias("total"))


def reclaimable(files: DataFrame, key: Sequence[str], size: str, order: Sequence[str]) -> DataFrame:
    """Groups of equal content: how many, and the bytes of all but the kept (first) member."""
    first = F.min_by(F.col(size), F.struct(*order))
    return files.groupBy(*key).agg(F.count("*").alias("members"), F.min_by(F.col(order[-1]), F.struct(*order)).alias("kept_id"), (F.sum(size) - first).alias("bytes")).where("members > 1")


COPY_LIKE = r"(?i)\(\d+\)|[\s_-]copy\b|duplicate"


def canonical_score(title: Column, filename: Column) -> Column:
    """10 for a title, 5 for a name that doesn't look like a copy's."""
    return F.when(title.isNotNull() & (title != ""), 10).otherwise(0) + F.when(~F.coalesce(filename, F.lit("")).rlike(COPY_LIKE), 5).otherwise(0)


def canonical_pick(members: DataFrame, group: Sequence[str], score: str, imported: str, member: str) -> DataFrame:
    """Of each group the member with the highest score, then the earliest, then the smallest id."""
    return members.groupBy(*group).agg(F.min_by(F.col(member), F.struct((-F.col(score)).alias("s"), F.col(imported).alias("i"), F.col(member).alias("m"))).alias("canonical_id"), F.count("*").alias("members"))


def reconcile(known: DataFrame, snapshot: DataFrame, key: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Snapshot reconciliation by a full outer join: new, changed, active or missing for each key."""
    a = known.select(*key, F.struct(*facts).alias("_old"))
    b = snapshot.select(*key, F.struct(*facts).alias("_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "active").otherwise("changed")
    return a.join(b, list(key), "full_outer").withColumn("state", state)


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keyed upsert: the last change of a key replaces its row; keys without changes stay."""
    columns = [c for c in base.columns if c not in key]
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest_wins(both, key, ["_new", *order], columns)


def copies_from_twin(files: DataFrame, key: str, inherited: Sequence[str], donor: Column, order: Sequence[str]) -> DataFrame:
    """Fills null ``inherited`` columns from the best donor with the same content key."""
    best = files.where(donor).groupBy(key).agg(F.min_by(F.struct(*inherited), F.struct(*order)).alias("_twin"))
    filled = {c: F.coalesce(F.col(c), F.col("_twin")[c]) for c in inherited}
    return files.join(best, key, "left").withColumn("inherited", F.col("_twin").isNotNull() & F.col(inherited[0]).isNull()).withColumns(filled).drop("_twin")

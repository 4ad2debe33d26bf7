"""Similar pairs of sets, verified, and of each set the best so many: versions of a file, and what stands against a move."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import has_version_marker, tokens
from lumenfold.operators.groups import block_pairs, connected_components, hot_keys, join_facts, map_groups, written
from lumenfold.operators.similarity import MIN_TOKENS, overlaps, prefixes, shingles

#: From which similarity texts are probably one document's; the weights of text and name; findings of a file.
PROBABLE, TEXT_WEIGHT, NAME_WEIGHT, MOST = 0.65, 0.7, 0.3, 10
#: Lists of findings up to this length are broadcast for contents with very many copies.
SHORT_LIST = 64

Score = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def best_pairs(sets: DataFrame, threshold: float = PROBABLE, score: Score | None = None, block: int = 256) -> DataFrame:
    """(group, key, other, similarity, score, place): for each set its ``room`` best others of the group, at the threshold or above.

    sets: group (string), key (long), set (array of longs without repeats), room (int), mark (double). Keys are unique in a group; empty and null sets have no pairs.
    A table that is written already may bring row (a number of its own for each set); it isn't written again.
    ``score`` makes scores of a matrix of similarities (rounded to 6 places) and the marks of its rows and columns; without it the similarity is the score. Places go by falling score, then key.

    Sets that share a member of their prefixes lie in one cluster. Inside a cluster only sets of like size meet (the smaller has at least ``threshold`` of the larger's members), and
    a meeting of any size is cut into pairs of blocks, each a small task that gives at most ``room`` rows a set."""
    known = sets.where(F.size("set") > 0)
    if "row" not in sets.columns:
        known = written(known.withColumn("row", F.monotonically_increasing_id()), "sets")
    # A member counts inside its group only, so it and the group are one hash: nothing carries the group along.
    own = F.transform("set", lambda s: F.xxhash64("group", s))
    prefix = written(prefixes(known.select("row", own.alias("set")), "row", threshold), "prefixes")
    hubs = prefix.groupBy("s").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    clusters = connected_components(prefix.join(hubs, "s").select(F.col("row").alias("a"), F.col("hub").alias("b")))
    # Sizes whose ratio is the threshold or more lie in one class of sizes or in two that follow each other.
    step = F.floor(F.log(F.size("set").cast("double")) / -math.log(threshold) + 1e-9).cast("int")
    members = known.select("row", step.alias("step")).join(clusters.select(F.col("id").alias("row"), F.col("component").alias("cluster")), "row")
    met = written(members.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("meeting", F.col("step") - F.col("guest")), "meetings")
    # Guests meet none of themselves. Who meets whom is settled before any set is fetched.
    real = met.groupBy("cluster", "meeting").agg(F.count("*").alias("n"), F.min("guest").alias("least")).where("n > 1 and least = 0").select("cluster", "meeting")
    tiles = block_pairs(met.join(real, ["cluster", "meeting"]).select("cluster", "meeting", "guest", "row"), ["cluster", "meeting"], block, F.col("row"))

    def one(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        first = group["block_a"][0]
        same = bool(group["block_b"][0] == first)
        a = np.flatnonzero(group["block"] == first)
        b = a if same else np.flatnonzero(group["block"] != first)
        if not len(a) or not len(b):
            return None
        size, guest, key, room = (np.asarray([len(x) for x in group["set"]]), group["guest"] > 0, group["key"].astype(np.int64), group["room"].astype(int))
        both = overlaps(group["set"], a, b)
        union = size[a][:, None] + size[b][None, :] - both
        near = (both >= threshold * union - 1e-9) & ~(guest[a][:, None] & guest[b][None, :])
        if same:
            np.fill_diagonal(near, False)
        alike = np.round(both.astype(float) / union, 6)
        mark = group["mark"].astype(float)
        value = score(alike, mark[a], mark[b]) if score else alike
        out = []
        for rows, columns, n, s, v in ((a, b, near, alike, value), *([] if same else [(b, a, near.T, alike.T, score(alike.T, mark[b], mark[a]) if score else alike.T)])):
            for i in np.flatnonzero(n.any(1)):
                j = np.flatnonzero(n[i])
                top = j[np.lexsort((key[columns[j]], -v[i, j]))][: room[rows[i]]]
                out.append((np.full(len(top), group["row"][rows[i]]), key[columns[top]], s[i, top], v[i, top]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["row", "other", "similarity", "score"])

    columns = ["cluster", "meeting", "block_a", "block_b", "block", "guest", "row", "key", "room", "mark", "set"]
    found = map_groups(tiles.join(known, "row").select(*columns), ["cluster", "meeting", "block_a", "block_b"], one, "row long, other long, similarity double, score double")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "other"))
    return found.withColumn("place", place).join(known.select("row", "group", "key", "room"), "row").where("place <= room").select("group", "key", "other", "similarity", "score", "place")


def _contents(files: DataFrame, group: list[str]) -> DataFrame:
    """A row a content and group: ``first`` (its smallest file id), how many files, its text (of any of them) and whether a name has a version mark."""
    return files.groupBy(*group, "content_key").agg(F.min("file_id").alias("first"), F.count("*").alias("n"), F.any_value("text", True).alias("text"), F.max(F.coalesce("marked", F.lit(False)).cast("double")).alias("mark"))


def version_pairs(files: DataFrame, most: int = MOST) -> DataFrame:
    """(stem, first, other, similarity, score, confidence, place): for each content the ``most`` best other contents of its owner and stem that may be versions of it.

    files: file_id, owner, stem, content_key, name, text. Contents go by their smallest file id. With enough text on both sides a content counts from a similarity of 0.65, with 0.7 of
    the similarity and 0.3 of the name's score (1 if a name of either has a version mark, else 0.5). With too little text on a side there is no similarity, and half of the name's score, which is always less.
    Equal scores go by id. Files without owner, content key or stem have none. Any number of files may share a stem: no pair of contents that belongs here is missed, and none but the best is listed."""
    kept = files.where("owner is not null and content_key is not null and stem <> ''").withColumn("marked", has_version_marker(F.col("name")))
    words = F.when(F.length("text") > 0, tokens(F.col("text")))
    group = F.concat_ws("\n", "owner", "stem")
    rows = written(_contents(kept.withColumn("group", group), ["group", "owner", "stem"]).withColumn("w", words).select("group", "owner", "stem", "first", "mark", F.coalesce(F.size("w") >= MIN_TOKENS, F.lit(False)).alias("enough"), F.when(F.size("w") >= MIN_TOKENS, shingles(F.col("w"))).alias("set")).withColumn("row", F.monotonically_increasing_id()), "contents")
    named = lambda alike, a, b: TEXT_WEIGHT * alike + NAME_WEIGHT * np.where((a[:, None] > 0) | (b[None, :] > 0), 1.0, 0.5)
    alike = best_pairs(rows.where("enough").select("group", F.col("first").alias("key"), "set", F.lit(most).alias("room"), "mark", "row"), PROBABLE, named).select("group", F.col("key").alias("first"), "other", "similarity", "score")

    # Without text on a side, names alone: the first few of a stem serve for all its contents. One more, as a content isn't its own version.
    def few(these: DataFrame, by_mark: bool) -> DataFrame:
        order = [F.desc("mark"), F.col("first")] if by_mark else [F.col("first")]
        return these.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("r") <= most + 1).select("group", F.col("first").alias("other"), F.col("mark").alias("other_mark"))

    names = None
    for mine in (True, False):
        for marked in (True, False):
            # For a content with enough text, those without; for one without, all.
            others = few(rows.where("not enough") if mine else rows, by_mark=not marked)
            probes = rows.where((F.col("enough") == mine) & ((F.col("mark") > 0) == marked)).select("group", "first", "mark")
            part = probes.join(others, "group").where("first <> other")
            names = part if names is None else names.unionByName(part)
    score = F.when((F.col("mark") > 0) | (F.col("other_mark") > 0), 0.5).otherwise(0.25)
    both = alike.unionByName(names.select("group", "first", "other", F.lit(None).cast("double").alias("similarity"), score.alias("score")))
    place = F.row_number().over(Window.partitionBy("group", "first").orderBy(F.desc("score"), "other"))
    level = F.when(F.col("similarity").isNull() | (F.col("score") < 0.85), "low").otherwise("medium")
    listed = both.withColumn("place", place).where(F.col("place") <= most).withColumn("confidence", level)
    return listed.withColumn("stem", F.element_at(F.split("group", "\n"), -1)).select("stem", "first", "other", "similarity", "score", "confidence", "place")


def similar_findings(moves: DataFrame, files: DataFrame, dismissed: DataFrame, most: int = MOST) -> DataFrame:
    """(file_id, kind, group_id, members, score, blocking, place): for each moved file the ``most`` most similar other contents of its owner, from a similarity of 0.65.

    moves: file_id, destination. files: file_id, owner, content_key, stem, location, text. dismissed: pairs (a, b) that a person has cleared. A finding is a content, by its smallest file id, with the number
    of its files that aren't cleared for this file; one without any is none and takes no place. ``version`` if such a file has the moved file's stem, else ``similar``; it blocks if such a file lies at the destination. Texts of fewer than 40 words,
    and files without owner or content key, have none."""
    known = files.where("owner is not null and content_key is not null").withColumn("marked", F.lit(False))
    a, b = F.col("a"), F.col("b")
    pairs = dismissed.select(a.alias("file_id"), b.alias("other_id")).unionByName(dismissed.select(b.alias("file_id"), a.alias("other_id"))).where("file_id <> other_id").distinct()
    facts = known.select(F.col("file_id").alias("other_id"), "owner", F.col("content_key").alias("other_key"), F.col("stem").alias("other_stem"), F.col("location").alias("other_location"))
    own = moves.join(known.select("file_id", "owner", "content_key", "stem"), "file_id")
    cleared = written(pairs.join(facts, "other_id").join(own.select("file_id", "owner", "content_key", "stem", "destination"), ["file_id", "owner"]), "cleared")
    here, there = F.col("stem") == F.col("other_stem"), F.col("destination").eqNullSafe(F.col("other_location"))
    gone = cleared.groupBy("file_id", "other_key").agg(F.count("*").alias("gone"), F.count_if(here).alias("gone_stem"), F.count_if(there).alias("gone_there"))
    # A content is listed with as many more as any of its files has cleared contents.
    spare = gone.join(own.select("file_id", "owner", "content_key"), "file_id").groupBy("owner", "content_key", "file_id").agg(F.count("*").alias("k")).groupBy("owner", "content_key").agg(F.max("k").alias("spare"))
    words = F.when(F.length("text") > 0, tokens(F.col("text")))
    contents = written(_contents(known, ["owner"]).withColumn("w", words).where(F.size("w") >= MIN_TOKENS).select("owner", "content_key", "first", "n", shingles(F.col("w")).alias("set")), "contents")
    rows = contents.join(spare, ["owner", "content_key"], "left").select(F.col("owner").alias("group"), F.col("first").alias("key"), "set", (F.lit(most) + F.coalesce("spare", F.lit(0))).cast("int").alias("room"), F.lit(0.0).alias("mark"))
    found = best_pairs(rows)
    side = contents.select("owner", "content_key", "first", "n")
    lists = found.join(side.select(F.col("owner").alias("group"), F.col("first").alias("key"), "content_key"), ["group", "key"]).join(side.select(F.col("owner").alias("group"), F.col("first").alias("other"), F.col("content_key").alias("other_key"), F.col("n").alias("others")), ["group", "other"])
    key = F.concat_ws(" ", "owner", "content_key")
    # A content's list goes to all its files; of much-copied ones, short lists are broadcast.
    by_content = lists.groupBy(F.concat_ws(" ", "group", "content_key").alias("key")).agg(F.collect_list(F.struct("other_key", F.col("other").alias("group_id"), "others", "similarity")).alias("list"))
    copies = known.groupBy(key.alias("key")).agg(F.count("*").alias("copies"))
    marked = hot_keys(written(by_content.join(copies, "key"), "lists"), "copies").withColumn("hot", F.col("hot") & (F.size("list") <= SHORT_LIST))
    listed = join_facts(own.withColumn("key", key), marked, "key").select("file_id", "owner", "stem", "destination", F.inline("list"))
    left = listed.join(gone, ["file_id", "other_key"], "left").withColumn("members", F.col("others") - F.coalesce("gone", F.lit(0))).where("members > 0")
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("similarity"), "group_id"))
    best = left.withColumn("place", place).where(F.col("place") <= most)

    def some(rows: DataFrame, column: str, at: str, gone_of: str, name: str) -> DataFrame:
        """Adds whether an uncleared file of the finding has the moved file's value in a column."""
        n = known.where(F.col(column).isNotNull()).groupBy(F.col("owner").alias("_owner"), F.col("content_key").alias("_key"), F.col(column).alias("_at")).agg(F.count("*").alias("_n"))
        on = (F.col("owner") == F.col("_owner")) & (F.col("other_key") == F.col("_key")) & (F.col(at) == F.col("_at"))
        return rows.join(n, on, "left").withColumn(name, F.coalesce(F.col("_n") > F.coalesce(gone_of, F.lit(0)), F.lit(False))).drop("_owner", "_key", "_at", "_n")

    told = some(some(best, "stem", "stem", "gone_stem", "_version"), "location", "destination", "gone_there", "blocking")
    return told.select("file_id", F.when(F.col("_version"), "version").otherwise("similar").alias("kind"), "group_id", "members", F.col("similarity").alias("score"), "blocking", "place")

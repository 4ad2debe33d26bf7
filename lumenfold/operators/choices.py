"""Which of several: twins to copy from, lists with caps, subjects by keywords, the evidence that a description rests on."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.groups import lean


def best_twins(files: DataFrame, key: Sequence[str], id_col: str, donor: Column, order: Sequence[Column], name: str) -> DataFrame:
    """(id, name): of each file the first other file by ``order`` among the donors with the same ``key``; null without one.

    End ``order`` with a unique column. Two donors of a key are enough for all its files, as only a file itself is passed over; they are picked before the shuffle, so a key with very many files is as cheap as any. Null keys have no twins."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = F.coalesce(donor, F.lit(False)) & ~F.exists(F.array(*(F.col(k).isNull() for k in key)), lambda x: x)
    two = files.where(known).withColumn("_r", F.row_number().over(w)).where("_r <= 2").select(*key, F.col(id_col).alias("_twin"), "_r")
    pair = two.groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, F.col("_twin"))).alias("_first"), F.max(F.when(F.col("_r") == 2, F.col("_twin"))).alias("_second"))
    other = F.when(F.col("_first") != F.col(id_col), F.col("_first")).otherwise(F.col("_second"))
    return files.join(pair, list(key), "left").select(id_col, other.alias(name))


def capped_union(lists: Sequence[tuple[str, DataFrame, int]], owner: str, id_col: str, order: str) -> DataFrame:
    """(owner, id, list, place): of each owner the first so many rows of each list by ``order`` (then id), each id once, from the first list that has it.

    lists: (name, frame of owner, id and order, cap). Places go on through the lists, as they are read. A cap is the list's own: what an earlier list has too still counts in it."""
    rows = None
    for i, (name, frame, most) in enumerate(lists):
        place = F.row_number().over(Window.partitionBy(owner).orderBy(order, id_col))
        one = frame.select(owner, id_col, order).withColumn("_place", place).where(F.col("_place") <= most).select(owner, id_col, F.lit(i).alias("_list"), F.lit(name).alias("list"), "_place")
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(owner, id_col).agg(F.min(F.struct("_list", "_place", "list")).alias("_f"))
    place = F.row_number().over(Window.partitionBy(owner).orderBy("_f._list", "_f._place"))
    return first.select(owner, id_col, F.col("_f.list").alias("list"), place.alias("place"))


#: Words of a taxonomy that one pass looks for.
MOST_WORDS = 100_000


def classified(docs: DataFrame, taxonomy: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """(id, subject, score, confidence, confidence_score) by keywords, anywhere in name and text, inside words too, in lower case.

    taxonomy: subject, ord, word; at most MOST_WORDS rows (more raise). A word in the name counts 3 and in the text 1; the best score wins, the smaller ord of equal ones. No subject without a hit. high: a hit in the
    name and a score of 4; medium: a hit in the name or a score of 2. Each text is read once, by an automaton of all words. Null names and texts have no hits; null and empty words are left out, a repeated row of the taxonomy counts once."""
    words = taxonomy.where("word <> ''").select("subject", "ord", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    rows = sorted(((r["ord"], r["subject"], r["word"]) for r in words), key=lambda r: (r[0], str(r[1]), r[2]))
    subjects = list(dict.fromkeys((o, s) for o, s, _ in rows))
    place = {x: i for i, x in enumerate(subjects)}
    of_word: dict[str, list[int]] = {}
    for o, s, w in rows:
        of_word.setdefault(w, []).append(place[o, s])

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in of_word:
            automaton.add_word(w, w)
        if of_word:
            automaton.make_automaton()
        found = lambda text: {w for _, w in automaton.iter(text.lower())} if text and of_word else set()
        for batch in batches:
            out = []
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                score, named = {}, set()
                for weight, words in ((3, found(name)), (1, found(text))):
                    for w in words:
                        for k in of_word[w]:
                            score[k] = score.get(k, 0) + weight
                            if weight == 3:
                                named.add(k)
                if score:
                    best = min(score, key=lambda k: (-score[k], k))
                    n, hit = score[best], best in named
                    out.append((subjects[best][1], n, "high" if hit and n >= 4 else "medium" if hit or n >= 2 else "low"))
                else:
                    out.append((None, 0, "low"))
            subject, n, level = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(subject, pa.string()), pa.array(n, pa.int64()), pa.array(level, pa.string())], names=["id", "subject", "score", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_of = docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(text_col).alias("text"))
    told = rows_of.mapInArrow(lean(run), f"id {kind}, subject string, score long, confidence string")
    return told.select(F.col("id").alias(id_col), "subject", "score", "confidence", F.least(F.lit(0.99), F.col("score") / 10).alias("confidence_score"))


# What a description may rest on, best first.
EVIDENCE = ("image", "media", "text", "ocr", "metadata")


def description_source(files: DataFrame, key: str, id_col: str, described: Column, evidence: dict[str, Column], order: Sequence[Column]) -> DataFrame:
    """(id, source, twin): what each file's description rests on. A described twin with the same content comes first (``inherited``, with the twin's id), then the first rung of EVIDENCE that holds; ``metadata`` always does."""
    twins = best_twins(files, [key], id_col, described, order, "twin").withColumnRenamed(id_col, "_id")
    joined = files.join(twins, F.col(id_col) == F.col("_id"), "left")
    source = F.when(F.col("twin").isNotNull(), "inherited")
    for rung in EVIDENCE[:-1]:
        if rung in evidence:
            source = source.when(F.coalesce(evidence[rung], F.lit(False)), rung)
    return joined.select(id_col, source.otherwise("metadata").alias("source"), "twin")

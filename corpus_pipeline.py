"""A training corpus from ``documents``: language ID, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes all that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontaminate, langid, packing, simhash, substring
from lumenfold.llm.common import held_out, table, written
from lumenfold.llm.queries import TOKENIZER
from lumenfold.operators import similarity
from lumenfold.operators.groups import connected_components, hot_keys, join_facts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any letter have no language and go; the others get the language that has the largest share."""
    languages, model = langid.train(docs, ~held_out("doc_id", 4, 2))
    found = langid.predict(docs, languages, model, COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row stays: that with the smallest id (null ids last), then the smallest text, language and source.

    Linked are equal texts, fingerprints within op10's distance, and all texts whose five-word shingles have a similarity of 0.8
    (exact, of any length). Rows are told apart by their texts: of repeated rows one is left, of two texts under one id each is judged by itself,
    and rows with a null id go like others."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.md5(text).alias("key"), text.alias("text"))
    marked = simhash.near_duplicates(keyed, "key").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    alike = similarity.near_duplicates(keyed, min_tokens=1, id_col="key").select(F.col("id").alias("a"), F.col("group_id").alias("b"))
    found = connected_components(marked.unionByName(alike))

    # A row's place in its group; rows with equal places are equal.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.md5(text).alias("key"), "lang", "source", "n_chars").alias("place")
    places = docs.select(place).groupBy("place").agg(F.count("*").alias("same"))
    texts = places.groupBy(F.col("place.key").alias("key")).agg(F.min(F.struct("place", F.col("same").alias("n"))).alias("first"), F.sum("same").alias("n"))
    members = written(texts.join(found, F.col("key") == F.col("id"), "left").select("key", "first", "n", F.coalesce("component", "key").alias("component")), "near-texts")
    groups = members.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("rows")).where("rows > 1")
    lists = written(hot_keys(members.select("key", "n", "component").join(groups, "component").select("key", "first", "n")).drop("n"), "near-groups")
    judged = join_facts(docs.withColumn("place", place).withColumn("key", F.col("place.key")), lists, "key")
    kept = judged.where("first is null or place <=> first.place")
    repeats = F.coalesce(F.col("first.n") > 1, F.lit(False))
    return kept.where(~repeats).select(*COLUMNS).unionByName(kept.where(repeats).select(*COLUMNS).dropDuplicates())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose words are what is left, joined by spaces; others stay as they are."""
    out = substring.without_repeats(docs, COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids (little-endian unsigned 32-bit)."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("packing", pack),
]

#: Language ID, fingerprints and token ids can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries on files that are nearly the same: versions of a file, and what is like a moved file."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import pairs
from lumenfold.plans import corpus
from lumenfold.plans.relational import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_JACCARD = "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))"


@query(f"""WITH {corpus._SHINGLES}, f AS (SELECT doc_id, source AS owner, sha256(text) AS k, regexp_replace(left(text, 16), '[^a-z]', '', 'g') AS stem, doc_id % 3 = 0 AS marked FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
          c AS (SELECT owner, stem, k, min(doc_id) AS first, bool_or(marked) AS mark FROM f WHERE stem <> '' GROUP BY ALL), d AS (SELECT c.*, enough, s FROM c JOIN s ON doc_id = first),
          p AS (SELECT a.owner, a.stem, a.first, b.first AS other, a.enough AND b.enough AS ok, CASE WHEN a.mark OR b.mark THEN 1 ELSE 0.5 END AS name, CASE WHEN a.enough AND b.enough THEN {_JACCARD} END AS j FROM d a JOIN d b ON a.owner = b.owner AND a.stem = b.stem AND a.first <> b.first),
          v AS (SELECT owner, stem, first, other, round(j, 6) AS similarity, CASE WHEN ok THEN 0.7::DOUBLE * round(j, 6) + 0.3::DOUBLE * name::DOUBLE ELSE 0.5::DOUBLE * name::DOUBLE END AS score FROM p WHERE NOT ok OR j >= 0.65)
          SELECT stem, first, other, similarity, score, CASE WHEN similarity IS NULL OR score < 0.85 THEN 'low' ELSE 'medium' END AS confidence, row_number() OVER (PARTITION BY owner, stem, first ORDER BY score DESC, other)::INT AS place FROM v QUALIFY place <= 10""")
def version_pairs(spark, d):
    """Each content's ten best versions among all contents of its stem: a document is called by the first letters of its text, every third with its number as a version."""
    docs = t(spark, d, "documents")
    name = F.concat(F.regexp_replace(F.substring("text", 1, 16), "[^a-z]", ""), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_v"), F.col("doc_id").cast("string"))).otherwise(""), F.lit(".txt"))
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("owner"), X.version_stem(name).alias("stem"), F.sha2("text", 256).alias("content_key"), name.alias("name"), "text")
    return pairs.version_pairs(files)


@query(f"""WITH {corpus._SHINGLES}, f AS (SELECT doc_id AS file_id, source AS owner, sha256(text) AS k, CASE WHEN n_chars > 0 THEN left(text, 12) END AS stem, lang AS loc FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
          x AS (SELECT doc_id AS a, doc_id + 1 AS b FROM labels WHERE toxic = 1 UNION SELECT doc_id + 1, doc_id FROM labels WHERE toxic = 1),
          c AS (SELECT owner, k, min(file_id) AS group_id FROM f GROUP BY ALL), d AS (SELECT c.*, s FROM c JOIN s ON doc_id = group_id WHERE enough),
          j AS (SELECT a.owner, a.k AS own, b.k, b.group_id, {_JACCARD} AS score FROM d a JOIN d b ON a.owner = b.owner AND a.k <> b.k WHERE score >= 0.65),
          p AS (SELECT a.file_id, group_id, round(score, 6) AS score, a.stem = b.stem AS version, a.loc = b.loc AS near FROM f a JOIN j ON j.owner = a.owner AND own = a.k JOIN f b ON b.owner = j.owner AND b.k = j.k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.a = a.file_id AND x.b = b.file_id))
          SELECT file_id, CASE WHEN coalesce(bool_or(version), false) THEN 'version' ELSE 'similar' END AS kind, group_id, count(*) AS members, score, coalesce(bool_or(near), false) AS blocking, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, group_id)::INT AS place
          FROM p GROUP BY file_id, group_id, score QUALIFY place <= 10""")
def similar_findings(spark, d):
    """What is like each document, moved to its own language's folder; pairs of a toxic document and the next one are cleared."""
    docs = t(spark, d, "documents")
    files = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("owner"), F.sha2("text", 256).alias("content_key"), F.when(F.col("n_chars") > 0, F.substring("text", 1, 12)).alias("stem"), F.col("lang").alias("location"), "text")
    moves = docs.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("destination"))
    cleared = t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return pairs.similar_findings(moves, files, cleared)

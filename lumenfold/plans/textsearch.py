"""Searches through a positional index."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import textindex
from lumenfold.operators.groups import shared_dir
from lumenfold.plans import corpus
from lumenfold.plans.relational import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def indexed(spark, d, configs):
    """The index of all documents, written to the shared folder and read again."""
    path = shared_dir(spark, "index")
    textindex.add(t(spark, d, "documents"), path, 0, configs)
    return textindex.read(spark, path)


_PADDED = f"w AS (SELECT doc_id, ' ' || array_to_string({corpus._TOKENS}, ' ') || ' ' AS x FROM documents)"


@query(f"""WITH {_PADDED} SELECT doc_id FROM w WHERE (contains(x, ' of the ') AND contains(x, ' and ') AND NOT contains(x, ' that ')) OR (contains(x, ' de la ') AND NOT contains(x, ' les ')) OR contains(x, ' und ')""")
def phrase_search(spark, d):
    """Phrases, alternatives and exclusions, by positions."""
    return textindex.search(indexed(spark, d, ["simple"]), '"of the" and -that or "de la" -les or UND', ["simple"]).select(F.col("id").alias("doc_id"))


@query()
def stemmed_search(spark, d):
    """Inflected forms and stop words of all dictionaries: what is asked for is found in any of its forms."""
    return textindex.search(indexed(spark, d, textindex.CONFIGS), 'heres or "the tion" -edly').select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(f"""WITH w AS (SELECT doc_id, {corpus._TOKENS} AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w), h AS (SELECT * FROM e WHERE x IN ('the', 'and')),
          g AS (SELECT doc_id, x, p, lag(x) OVER (PARTITION BY doc_id ORDER BY p) AS before, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM h)
          SELECT doc_id, round(sum(0.1::DOUBLE / (p - q)), 6) AS proximity, round(0.5 + least(sum(0.1::DOUBLE / (p - q)), 0.4), 6) AS rank FROM g WHERE before <> x GROUP BY doc_id""")
def proximity_rank(spark, d):
    """Documents with both words, ranked by how close they come: the content's step of the rank ladder."""
    found = textindex.search(indexed(spark, d, ["simple"]), "the and", ["simple"])
    return found.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("proximity"), F.round(0.5 + F.least("rank", F.lit(0.4)), 6).alias("rank"))

"""The search entry point: routing, the rank ladder, hybrid search under one filter, and why a document was found."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.filters import Columns, Filter
from lumenfold.operators.retrieval import fused

MODES = ("filename", "content", "hybrid")
#: Rows that a signal gives to the fusion.
SIGNAL_ROWS = 100
# Ranks of the ladder.
FILENAME, TITLE, SUMMARY, CONTENT, CONTENT_MORE = 1.0, 0.9, 0.6, 0.5, 0.4


def route(term: str | None = None, mode: str | None = None, status: str | None = None) -> str:
    """What a request means: a search mode if there is a term (hybrid unless told otherwise), else ``status``, else ``list``."""
    if term and term.strip():
        if mode is not None and mode not in MODES:
            raise ValueError(f"unknown mode: {mode}")
        return mode or "hybrid"
    return "status" if status else "list"


def counted(df: DataFrame, wanted: Filter, names: Columns = Columns(), term: str | None = None) -> DataFrame:
    """How many rows a filter leaves. Searches rank and have no count: a term raises."""
    if term:
        raise ValueError("a search has no count")
    return wanted.apply(df, names).agg(F.count("*").alias("n"))


def ladder(filename: Column, title: Column, canonical: Column, summary: Column, content_rank: Column) -> tuple[Column, Column]:
    """(rank, struct of flags) of conditions, and of a content rank that is null or 0 without a content match."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    content = F.coalesce(content_rank > 0, F.lit(False))
    steps = [(yes(filename), F.lit(FILENAME)), (yes(title) | yes(canonical), F.lit(TITLE)), (yes(summary), F.lit(SUMMARY)), (content, CONTENT + F.least(content_rank, F.lit(CONTENT_MORE)))]
    rank = F.greatest(*(F.when(c, v).otherwise(0.0) for c, v in steps))
    return rank, F.struct(content.alias("matched_content"), yes(filename).alias("matched_filename"), (yes(title) | yes(canonical) | yes(summary)).alias("matched_ai"))


def hybrid(docs: DataFrame, wanted: Filter, signals: Sequence[tuple[str, DataFrame]], names: Columns = Columns(), id_col: str = "doc_id", by: Sequence[str] = (), most: int = SIGNAL_ROWS) -> DataFrame:
    """(by, id, score, matched_by, place): signals (name, frame of by, id, rank_by), each under the filter, cut to its best ``most`` rows and fused.

    The filter is applied to every signal, so that none brings back what another one left out. ``rank_by`` is larger for better rows; ties go by id. A signal may be
    left out: the others are fused alone. place: from 1, by score and id, for pages."""
    allowed = wanted.apply(docs, names).select(id_col)
    w = Window.partitionBy(*by).orderBy(F.desc("rank_by"), id_col)
    cut = [(name, frame.join(allowed, id_col, "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)) for name, frame in signals]
    both = fused(cut, [*by, id_col]).withColumn("score", F.round("score", 9))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), id_col)))


def explained(matched_by: Column) -> Column:
    """Why a document was found, from the names of its signals."""
    said = F.create_map(*[F.lit(x) for pair in (("filename", "its name holds the words"), ("content", "its text holds the words"), ("semantic", "it is about the same")) for x in pair])
    parts = F.filter(F.transform(F.split(matched_by, ","), lambda x: said[x]), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit("Found because "), F.array_join(parts, " and "), F.lit("."))).otherwise("Found by the filter.")

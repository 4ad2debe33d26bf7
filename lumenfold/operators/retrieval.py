"""Keyword and vector retrieval: postings, ranks, cosine, reciprocal-rank fusion, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import let, tokens

#: Fixed value: the constant of reciprocal-rank fusion.
RRF_K = 60
SEMANTIC_FLOOR = 0.62


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, tf): term frequencies of the whole text, summed before the shuffle."""
    words = docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("token"))
    return words.groupBy(id_col, "token").agg(F.count("*").alias("tf"))


def parse_query(text: str) -> tuple[list[list[str]], list[str]]:
    """Web-style search: words and "quoted phrases" must occur, ``or`` separates alternatives, ``-word`` excludes.

    Returns the alternatives (lists of phrases, in lower case) and the excluded words."""
    alternatives, excluded, now = [], [], []
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        negated, phrase = bool(m[1] or m[3]), (m[2] if m[2] is not None else m[4]).lower()
        phrase = " ".join(re.findall(r"[^\W_]+", phrase))
        if phrase == "or" and m[2] is None:
            if now:
                alternatives.append(now)
            now = []
        elif phrase:
            (excluded if negated else now).append(phrase)
    if now:
        alternatives.append(now)
    return alternatives, excluded


def matches(normalised: Column, text: str) -> Column:
    """Whether a text, normalised to tokens joined by spaces, satisfies a web-style query."""
    alternatives, excluded = parse_query(text)
    padded = F.concat(F.lit(" "), normalised, F.lit(" "))
    has = lambda p: F.contains(padded, F.lit(f" {p} "))
    out = F.lit(False)
    for phrases in alternatives:
        one = F.lit(True)
        for p in phrases:
            one = one & has(p)
        out = out | one
    for p in excluded:
        out = out & ~has(p)
    return out


def bm25(index: DataFrame, lengths: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """(id, score) by BM25 of the documents that hold a term. ``lengths`` has id and n_tokens of every document."""
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("mean_tokens"))
    hit = index.where(F.col("token").isin(*terms))
    df = hit.groupBy("token").agg(F.count("*").alias("df"))
    # One row, and a row a query term.
    known = df.join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = hit.join(F.broadcast(known), "token").join(lengths, id_col)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / F.col("mean_tokens")))
    return part.groupBy(id_col).agg(F.sum(F.col("idf") * tf).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


#: Query vectors that a task holds at a time, rows of a piece, and rows that are scored at a time.
QUERY_PIECE, ROW_PIECE, ROW_BLOCK = 1 << 15, 1 << 18, 2048


def nearest(vectors: DataFrame, queries: DataFrame, most: int = 100, floor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): for each query vector the ``most`` rows with the largest dot products, rounded to 6 places, ties by id.

    Rows and queries are cut into pieces; each pair of pieces is a task that holds the queries and streams the rows past them, and gives at most ``most`` rows a query. Rows are copied once
    for each QUERY_PIECE queries, queries once for each piece of rows; neither goes through the driver, and the plan is the same for any number of either. With a floor, rows below it are left out. Null vectors are neither queries nor
    results; other lengths score 0."""
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    n = rows.count()
    row_pieces = max(1, -(-n // ROW_PIECE), min(-(-n // ROW_BLOCK), 2 * spark.sparkContext.defaultParallelism))
    query_pieces = max(1, -(-asked.count() // QUERY_PIECE))
    piece = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = asked.select(every(row_pieces).alias("row_piece"), piece(query_pieces).alias("query_piece"), F.lit(False).alias("row"), "id", "v")
    streamed = rows.select(piece(row_pieces).alias("row_piece"), every(query_pieces).alias("query_piece"), F.lit(True).alias("row"), "id", "v")
    keys = ["row_piece", "query_piece"]
    met = held.unionByName(streamed).repartition(*keys).sortWithinPartitions(*keys, "row")

    def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, vectors) by length."""
        sizes = pa.compute.list_value_length(column).to_numpy()
        flat, begin = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes) - sizes
        return [(at, flat[begin[at][:, None] + np.arange(size)]) for size in np.unique(sizes) for at in [np.flatnonzero(sizes == size)]]

    def run(batches):
        now, asked_ids, asked_vectors, best = None, [], [], {}

        def given() -> pa.RecordBatch | None:
            kept = [(q, *found) for q, found in best.items() if len(found[0])]
            if not kept:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in kept], [len(i) for _, i, _ in kept]).astype(np.int64)), *(pa.array(np.concatenate([k[c] for k in kept])) for c in (1, 2))], names=["query_id", "id", "score"])

        def score(ids: np.ndarray, column: pa.Array) -> None:
            scores = np.zeros((len(asked_ids), len(ids)))
            place = np.arange(len(asked_ids))
            rows_by_size = {v.shape[1]: (at, v) for at, v in matrix(column)}
            for at, v in asked_vectors:
                if v.shape[1] and v.shape[1] in rows_by_size:
                    to, w = rows_by_size[v.shape[1]]
                    scores[np.ix_(place[at], to)] = v @ w.T
            scores = np.round(scores, 6)
            for query, line in zip(asked_ids, scores):
                old = best.get(query, (ids[:0], line[:0]))
                fine = np.ones(len(line), bool) if floor is None else line >= floor
                if len(old[0]) == most:
                    fine &= line >= old[1][-1]
                if fine.any():
                    i, s = np.concatenate([old[0], ids[fine]]), np.concatenate([old[1], line[fine]])
                    top = np.lexsort((i, -s))[:most]
                    best[query] = i[top], s[top]

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(int) for i in range(3)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if now != (group := tuple(marks[:2, low])):
                    if best and (out := given()) is not None:
                        yield out
                    now, asked_ids, asked_vectors, best = group, [], [], {}
                part = batch.slice(low, high - low)
                if not marks[2, low]:
                    first = len(asked_ids)
                    asked_ids += part.column(3).to_pylist()
                    asked_vectors += [(at + first, v) for at, v in matrix(part.column(4))]
                elif asked_ids:
                    for at in range(0, part.num_rows, ROW_BLOCK):
                        block = part.slice(at, ROW_BLOCK)
                        score(block.column(3).to_numpy(), block.column(4))
        if best and (out := given()) is not None:
            yield out

    found = met.mapInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def normalised(v: Column) -> Column:
    """Unit length; a zero vector passes through."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def fused(signals: Sequence[tuple[str, DataFrame]], id_col: str | Sequence[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (name, frame of id and rank from 1): (id, score, matched_by). The id may be several columns."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = None
    for i, (name, frame) in enumerate(signals):
        one = frame.select(*ids, F.lit(i).alias("i"), F.lit(name).alias("name"), (1.0 / (k + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    by = F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
    return rows.groupBy(*ids).agg(F.sum("part").alias("score"), F.array_join(by, ",").alias("matched_by"))


def ranked(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows with their rank from 1; the window sees those few rows only."""
    top = df.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def snippet(text: Column, terms: Sequence[str], before: int = 8, after: int = 13) -> Column:
    """At most two fragments joined by " … ", with every search word in them marked; null without one.

    The first fragment lies around the first search word, the second around the first one behind that fragment. The text is
    normalised and split as a whole, once; search words are found by array positions, without a step for each word."""
    found = r"[^\p{L}\p{N} ]+"
    spaced = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")

    def place(bare: Column) -> Column:
        """The first search word's place, from 1; null without one."""
        return F.array_min(F.array(*(F.nullif(F.array_position(bare, x), F.lit(0)) for x in terms))).cast("int")

    def around(w: Column, at: Column, least: Column) -> Column:
        first = F.greatest(at - before, least)
        marked = F.zip_with(F.slice(w["words"], first, at + after - first + 1), F.slice(w["bare"], first, at + after - first + 1), lambda x, b: F.when(b.isin(*terms), F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
        return F.array_join(marked, " ")

    def both(w: Column) -> Column:
        def from_first(at: Column) -> Column:
            end = at + after  # words before the second fragment
            second = F.when(F.size(w["bare"]) > end, place(F.slice(w["bare"], end + 1, F.size(w["bare"]))) + end)
            return F.when(at.isNotNull(), let(second, lambda z: F.concat_ws(" … ", around(w, at, F.lit(1)), F.when(z.isNotNull(), around(w, z, end + 1)))))

        return let(place(w["bare"]), from_first)

    return let(spaced(text), lambda x: let(F.struct(F.split(x, " ").alias("words"), F.split(F.regexp_replace(F.lower(x), found, ""), " ").alias("bare")), both))

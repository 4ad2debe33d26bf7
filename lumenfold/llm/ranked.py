"""Exact ranked search of many items over all documents, by two trees.

A document is a sparse vector: at each term its share of the score. An item is a set of terms with weights, and a score is their dot product.
Both sides form hierarchies whose nodes hold the largest value of each coordinate below them, so the product of two nodes bounds every score between their
members. A pair of nodes whose bound is under the weakest of the items' k-th best scores so far is left out with all that is below it; the rest is
split further, down to single items and small groups of documents, which are scored exactly.

1. One pass over the texts keeps, for each document, the terms that an item has (written; the texts aren't read again).
2. Counts of documents and terms give the weights. A small part of the documents is searched first: its k-th best scores can only rise, so
   they are where the search of all documents begins.
3. Each task searches its documents, tree by tree, and returns its best k of each item; these are merged.

Items are held in blocks of bounded size, one of which at a time is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import LOWER_ALNUM, map_batches, text_bytes, written

#: Bytes of items (16 more for each) that are broadcast at a time.
ITEM_BYTES = 4 << 20
#: Children of an item node and of a document node, and documents of the smallest node.
ITEM_FAN, DOC_FAN, LEAF = 4, 8, 16
#: Entries of the maxima that a tree of documents holds at most.
TREE_ENTRIES = 8 << 20
#: One in so many documents is searched first, for the scores to begin with.
FIRST = 64
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists: runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""
    text = text.translate(LOWER_ALNUM)
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= SLICE else text.find(b" ", at + SLICE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, times) of every document with a term: its number of terms, and those of the vocabulary with their counts (unsigned 32-bit)."""

    def make():
        get = vocabulary.value.get

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, sizes, terms, times = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                n, found = 0, []
                for words in words_of(texts[i].as_py() or b""):
                    n += len(words)
                    found += [t for t in map(get, words) if t is not None]
                term, tf = np.unique(np.array(found, np.uint32), return_counts=True)
                sizes.append(n)
                terms.append(term.tobytes())
                times.append(tf.astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], names=["id", "n", "terms", "times"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")), make, f"id {kind}, n long, terms binary, times binary").where("n > 0")


def document_counts(found: DataFrame) -> DataFrame:
    """(term, df), summed in each batch before the shuffle."""

    def count(batches):
        for batch in batches:
            term, df = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    return found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Node:
    """Of the items' hierarchy: the items below, and the largest weight of each term among them."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    children: list[Node]


def item_tree(items: list[np.ndarray], weights: np.ndarray) -> Node | None:
    """Items with the same heavy terms lie together."""

    def node(which: np.ndarray, children: list[Node]) -> Node:
        terms = np.unique(np.concatenate([items[i] for i in which]))
        return Node(which, terms, weights[terms].astype(float), children)

    heavy = [tuple(x[np.lexsort((x, -weights[x]))][:8].tolist()) for x in items]
    level = [node(np.array([i]), []) for i in sorted((i for i, x in enumerate(items) if len(x)), key=heavy.__getitem__)]
    while len(level) > 1:
        parts = [level[i : i + ITEM_FAN] for i in range(0, len(level), ITEM_FAN)]
        level = [node(np.concatenate([c.items for c in part]), part) for part in parts]
    return level[0] if level else None


class DocumentTree:
    """Documents whose heaviest coordinates agree lie together; ``levels[0]`` has the maxima of the leaves, the last those of the top."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, weights: np.ndarray, n_rows: int):
        heavy = weights[term] * value
        order = np.lexsort((term, -heavy, row))
        top = order[np.searchsorted(row[order], np.arange(n_rows))]
        self.order = np.lexsort((-value[top], term[top]))
        place = np.empty(n_rows, np.int64)
        place[self.order] = np.arange(n_rows)
        by = np.argsort(place[row], kind="stable")
        self.term, self.value = term[by], value[by]
        self.begin = np.searchsorted(place[row][by], np.arange(n_rows + 1))
        self.n = n_rows
        leaves = np.zeros((-(-n_rows // LEAF), len(weights)), np.int32)
        np.maximum.at(leaves, (place[row] // LEAF, term), value)
        self.levels = [leaves]
        while len(self.levels[-1]) > DOC_FAN:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), DOC_FAN)))

    def entries(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the leaves' documents, and where their entries lie (as indices), with each document's first."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < self.n]
        size = self.begin[docs + 1] - self.begin[docs]
        first = np.cumsum(size) - size
        return docs, np.arange(size.sum()) + np.repeat(self.begin[docs] - first, size), first


class Search:
    """The best k of each item so far; documents come tree by tree."""

    def __init__(self, tree: Node | None, items: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, k: int):
        self.tree, self.items, self.weights, self.k = tree, items, weights, k
        self.kth = np.maximum(floors, 1)  # scores begin above 0
        self.best: list[list[tuple]] = [[] for _ in items]
        self.scored = 0

    def add(self, docs: DocumentTree, ids: list) -> None:
        if self.tree is not None:
            self.docs, self.ids = docs, ids
            top = len(docs.levels) - 1
            self._visit(self.tree, top, np.arange(len(docs.levels[top])))

    def _visit(self, node: Node, level: int, nodes: np.ndarray) -> None:
        bound = self.docs.levels[level][np.ix_(nodes, node.terms)] @ node.weights
        bound *= 1 + 1e-9  # sums beyond 2^53 are rounded
        live = bound >= self.kth[node.items].min()
        nodes, bound = nodes[live], bound[live]
        if not len(nodes):
            return
        if level == 0 and not node.children:
            self._score(int(node.items[0]), nodes, bound)
            return
        if level:
            below = (nodes[:, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
            nodes, level = below[below < len(self.docs.levels[level - 1])], level - 1
        for child in node.children or [node]:
            self._visit(child, level, nodes)

    def _score(self, item: int, leaves: np.ndarray, bound: np.ndarray) -> None:
        weight = np.zeros(len(self.weights), np.int64)
        weight[self.items[item]] = self.weights[self.items[item]]
        order = np.argsort(-bound, kind="stable")
        for low in range(0, len(order), 8):
            part = order[low : low + 8]
            part = part[bound[part] >= self.kth[item]]
            if not len(part):
                return
            docs, at, first = self.docs.entries(leaves[part])
            self.scored += len(docs)
            scores = np.add.reduceat(weight[self.docs.term[at]] * self.docs.value[at], first)
            fine = np.flatnonzero(scores >= self.kth[item])
            found = [(-int(scores[i]), self.ids[j] is None, self.ids[j]) for i, j in zip(fine, self.docs.order[docs[fine]].tolist())]
            if found:
                best = self.best[item] = sorted(self.best[item] + found, key=lambda x: x[:2] if x[1] else x)[: self.k]
                if len(best) == self.k:
                    self.kth[item] = max(self.kth[item], -best[-1][0])


def shares(n: np.ndarray, times: np.ndarray, row: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each entry's part of a score before the weight, in whole numbers."""
    if 50 * n_docs * int(n.max(initial=0)) < 1 << 63:
        long = 50 * n * n_docs // n_terms
    else:
        long = np.array([50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 1_000_000_000 * times // (1000 * times + 20 * (100 - 50 + long)[row])


def _best(found: DataFrame, known, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): of each task's documents the best k of each item."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = known.value
        search = Search(item_tree(items, weights), items, weights, floors.copy(), k)
        most = max(LEAF, TREE_ENTRIES // max(1, len(weights)) * LEAF)
        ids_type = None
        for whole in batches:
            ids_type = whole.schema.field(0).type
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                terms = batch.column(2).to_pylist()
                size = np.array([len(x) // 4 for x in terms], np.int64)
                kept = np.flatnonzero(size)
                if not len(kept):
                    continue
                row = np.repeat(np.arange(len(kept)), size[kept])
                term, times = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (terms, batch.column(3).to_pylist()))
                n = batch.column(1).to_numpy()[kept]
                ids = batch.column(0).to_pylist()
                search.add(DocumentTree(row, term, shares(n, times, row, n_docs, n_terms), weights, len(kept)), [ids[i] for i in kept.tolist()])
        out = [(i, x[2], -x[0]) for i, best in enumerate(search.best) for x in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), ids_type, pa.int64()))], names=["item", "id", "score"])

    return found.mapInArrow(run, f"item long, id {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_bytes: int = ITEM_BYTES, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0 (all, if fewer), equal scores by ascending id, null ids last.

    Repeated rows of ``docs`` are documents of their own, each counted and ranked. Repeated rows of ``items`` (same id and text) are one item, different texts
    under one id are items of their own, null ids too. Null texts and texts without a term count nowhere and are never found. Empty tables give no rows."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    kinds = {"item_id": items.schema[item_col].dataType.simpleString(), "doc_id": docs.schema[id_col].dataType.simpleString()}
    size = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    for b in range(blocks := -(-size // block_bytes)):
        block = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not block:
            continue
        vocabulary: dict[bytes, int] = {}
        terms = [np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for words in words_of(r["text"].encode()) for w in words], np.int64)) for r in block]
        found = written(vectors(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "vectors")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        weights = np.zeros(max(1, len(vocabulary)), np.int64)
        for term, df in document_counts(found).collect():  # at most the vocabulary of a block
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        floors = np.zeros(len(block), np.int64)
        begin = spark.sparkContext.broadcast((terms, weights, floors))
        few = _best(found.where(F.pmod(F.xxhash64("id", "n", "terms"), F.lit(first)) == 0), begin, n_docs, n_terms, k)
        for item, score in _ranked(few, k).where(F.col("rank") == k).select("item", "score").collect():
            floors[item] = score
        known = spark.sparkContext.broadcast((terms, weights, floors))
        best = _ranked(_best(found, known, n_docs, n_terms, k), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kinds['item_id']}")
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))
    return out

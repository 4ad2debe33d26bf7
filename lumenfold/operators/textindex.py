"""A positional inverted index of texts: postings by lexeme, phrases by positions, exclusions, ranks by proximity; documents are added without a rebuild.

A lexeme is what a dictionary makes of a word. The union of all dictionaries is indexed under one name space, each dictionary in a stretch of positions of its own, so that a
word's place is kept in each and phrases never cross from one to the next. A row of the index is a lexeme with documents that a task held together and its positions in each; rows lie in folders by a hash of the lexeme and
sorted by it, so a search reads the folders and row groups of the lexemes it asks for, and no text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.dictionaries import DICTIONARIES
from lumenfold.operators.groups import lean

CONFIGS = ("simple", "english", "french", "arabic")
#: Positions of a dictionary: the n-th begins at n times this.
STRETCH = 1 << 28
#: Folders of an index, and parts that the rows of a folder are written in, so that a lexeme of every document isn't one task's.
FOLDERS, PARTS = 64, 8
#: Words whose lexemes a task remembers, and words whose postings it makes at a time.
REMEMBERED, HELD_WORDS = 200_000, 500_000
#: Fixed value: what a cover without gaps weighs.
COVER_WEIGHT = 0.1
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Lexemes:
    """A dictionary's lexemes of words, remembered up to a bound; None for a stop word."""

    def __init__(self, config: str):
        self.make, self.known = DICTIONARIES[config], {}

    def __call__(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = self.make(word)
        return self.known[word]


class Lexicon:
    """Codes of words, and of each word its lexeme's code in each dictionary (below 0: a stop word), remembered up to a bound."""

    def __init__(self, configs: Sequence[str]):
        self.make = [DICTIONARIES[c] for c in configs]
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.codes: dict[str, int] = {}
        self.lexemes: list[str] = []
        self.table = np.zeros((len(self.make), 1 << 12), np.int32)

    def _code(self, lexeme: str | None) -> int:
        if lexeme is None:
            return -1
        if (code := self.codes.setdefault(lexeme, len(self.lexemes))) == len(self.lexemes):
            self.lexemes.append(lexeme)
        return code

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row a dictionary, a column a word."""
        if len(self.words) > REMEMBERED:
            self.clear()
        missing = list(set(words).difference(self.words))
        if missing:
            low = len(self.words)
            while low + len(missing) > self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
            for k, make in enumerate(self.make):
                self.table[k, low : low + len(missing)] = [self._code(make(w)) for w in missing]
            self.words.update(zip(missing, range(low, low + len(missing))))
        return self.table[:, np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]


def _postings(lexicon: Lexicon, split: list[list[str]]) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(lexeme, texts, where each one's positions end, positions) of texts, a row a lexeme."""
    counts = np.array([len(words) for words in split])
    codes = lexicon([w for words in split for w in words])
    place = np.arange(1, counts.sum() + 1) - np.repeat(np.cumsum(counts) - counts, counts)
    text, many = np.repeat(np.arange(len(counts)), counts), len(counts)
    real = codes >= 0
    key = np.concatenate([c[r].astype(np.int64) * many + text[r] for c, r in zip(codes, real)])
    places = np.concatenate([place[r] + k * STRETCH for k, r in enumerate(real)]).astype(np.int32)
    order = np.argsort(key, kind="stable")  # of equal keys, positions go on ascending
    key = key[order]
    starts = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    lists = lambda at, of: pa.ListArray.from_arrays(pa.array(np.append(at, len(of)).astype(np.int32)), pa.array(of))
    posting = starts(key)
    code, at = np.divmod(key[posting], many)
    row = starts(code)
    end = np.append(posting[1:], len(key)) - np.repeat(posting[row], np.diff(np.append(row, len(code)))) if len(key) else posting
    return pa.array(lexicon.lexemes, pa.string()).take(pa.array(code[row])), lists(row, at), lists(row, end.astype(np.int32)), lists(posting[row], places[order])


def folder(lexeme: Column) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(FOLDERS)).cast("int")


def blocks(docs: DataFrame, configs: Sequence[str] = CONFIGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lexeme, id, ends, positions) of whole texts: of a lexeme, the documents that a task holds together and their positions one after the other (from 1, ascending in each), with where each one's end.
    One pass, no shuffle. Null texts have no rows."""

    def run(batches):
        lexicon = Lexicon(configs)
        for batch in batches:
            rows, split, held = [], [], 0
            for i in range(batch.num_rows):
                if words := words_of(batch.column(1)[i].as_py()):
                    rows.append(i)
                    split.append(words)
                    held += len(words)
                if split and (held >= HELD_WORDS or i == batch.num_rows - 1):
                    lexemes, texts, ends, places = _postings(lexicon, split)
                    ids = batch.column(0).take(pa.array(rows)).take(texts.values)
                    yield pa.RecordBatch.from_arrays([lexemes, pa.ListArray.from_arrays(texts.offsets, ids), ends, places], names=["lexeme", "id", "ends", "positions"])
                    rows, split, held = [], [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"lexeme string, id array<{kind}>, ends array<int>, positions array<int>")


def _unblocked(rows: DataFrame, *more: str) -> DataFrame:
    """A row a document of blocks: lexeme, ``more``, id, positions."""
    end = lambda i: F.when(i < 0, 0).otherwise(F.get("ends", i))
    own = F.transform("id", lambda x, i: F.struct(x.alias("id"), F.slice("positions", end(i - 1) + 1, end(i) - end(i - 1)).alias("positions")))
    return rows.select("lexeme", *more, F.inline(own))


def positions(docs: DataFrame, configs: Sequence[str] = CONFIGS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lexeme, id, positions) of whole texts, a row a lexeme of a document."""
    return _unblocked(blocks(docs, configs, id_col, text_col))


# -- queries ---------------------------------------------------------------------------------------------------------


@dataclass
class Clause:
    """One alternative: phrases (lists of words) that must occur, and phrases that must not."""

    wanted: list[list[str]] = field(default_factory=list)
    unwanted: list[list[str]] = field(default_factory=list)


def parse(text: str) -> list[Clause]:
    """Web-style search: words and "quoted phrases" must occur, ``or`` separates alternatives, a minus excludes a word or phrase from its own alternative.

    A word with marks inside is a phrase of its parts. Alternatives without anything wanted are left out."""
    clauses = [Clause()]
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)(\S+)', text):
        words = words_of(m[2] if m[2] is not None else m[4])
        if m[4] and m[4].lower() == "or":
            clauses.append(Clause())
        elif words:
            (clauses[-1].unwanted if m[1] or m[3] else clauses[-1].wanted).append(words)
    return [c for c in clauses if c.wanted]


@dataclass
class Compiled:
    """A clause in one dictionary: phrases as (lexeme, distance from the phrase's first) lists."""

    wanted: list[list[tuple[str, int]]]
    unwanted: list[list[tuple[str, int]]]


def compiled(clauses: Sequence[Clause], configs: Sequence[str]) -> list[Compiled]:
    """Each clause in each dictionary. Stop words keep their distance in a phrase and ask for nothing; a clause of nothing else is none."""
    out = []
    for config in configs:
        lexeme = Lexemes(config)

        def phrases(these: list[list[str]], lexeme=lexeme) -> list[list[tuple[str, int]]]:
            found = [[(x, i) for i, x in enumerate(map(lexeme, words)) if x is not None] for words in these]
            return [[(x, i - p[0][1]) for x, i in p] for p in found if p]

        for c in clauses:
            one = Compiled(phrases(c.wanted), phrases(c.unwanted))
            if one.wanted and one not in out:
                out.append(one)
    return out


def search(index: DataFrame, text: str, configs: Sequence[str] = CONFIGS, docs: DataFrame | None = None) -> DataFrame:
    """(id, rank) of the documents that satisfy a web-style query in any dictionary.

    Only postings of the query's lexemes are read; they meet by document with a partial aggregate, at most one row a lexeme and document. The rank is the largest over the
    alternatives that match (``proximity``). ``docs`` (column id, without repeats) keeps only its documents."""
    asked = compiled(parse(text), configs)
    names = sorted({x for c in asked for p in (*c.wanted, *c.unwanted) for x, _ in p})
    held = index.where(F.col("lexeme").isin(*names)) if names else index.limit(0)
    if "folder" in index.columns:
        session = index.sparkSession
        numbers = [r[0] for r in session.createDataFrame([(x,) for x in names], "lexeme string").select(folder(F.col("lexeme"))).distinct().collect()] if names else []
        held = held.where(F.col("folder").isin(*numbers)) if numbers else held
    if docs is not None:
        held = held.join(docs.select("id"), "id", "left_semi")
    at = {x: f"p{i}" for i, x in enumerate(names)}
    by_doc = held.groupBy("id").agg(*(F.any_value(F.when(F.col("lexeme") == x, F.col("positions")), True).alias(c) for x, c in at.items()), F.lit(1).alias("_"))

    def phrase(p: list[tuple[str, int]]) -> Column:
        back = lambda d: lambda y: y - d
        shifted = [F.transform(at[x], back(d)) if d else F.col(at[x]) for x, d in p]
        return F.coalesce(F.size(reduce(F.array_intersect, shifted)) > 0, F.lit(False))

    def clause(c: Compiled) -> Column:
        fine = reduce(lambda x, y: x & y, map(phrase, c.wanted))
        return reduce(lambda x, p: x & ~phrase(p), c.unwanted, fine)

    matched = F.array(*(F.when(clause(c), F.lit(i)) for i, c in enumerate(asked))) if asked else F.array().cast("array<int>")
    hits = by_doc.select("id", F.array_compact(matched).alias("matched"), *at.values()).where(F.size("matched") > 0)
    terms = [sorted({at[x] for p in c.wanted for x, _ in p}) for c in asked]
    columns, kind = list(at.values()), index.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = {c: batch.column(2 + i).to_pylist() for i, c in enumerate(columns)}
            ranks = [max(proximity([lists[c][i] for c in terms[k]]) for k in found) for i, found in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks, pa.float64())], names=["id", "rank"])

    return hits.mapInArrow(run, f"id {kind}, rank double")


def proximity(lists: Sequence[Sequence[int]]) -> float:
    """Sum over the smallest covers of all lists, inside one dictionary's stretch, of COVER_WEIGHT / (1 + places in the cover that no list needs).

    A cover is a range of positions with one of each list, none of whose parts is one."""
    last, left, total = [0] * len(lists), 0, 0.0
    stretch = -1
    for at, k in sorted((p, k) for k, positions in enumerate(lists) for p in positions):
        if at // STRETCH != stretch:
            stretch, last, left = at // STRETCH, [0] * len(lists), 0
        last[k] = at
        if (low := min(last)) > left:
            left = low
            total += COVER_WEIGHT / (1 + (at - low + 1) - len(lists))
    return total


# -- stored indexes ---------------------------------------------------------------------------------------------------


def add(docs: DataFrame, path: str, segment: int, configs: Sequence[str] = CONFIGS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes documents as a new segment. A document that an earlier segment has too is replaced as a whole; one whose text is now null goes.

    Segments are numbered by the caller, upward; a segment that is written again replaces itself, so a repeated attempt changes nothing. Ids are unique in ``docs``."""
    spread = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    rows = blocks(docs, configs, id_col, text_col).withColumn("folder", folder(F.col("lexeme")))
    dealt = rows.repartition("folder", spread).sortWithinPartitions("folder", "lexeme")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings/segment={segment}")
    docs.select(F.col(id_col).alias("id"), F.col(text_col).isNotNull().alias("alive")).write.mode("overwrite").parquet(f"{path}/documents/segment={segment}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(lexeme, id, positions, folder): what the newest segment says of each document.

    While there is one segment, that is a plain scan. With more, postings are joined with each document's newest segment."""
    postings, documents = _unblocked(spark.read.parquet(f"{path}/postings"), "segment", "folder"), spark.read.parquet(f"{path}/documents")
    if documents.select("segment").distinct().limit(2).count() < 2:
        return postings.select("lexeme", "id", "positions", "folder")
    newest = documents.groupBy("id").agg(F.max("segment").alias("segment"))
    return postings.join(newest, ["id", "segment"]).select("lexeme", "id", "positions", "folder")


def merge(spark: SparkSession, path: str, target: str) -> None:
    """All segments as one, in another folder; the texts aren't read."""
    spread = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    rows = read(spark, path).select("lexeme", F.array("id").alias("id"), F.array(F.size("positions")).alias("ends"), "positions", "folder")
    rows.repartition("folder", spread).sortWithinPartitions("folder", "lexeme").write.mode("overwrite").partitionBy("folder").parquet(f"{target}/postings/segment=0")
    documents = spark.read.parquet(f"{path}/documents")
    documents.groupBy("id").agg(F.max_by("alive", "segment").alias("alive")).where("alive").write.mode("overwrite").parquet(f"{target}/documents/segment=0")

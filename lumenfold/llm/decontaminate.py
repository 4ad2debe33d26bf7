"""Benchmark decontamination: an FM-index per shard of documents, searched for all benchmark windows.

Words outside the benchmark's vocabulary can't be part of an occurrence, so a shard's index holds only the runs of
vocabulary words that are as long as the shortest window, with a mark between runs. The backward searches
of all windows go through wavelet ranks; occurrences are located by sampled suffix positions and merged into spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import LOWER_ALNUM, bytes_of, map_batches, with_text, written
from lumenfold.llm.fmindex import FMIndex

WINDOW = 13
#: Benchmark words of one broadcast block; documents meet the blocks one after the other.
BLOCK_WORDS = 500_000
#: Words of the documents of one shard.
SHARD_WORDS = 2_000_000
#: Texts that are cut into words at a time.
TAKEN = 256
#: Bytes of the benchmark that are broadcast at a time; a larger one is searched part after part.
PART_BYTES = 4 << 20
#: Words of an item that stay together; a longer item is cut into overlapping pieces.
PIECE_WORDS = 50_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_ALNUM).split()


@dataclass
class Block:
    """Part of the benchmark: word ids from 2 (1 is the mark between runs), windows by length, and whose they are."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # length -> (windows, length) symbols
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> (first owner of each window, owners) as in CSR
    shortest: int


def benchmark_blocks(items: list[tuple], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Block]:
    """items: (id, text bytes). Ids are numbered by their place in ``items``."""
    split, blocks, size = [(k, words_of(text)) for k, (_, text) in enumerate(items)], [], 0
    part: list = []
    for k, words in [*split, (None, [])]:
        if part and (k is None or size + len(words) > block_words):
            vocabulary: dict[bytes, int] = {}
            owned: dict[int, dict[tuple, set[int]]] = {}
            for item, w in part:
                ids = [vocabulary.setdefault(x, len(vocabulary) + 2) for x in w]
                n = min(window, len(ids))
                for at in range(len(ids) - n + 1):
                    owned.setdefault(n, {}).setdefault(tuple(ids[at : at + n]), set()).add(item)
            owners = {}
            for n, d in owned.items():
                counts = np.cumsum([0, *(len(x) for x in d.values())])
                owners[n] = counts, np.array([y for x in d.values() for y in sorted(x)])
            blocks.append(Block(vocabulary, {n: np.array(list(d), np.int32) for n, d in owned.items()}, owners, min(owned)))
            part, size = [], 0
        if words:
            part.append((k, words))
            size += len(words)
    return blocks


#: Runs of vocabulary words: document, first word and words of each, and the symbols of all, laid end to end.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs_of(block: Block, docs: list[list[bytes]], first: int = 0) -> Runs:
    """Those that a window fits into, of documents numbered from ``first``."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    ends, get = np.cumsum(lengths), block.vocabulary.get
    begins = ends - lengths
    ids = np.fromiter((get(x, 0) for w in docs for x in w), np.int32, int(lengths.sum()))
    edge = np.zeros(len(ids) + 1, bool)
    edge[begins[lengths > 0]] = edge[-1] = True
    out = ids == 0
    edge[:-1] |= out
    edge[1:] |= out
    cut = np.flatnonzero(edge)
    runs = np.stack([cut[:-1], cut[1:]], 1)
    runs = runs[(runs[:, 1] - runs[:, 0] >= block.shortest) & ~out[runs[:, 0]]]
    size, doc = runs[:, 1] - runs[:, 0], np.searchsorted(ends, runs[:, 0], "right")
    inside = np.arange(size.sum()) + np.repeat(runs[:, 0] - np.cumsum(size) + size, size)
    return doc + first, runs[:, 0] - begins[doc], size, ids[inside]


def occurrences(block: Block, held: list[Runs]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Spans (document, begin, end) of all occurrences in the runs, merged; and the distinct (document, item) pairs."""
    nothing = [], np.zeros((0, 2), np.int64)
    if not held:
        return nothing
    doc, begin, size, symbols = (np.concatenate(c) for c in zip(*held))
    if not len(doc):
        return nothing
    first = np.cumsum(size + 1) - size - 1  # where each run begins in the index's text; a mark follows each
    inside = np.ones(len(symbols) + len(doc), bool)
    inside[first + size] = False
    text = np.ones(len(inside), np.int32)
    text[inside] = symbols
    index = FMIndex(text, len(block.vocabulary) + 2)
    change, pairs = np.zeros(len(text) + 1, np.int32), []
    for n, windows in block.windows.items():
        low, high = index.ranges(windows)
        count = high - low
        hit = np.repeat(np.arange(len(windows)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[hit]
        at = index.locate(rows)
        np.add.at(change, at, 1)
        np.add.at(change, at + n, -1)
        pointer, owners = block.owners[n]
        both = np.unique(np.stack([doc[np.searchsorted(first, at, "right") - 1], hit], 1), axis=0)
        number = pointer[both[:, 1] + 1] - pointer[both[:, 1]]
        item = owners[np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(pointer[both[:, 1]], number)] if len(both) else np.zeros(0, np.int64)
        pairs.append(np.stack([np.repeat(both[:, 0], number), item], 1))
    # No occurrence holds a mark, so a span lies in one run.
    step = np.diff((np.cumsum(change, dtype=np.int32) > 0).astype(np.int8), prepend=0)
    up, down = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = np.searchsorted(first, up, "right") - 1
    shift = begin[run] - first[run]
    return list(zip(doc[run].tolist(), (up + shift).tolist(), (down + shift).tolist())), np.unique(np.concatenate(pairs), axis=0)


def search(block: Block, docs: list[list[bytes]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """As occurrences, of the documents' words."""
    return occurrences(block, [runs_of(block, docs)])


def pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, piece_words: int) -> DataFrame:
    """Distinct (item, t): items with words, those of many words cut so that each window lies in a piece and no piece is shorter than a window."""
    words = F.filter(F.split(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    split = benchmark.select(F.col(item_col).cast("string").alias("item"), words.alias("w")).where("item is not null and size(w) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece_words))
    cut = split.select("item", "w", F.explode(begins).alias("at"))
    return cut.select("item", F.array_join(F.slice("w", F.col("at") + 1, piece_words + window - 1), " ").alias("t")).distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _searched(held: DataFrame, blocks: list, names: list[str], text_at: int, keep: int) -> DataFrame:
    """``held`` (any columns, then _words, _spans, _items; the text at ``text_at``) with what one part of the benchmark adds to the last three.

    Only the first ``keep`` of the other columns are given on. Of the words only runs are held, as symbols."""

    def make():
        def shard(counts: list[int], runs: list[list[Runs]], spans: list[list[tuple[int, int]]], items: list[set[str]]) -> list[tuple]:
            for block, own in zip(blocks, runs):
                some, pairs = occurrences(block.value, own)
                for d, a, b in some:
                    spans[d].append((a, b))
                for d, k in pairs.tolist():
                    items[d].add(names[k])
            return [(n, [{"begin": a, "end": b} for a, b in merged(s)], sorted(i)) for n, s, i in zip(counts, spans, items)]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, counts, runs, spans, items, size = [], [], [[] for _ in blocks], [], [], 0
            for low in range(0, batch.num_rows, TAKEN):
                texts, before, known = (batch.column(i).slice(low, TAKEN) for i in (text_at, batch.num_columns - 2, batch.num_columns - 1))
                split = [words_of(t) for t in bytes_of(texts)]
                for block, own in zip(blocks, runs):
                    own.append(runs_of(block.value, split, len(counts)))
                counts += map(len, split)
                spans += [[(x["begin"], x["end"]) for x in s] for s in before.to_pylist()]
                items += map(set, known.to_pylist())
                size += sum(map(len, split))
                if size >= SHARD_WORDS or low + TAKEN >= batch.num_rows:
                    rows += shard(counts, runs, spans, items)
                    counts, runs, spans, items, size = [], [[] for _ in blocks], [], [], 0
            found = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), _SPANS, pa.list_(pa.string())))]
            return pa.RecordBatch.from_arrays([*batch.columns[:keep], *found], names=[*batch.schema.names[:keep], *batch.schema.names[-3:]])

        return one

    fields = held.schema.fields
    return map_batches(held, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*fields[:keep], *fields[-3:]]))


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """``keep`` columns of every document, with n_words, n_hit, n_items, items_sha256, contaminated and spans, the word ranges that occurrences cover.

    Words are lower-cased (A-Z) runs of ASCII letters and digits and of all other non-ASCII bytes. An item of fewer words than ``window`` is one window, one without words none. Contaminated:
    some word is hit, and at least one in ``share``. Null texts have no words; null and blank items are never found; items with
    equal texts are each counted, rows with the same item id are one item; ids are compared as strings. Clashing column names
    in ``docs`` don't matter, only ``keep`` and the text are read.

    The benchmark is the query set. It is dealt by a hash into parts of about ``part_bytes``, of which one at a time is
    collected and broadcast, in blocks of BLOCK_WORDS words. A benchmark of one part, the usual case, needs one pass over the
    documents; with more, each part's findings are merged into those of the parts before, which are written in between."""
    spark = docs.sparkSession
    wanted = pieces(benchmark, item_col, item_text_col, window, piece_words)
    size = wanted.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    if parts > 1:
        wanted = written(wanted, "benchmark")
    nothing = F.array().cast("array<struct<begin:int,end:int>>").alias("_spans"), F.array().cast("array<string>").alias("_items")
    sent, text_at = with_text(docs, keep, text_col)
    held = docs.select(*sent, F.lit(0).cast("long").alias("_words"), *nothing)
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == part) if parts > 1 else wanted
        items = [(r["item"], r["t"].encode()) for r in own.orderBy("item", "t").collect()]
        blocks = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(items, window)]
        last = part == parts - 1
        held = _searched(held, blocks, [k for k, _ in items], text_at, len(keep) if last else len(sent))
        if not last:
            held = written(held, "contamination")
            for block in blocks:
                block.destroy()
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    counted = held.select(*keep, F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), F.col("_spans").alias("spans"))
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return counted.select(*keep, "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever those are called."""
    held = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    judged = contamination(held, benchmark, held.columns, text_col=f"_{docs.columns.index(text_col)}")
    return judged.where(~F.col("contaminated")).select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(docs.columns)))

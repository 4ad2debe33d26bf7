"""Alignment of two tokenizers' ids over the same bytes, by products of sparse incidence matrices.

Each tokenizer gives a 0/1 matrix of tokens x bytes in compressed sparse rows (CSR). Gustavson's row product of the one with the
transpose of the other holds, for each pair of tokens that overlap, the number of bytes they share: the overlap links. Where tokens of
both end together, the text is cut into groups; products of the tokens x groups matrices hold the pairs that share a group.

The texts of a batch are laid end to end, so that a batch is one product; a text's tokens never meet those of another.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches, written

#: Characters of texts that are aligned together (a longer text by itself).
AT_ONCE = 1 << 19
#: A pair that holds more than one in so many links is frequent: no corpus has more frequent pairs, so their table is at most 14 MB.
FREQUENT = 1 << 20
#: Pairs that a task counts before it hands them on.
HELD_PAIRS = 4_000_000
#: Characters of a run without, or of, white space from which a text goes through the vocabulary itself.
LONG_RUN = 400
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Csr:
    """Compressed sparse rows of counts: row i has the columns indices[indptr[i]:indptr[i + 1]], in order."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def spans(starts: np.ndarray, ends: np.ndarray, columns: int) -> Csr:
    """Rows of ones from ``starts`` to ``ends`` (exclusive)."""
    size = ends - starts
    indptr = np.append(0, np.cumsum(size))
    indices = np.arange(indptr[-1]) + np.repeat(starts - indptr[:-1], size)
    return Csr(indptr, indices, np.ones(len(indices), np.int64), columns)


def transpose(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    return Csr(np.append(0, np.cumsum(np.bincount(m.indices, minlength=m.columns))), m.row_of()[order], m.values[order], m.rows)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries that Gustavson's product meets in each row of a, before equal columns are summed; nothing is multiplied."""
    met = np.append(0, np.cumsum(np.diff(b.indptr)[a.indices]))
    return met[a.indptr[1:]] - met[a.indptr[:-1]]


def product(a: Csr, b: Csr) -> Csr:
    """a · b by rows (Gustavson): row i is the sum of b's rows that row i of a names, times its values."""
    n = np.diff(b.indptr)[a.indices]
    at = np.arange(n.sum()) + np.repeat(b.indptr[a.indices] - (np.cumsum(n) - n), n)
    key = np.repeat(a.row_of(), n) * b.columns + b.indices[at]
    value = np.repeat(a.values, n) * b.values[at]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    row, column = np.divmod(key[first], max(1, b.columns))
    values = np.add.reduceat(value, first) if len(first) else value
    return Csr(np.append(0, np.cumsum(np.bincount(row, minlength=a.rows))), column, values, b.columns)


def has_long_run(text: str, most: int = LONG_RUN) -> bool:
    """Whether a run without white space, or of white space, has ``most`` characters or more."""
    sizes = list(map(len, text.split()))
    return max(sizes, default=0) >= most or len(text) - sum(sizes) - len(sizes) >= most and re.search(r"\s{%d}" % most, text) is not None


class ByteTokens:
    """A byte-level vocabulary of `tokenizers`: ids of a text, and each id's bytes.

    ``ranks``, the same vocabulary for `tiktoken`, gives the same ids about three times as fast; texts with long runs, for which it
    isn't made, go through the vocabulary itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # The alphabet stands for the 256 bytes: bytes that print stand for themselves, the others for the letters from U+0100, in order.
        rest = sorted(c for c in ByteLevel.alphabet() if ord(c) > 255)
        own = {ord(c) for c in ByteLevel.alphabet() if ord(c) < 256}
        to_byte = {chr(b): b for b in own} | dict(zip(rest, (b for b in range(256) if b not in own)))
        vocabulary = self.model.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(to_byte.__getitem__, token)) if all(c in to_byte for c in token) else token.encode()
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        slow = [i for i, t in enumerate(texts) if self.fast is None or has_long_run(t)]
        out: list = [None] * len(texts)
        for i, x in zip(slow, self.model.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False) if slow else ()):
            out[i] = x.ids
        return [self.fast.encode_ordinary(t) if x is None else x for t, x in zip(texts, out)]


class PieceTokens:
    """A `sentencepiece` vocabulary: ids of a text, and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for piece in map(self.model.id_to_piece, range(self.model.get_piece_size())):
            one = _BYTE_PIECE.fullmatch(piece)
            self.bytes.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass(frozen=True)
class Aligned:
    """Of texts laid end to end: the tokens of both sides (ids, the number of tokens a text, starts and ends in bytes)."""

    ids: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray]
    starts: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    size: int

    def overlaps(self) -> Csr:
        """Pairs of tokens that overlap, with the bytes that they share."""
        a, b = (spans(s, e, self.size) for s, e in zip(self.starts, self.ends))
        return product(a, transpose(b))

    @cached_property
    def end_links(self) -> tuple[np.ndarray, np.ndarray]:
        """The overlap links whose tokens end together, as positions of both sides. Their ends cut the texts into groups."""
        m = self.overlaps()
        row = m.row_of()
        both = self.ends[0][row] == self.ends[1][m.indices]
        return row[both], m.indices[both]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of either side: how many groups end before it."""
        out = []
        for last, ends in zip(self.end_links, self.ends):
            cut = np.zeros(len(ends), np.int64)
            cut[last] = 1
            out.append(np.cumsum(cut) - cut)
        return out[0], out[1]

    def group_incidence(self) -> tuple[Csr, Csr]:
        n = len(self.end_links[0])
        return tuple(spans(g, g + 1, n) for g in self.groups)

    def shared_groups(self) -> Csr:
        """Pairs of tokens of the same group; as many as the product of a group's tokens, so ask for one text at a time."""
        a, b = self.group_incidence()
        return product(a, transpose(b))


class Aligner:
    """Lays texts end to end and aligns them; a text whose bytes the tokens don't give back has no tokens."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.sizes = tuple(np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        # An id as text, with what may follow it: the next of its side, the other side, the next group.
        self.said = [b"%d%s" % (i, mark) for i in range(max(len(a.bytes), len(b.bytes))) for mark in (b",", b"|", b";")]

    def __call__(self, texts: list[str | None]) -> Aligned:
        given = [f" {t}" if t else "" for t in texts]
        found = [self.a.encode(given), self.b.encode([t or "" for t in texts])]
        for i, text in enumerate(given):
            whole = text.encode()
            if not text or any(b"".join(map(side.bytes.__getitem__, ids[i])) != whole for side, ids in zip((self.a, self.b), found)):
                found[0][i] = found[1][i] = []
        counts = tuple(np.array([len(x) for x in side], np.int64) for side in found)
        ids = tuple(np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(found, counts))
        # Tokens without bytes, if a vocabulary has any, take part in no range.
        sizes = tuple(size[i] for size, i in zip(self.sizes, ids))
        ends = tuple(np.cumsum(n) for n in sizes)
        return Aligned(ids, counts, tuple(e - n for e, n in zip(ends, sizes)), ends, int(ends[0][-1]) if len(ends[0]) else 0)

    def group_texts(self, x: Aligned) -> list[bytes]:
        """For each text `a1,a2|b1;a3|b2,b3`: the ids of its groups, of the first side and the second."""
        group = x.groups
        n = tuple(np.bincount(g, minlength=len(x.end_links[0])) for g in group)
        before = tuple(np.cumsum(k) - k for k in n)
        out = np.zeros(len(group[0]) + len(group[1]), np.int64)
        for side in (0, 1):
            g = group[side]
            at = np.arange(len(g)) + (before[1][g] if side == 0 else before[0][g] + n[0][g])
            last = np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
            out[at] = 3 * x.ids[side] + np.where(last, 1 + side, 0)
        said, to = list(map(self.said.__getitem__, out.tolist())), np.append(0, np.cumsum(x.counts[0] + x.counts[1])).tolist()
        return [b"".join(said[i:j])[:-1] for i, j in zip(to, to[1:])]


def parts(texts: list[str | None], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters, or of one text."""
    at = 0
    while at < len(texts):
        to, room = at + 1, most - len(texts[at] or "")
        while to < len(texts) and (room := room - len(texts[to] or "")) >= 0:
            to += 1
        yield at, to
        at = to


def _per_text(x: Aligned, aligner: Aligner) -> tuple[list, ...]:
    n_texts = len(x.counts[0])
    a, b = x.end_links
    doc = np.repeat(np.arange(n_texts), x.counts[0])
    of = doc[a]
    pair = (of << 32) | (x.ids[0][a] * len(aligner.b.bytes) + x.ids[1][b])
    pair, times = np.unique(pair, return_counts=True)
    at = np.searchsorted(pair, np.arange(n_texts + 1) << 32).tolist()
    keys, times = (pair & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
    group_a, group_b = x.group_incidence()
    shared = product_sizes(group_a, transpose(group_b))
    links = np.bincount(of, minlength=n_texts)  # one for each group
    digests = [hashlib.sha256(g).hexdigest() if g else "" for g in aligner.group_texts(x)]
    return (
        x.counts[0], x.counts[1], links, links, np.bincount(doc, shared, n_texts).astype(np.int64), digests,
        [keys[i:j].tobytes() for i, j in zip(at, at[1:])], [times[i:j].tobytes() for i, j in zip(at, at[1:])],
    )


_FOUND = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_shared": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str], ranks: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row, then n_a, n_b, n_groups, n_links (tokens that end together), n_shared (pairs that share a group), groups_sha256, and the row's
    distinct linked id pairs: ``pairs`` (a * size of b's vocabulary + b) and ``times``, both little-endian unsigned 32-bit. One pass, no shuffle."""

    def make():
        aligner = Aligner(ByteTokens(a_path, ranks, pattern), PieceTokens(b_path))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = batch.column(len(keep)).to_pylist(), [[] for _ in _FOUND]
            for i, j in parts(texts):
                for column, new in zip(out, _per_text(aligner(texts[i:j]), aligner)):
                    column.extend(new)
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, t) for c, t in zip(out, _FOUND.values()))], names=[*keep, *_FOUND])

        return one

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return map_batches(rows, make, own + "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs binary, times binary")


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no pair of its second id has more."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pair, np.bincount(at, np.concatenate([n for _, n in held]), len(pair)).astype(np.int64)

        def given() -> pa.RecordBatch:
            pair, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            data = [b"".join(c.to_pylist()) for c in batch.columns]
            held.append((np.frombuffer(data[0], "<u4"), np.frombuffer(data[1], "<u4").astype(np.int64)))
            if sum(len(p) for p, _ in held) > HELD_PAIRS:
                held[:] = [merged()]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield given()
                    held.clear()
        if held:
            held[:] = [merged()]
            yield given()

    counted = written(found.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = (F.col("pair") % b_size).alias("b")
    most = counted.groupBy(b).agg(F.max("n").alias("most"))  # a row an id of the vocabulary
    return counted.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(found: DataFrame, b_size: int, keep: list[str], frequent: int = FREQUENT) -> DataFrame:
    """``align``'s rows with n_best (links whose pair no other pair of its second id outdoes in the corpus) and count_sum (over links, the count of their pair).

    Frequent pairs, at most ``frequent`` whatever the corpus, are broadcast and settled where the rows are; only links of the other pairs
    are dealt by pair, each of them a small key by definition."""
    spark = found.sparkSession
    marked = written(found.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(marked, b_size), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = counts.where(F.col("n") > total / frequent).orderBy("pair").toPandas()
    known = spark.sparkContext.broadcast((few["pair"].to_numpy(np.uint32), few["n"].to_numpy(np.int64), few["best"].to_numpy(bool)))
    columns = [*keep, "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "_row"]
    rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def make():
        pairs, n, best = known.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [batch.column(len(columns) + i).to_pylist() for i in (0, 1)]
            size = np.array([len(x) // 4 for x in data[0]], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            key, times = np.frombuffer(b"".join(data[0]), "<u4"), np.frombuffer(b"".join(data[1]), "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
            hit = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            n_best, count_sum = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, row[hit], times[hit] * n[at[hit]])
            rest = pa.StructArray.from_arrays([pa.array(key[~hit].astype(np.int64)), pa.array(times[~hit])], names=["pair", "times"])
            to = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(size)))).astype(np.int32)
            own = [batch.column(i) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays([*own, pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(pa.array(to), rest).cast(rest_type)], names=[*columns, "n_best", "count_sum", "rest"])

        return one

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in marked.select(*columns).schema)
    settled = written(map_batches(marked.select(*columns, "pairs", "times"), make, own + "n_best long, count_sum long, rest array<struct<pair:bigint,times:bigint>>"), "settled")
    rare = settled.select("_row", F.inline("rest")).join(counts.where(F.col("n") <= total / frequent), "pair")
    more = rare.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    sum_of = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return settled.join(more, "_row", "left").select(*columns[:-1], sum_of("n_best", F.col("_best")), sum_of("count_sum", F.col("_sum")))


def cross_tokenizer(docs: DataFrame, a_path: str, b_path: str, keep: list[str], ranks: str | None = None, pattern: str | None = None, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """Every row's alignment (``align``) with the corpus counts of its links (``with_counts``).

    Null and empty texts, and texts whose bytes either side doesn't give back, have no tokens: zeros and an empty digest; they count nowhere.
    Repeated rows and rows with null ids are documents like others; no ids are compared. An empty table gives no rows. Other columns may have any names."""
    b_size = len(PieceTokens(b_path).bytes)
    return with_counts(align(docs, a_path, b_path, keep, ranks, pattern, text_col), b_size, keep, frequent)

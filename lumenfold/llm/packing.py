"""Vector bin packing of examples into fixed-length training sequences.

An example is a run of token ids with three sizes: tokens, segments (1) and loss-bearing tokens. A sequence has a
limit on each. The open sequence takes, again and again, the pending example that fits and has the largest dot
product with the room that is left (both as shares of the limits). When none fits, an example is cut to fill
the gap, unless the gap is under ``min_cut``. What is left at the end of a task is laid out in sequences whose
lengths are powers of two, which need no padding.

Each task packs its own rows with a pool of bounded size: there is no shuffle, and a rerun task repeats its result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.groups import lean

END_ID = 2
#: Words that a task remembers the ids of.
CACHED_WORDS = 800_000
#: Bytes of texts that are encoded together (a longer text by itself).
AT_ONCE = 1 << 22
#: Conversations that are encoded together.
TAKEN = 256
#: Words that may be letters and marks; the apostrophe is no such mark, as some endings begin with it.
_LETTERS_MARKS = r"^(?P<letters>[^\x00-@\[-`{-\x7f]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``pool``: pending examples of a task; ``min_cut``: the smallest gap that is filled by cutting."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    pool: int = 1024
    min_cut: int = 16


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` vocabulary that never joins across spaces, with a cache of words.

    Arrow cuts texts at spaces and keeps each distinct word once. A word is letters and then marks, two pre-tokens at
    most, or something else. Letters are lower-cased, encoded many at a time with the vocabulary's own model, and the
    ids are cut after each word-end token. If the cuts don't match the words, each goes through the whole tokenizer by
    itself, as marks and all other words do."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # Lower-case composed letters need no normalisation, and no splitting but at spaces; ASCII ones are their own byte-level form.
        self.ascii, self.plain = Tokenizer(self.model.model), Tokenizer(self.model.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        #: Ids of letters (None: these must be encoded with what follows), and of marks and whole words.
        self.letters: dict[str, bytes | None] = {}
        self.whole: dict[str, bytes] = {"": b""}

    @staticmethod
    def _composed(word: str) -> bool:
        """Whether lower-casing gives letters that need no normalisation, whatever stands next to them."""
        return "\u03a3" not in word and word.isalpha() and is_normalized("NFC", word) and (low := word.lower()).isalpha() and is_normalized("NFC", low)

    def _encode_plain(self, tokenizer, words: list[str]) -> None:
        if not words:
            return
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            data, at = ids.tobytes(), 0
            for w, to in zip(words, (cuts * 4).tolist()):
                self.letters[w] = data[at:to]
                at = to
        else:
            self._encode_whole(words, self.letters)

    def _encode_whole(self, words: list[str], into: dict[str, bytes]) -> None:
        for w, x in zip(words, self.model.encode_batch_fast(words, add_special_tokens=False)):
            into[w] = np.asarray(x.ids, "<u4").tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """Of words whose A-Z are lower-cased, of ASCII letters and anything beyond ASCII."""
        lower = {w: w.lower() if self._composed(w) else None for w in words if not w.isascii()}
        self._encode_plain(self.ascii, [w for w in words if w.isascii()])
        self._encode_plain(self.plain, list({low: None for low in lower.values() if low and low not in self.letters}))
        for w, low in lower.items():
            self.letters[w] = low and self.letters[low]

    def _learn_whole(self, words: list[str]) -> None:
        self._encode_whole(words, self.whole)

    @staticmethod
    def _look_up(words: pa.Array, known: dict, learn: Callable[[list[str]], None]) -> pa.Array:
        coded = words.dictionary_encode()
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if missing := [w for w in keys if w not in known]:
            learn(missing)
        return pa.array([known[w] for w in keys], pa.large_binary()).take(coded.indices)

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        parts = pc.extract_regex(words, _LETTERS_MARKS)
        ids = self._look_up(pc.ascii_lower(pc.struct_field(parts, "letters")), self.letters, self._learn_letters)
        marks = pc.struct_field(parts, "marks")
        if ids.null_count:
            rest = ids.is_null()
            ids = pc.replace_with_mask(ids, rest, self._look_up(words.filter(rest), self.whole, self._learn_whole))
            marks = pc.if_else(rest, "", marks)
        return pc.binary_join_element_wise(ids, self._look_up(marks, self.whole, self._learn_whole), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return list(self.encoded(pa.array(texts, pa.large_string())))

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """As ``encode``, of an Arrow column (null: no ids)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while at < len(texts):
            if len(self.letters) + len(self.whole) > CACHED_WORDS:
                self._forget()
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
            part = texts.slice(at, to - at)
            for space in "\n\t\r":
                part = pc.replace_substring(part, space, " ")
            split = pc.split_pattern(part, " ")
            coded = split.flatten().dictionary_encode()
            ids = self._of_words(coded.dictionary).take(coded.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            yield from (data[low:high].tobytes() for low, high in zip(ends, ends[1:]))
            at = to


class Packer:
    """Takes examples, gives rows (doc, start, length, ids, doc_tokens, sequence, offset)."""

    def __init__(self, limits: Limits, first: int):
        self.limits, self.next, self.pending, self.rows = limits, first, [], []
        self.most = np.array([limits.tokens, limits.segments, limits.loss], float)

    def _lay(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, mask, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, ids, total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes, mask: np.ndarray | None = None) -> None:
        """mask: which tokens bear loss; None: all."""
        n, at = len(ids) // 4, 0
        while n - at >= self.limits.tokens:
            to = at + self.limits.tokens
            if mask is not None and mask[at:to].sum() > self.limits.loss or mask is None and self.limits.tokens > self.limits.loss:
                to = at + self._within(mask, at, n)
                self.pending.append((doc, at, ids[4 * at : 4 * to], None if mask is None else mask[at:to], n))
            else:
                self._lay([(doc, at, ids[4 * at : 4 * to], None, n)])
            at = to
        while at < n:
            to = min(n, at + self._within(mask, at, n))
            self.pending.append((doc, at, ids[4 * at : 4 * to], None if mask is None else mask[at:to], n))
            at = to
        if len(self.pending) >= self.limits.pool:
            self._pack(self.limits.pool // 2)

    def _within(self, mask, at: int, n: int) -> int:
        """Tokens from ``at`` that keep the limits by themselves, at least one."""
        if mask is None:
            return max(1, min(n - at, self.limits.tokens, self.limits.loss))
        loss = np.cumsum(mask[at : at + self.limits.tokens])
        return max(1, int(np.searchsorted(loss, self.limits.loss, "right")))

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc, start, ids, mask, total = piece
        return (doc, start, ids[: 4 * n], None if mask is None else mask[:n], total), (doc, start + n, ids[4 * n :], None if mask is None else mask[n:], total)

    def _sizes(self, pieces: list[tuple]) -> np.ndarray:
        return np.array([(len(p[2]) // 4, 1, len(p[2]) // 4 if p[3] is None else int(p[3].sum())) for p in pieces], float).reshape(-1, 3)

    def _pack(self, keep: int) -> None:
        pool, sizes = self.pending, self._sizes(self.pending)
        shares, columns, free = sizes / self.most, sizes.T.copy(), np.ones(len(pool), bool)
        left = len(pool)
        while left > keep and sizes[free, 0].sum() >= self.limits.tokens:
            room, chosen = self.most.copy(), []
            while True:
                fits = free & (columns <= room[:, None]).all(0)
                if not fits.any():
                    break
                i = int(np.argmax(np.where(fits, shares @ (room / self.most), -1)))
                chosen.append(pool[i])
                free[i] = False
                left -= 1
                room = room - sizes[i]
            gap = int(room[0])
            if gap >= self.limits.min_cut and room[1] >= 1 and left and (i := self._cuttable(pool, sizes, free, gap, room[2])) is not None:
                head, tail = self._cut(pool[i], gap)
                chosen.append(head)
                pool[i] = tail
                columns[:, i] = sizes[i] = self._sizes([tail])[0]
                shares[i] = sizes[i] / self.most
            self._lay(chosen)
        self.pending = [p for p, f in zip(pool, free) if f]

    def _cuttable(self, pool, sizes, free, gap: int, loss: float) -> int | None:
        """The longest pending example whose first ``gap`` tokens keep the limit on loss."""
        order = np.argsort(-np.where(free, sizes[:, 0], -1), kind="stable")[:8]
        for i in order:
            if free[i] and sizes[i, 0] > gap and (gap if pool[i][3] is None else pool[i][3][:gap].sum()) <= loss:
                return int(i)
        return None

    def finish(self) -> None:
        """Packs what is pending; the last tokens go to sequences of power-of-two length."""
        self._pack(0)
        left = sum(len(p[2]) // 4 for p in self.pending)
        pending, self.pending = self.pending[::-1], []
        while left:
            reach = sum(len(p[2]) // 4 for p in pending[-self.limits.segments :])
            size = 1 << (min(reach, self.limits.tokens, self.limits.loss).bit_length() - 1)
            need, loss, pieces = size, self.limits.loss, []
            while need and pending and len(pieces) < self.limits.segments:
                piece = pending.pop()
                n = min(need, len(piece[2]) // 4, self._loss_prefix(piece, loss))
                if not n:
                    pending.append(piece)
                    break
                head, tail = self._cut(piece, n)
                pieces.append(head)
                loss -= n if head[3] is None else int(head[3].sum())
                if tail[2]:
                    pending.append(tail)
                need -= n
            self._lay(pieces)
            left -= size - need

    @staticmethod
    def _loss_prefix(piece: tuple, loss: int) -> int:
        return loss if piece[3] is None else int(np.searchsorted(np.cumsum(piece[3]), loss, "right"))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), _ARROW)], schema=_ARROW)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole texts; every token bears loss. Returns the pieces with their ids (little-endian uint32).

    A null or empty text is the end id alone. Repeated rows are packed once each; a null id stays null. An
    empty table gives no rows. Other columns of ``docs`` are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = WordTokenizer(tokenizer_path), Packer(limits, TaskContext.get().partitionId() << 32)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1))):
                packer.add(doc, x + end)
                if len(packer.rows) >= 1024:
                    yield from _batches(packer.take())
        packer.finish()
        yield from _batches(packer.take())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Packs instruction data: a conversation is one example, and only the assistant's tokens bear loss.

    A conversation's turns are gathered in order of turn (one conversation is bounded by its own length); null
    texts are empty, null roles bear no loss. Same result columns as ``pack_documents``, ``doc_id`` being the conversation."""
    gathered = turns.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.coalesce(text_col, F.lit("")).alias("x")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = WordTokenizer(tokenizer_path), Packer(limits, TaskContext.get().partitionId() << 32)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TAKEN):
                rows = batch.slice(at, TAKEN).to_pylist()
                found = iter(tokens.encode([t["x"] for row in rows for t in row["turns"]]))
                for row in rows:
                    ids = [x + end for x in islice(found, len(row["turns"]))]
                    mask = np.concatenate([np.full(len(x) // 4, t["r"] == "assistant") for x, t in zip(ids, row["turns"])])
                    packer.add(row["doc_id"], b"".join(ids), mask)
                yield from _batches(packer.take())
        packer.finish()
        yield from _batches(packer.take())

    return gathered.mapInArrow(lean(run), PIECES)

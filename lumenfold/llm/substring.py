"""Removal of word sequences that occur earlier in the corpus, by suffix automata of reference shards.

1. A window is ``length`` consecutive words. Its anchor is the smallest hash of the 6-word sequences in it, so equal windows have
   equal anchors. Tasks send the anchors of runs of windows, packed, to shards that find the anchors met more than once.
2. Documents are joined with their runs of shared anchors and give the words of each run. Equal runs that a task holds at a time
   are told apart at once: all but the first are repeats.
3. All runs of an anchor form a small reference shard. Its suffix automaton grows in order of place (document, start); each run is
   streamed through it first, and its matching statistics say which windows occur earlier, and where first.
   An anchor with very many runs is dealt out anew, window by window; of equal windows all but the first are repeats.
4. The spans of repeated windows are merged and removed from the texts.

The reference shards grow with the corpus, so they are not broadcast: each meets its runs by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import bytes_of, map_batches, text_bytes, with_text, written
from lumenfold.llm.components import map_groups
from lumenfold.operators.groups import lean
from lumenfold.operators.words import WordHashes, sequence_hashes

LENGTH, GRAM = 20, 6
#: Windows of one run at most.
RUN = 64
#: Words whose runs a task packs together, and words that it holds as such at a time.
PACK_WORDS, HELD_WORDS = 3_000_000, 200_000
#: Bytes of text whose anchors are one shard.
SHARD_BYTES = 32 << 20
#: Different runs of an anchor beyond which its windows are dealt out one by one.
HOT = 4096
#: Hot anchors up to which they are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ANCHORS = 200_000
#: Bytes of runs, as Python holds them, up to which a task tells equal ones apart before it gives them; rows of whole texts that it makes at a time.
GIVEN_BYTES, ROWS = 16 << 20, 256
#: Places of texts with a null id begin here, behind all ids.
NO_ID = 1 << 62


def anchors(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window that starts at each word (len - length + 1 of them), and the hash of each word sequence."""
    grams = sequence_hashes(hashes, gram)
    span, width, low = length - gram + 1, 1, grams
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return (np.minimum(low[: len(low) - rest], low[rest:]) if rest else low), grams


def runs_of(hashes: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window, windows, may repeat itself) of the runs of documents laid end to end, ``counts`` words each.

    A window can come twice in a run only if the anchor's words do."""
    nothing = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    if len(hashes) < length:
        return nothing
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    start = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])
    if not len(start):
        return nothing
    anchor, grams = anchors(hashes, length)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    pieces = -(-size // RUN)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(first, pieces) + piece * RUN
    windows = np.minimum(RUN, np.repeat(first + size, pieces) - at)
    span, met = windows + length - GRAM, np.zeros(len(at), np.int8)
    rest = np.arange(len(at))
    for j in range(int(span.max())):
        if j >= length:
            rest = rest[span[rest] > j]
        inside = rest if j < length - GRAM else rest[span[rest] > j]
        met[inside] += grams[start[at[inside]] + j] == anchor[at[inside]]
    return anchor[at], doc[start[at]], start[at] - begin[doc[start[at]]], windows, met > 1


def _pack(*arrays: np.ndarray) -> bytes:
    """Columns of the same length, column by column, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def shared_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, first, windows, anchor) of the runs whose anchor is met again, of columns doc_id and text (bytes).

    A task sends an anchor that it meets several times once, without places, however often: it keeps those runs itself."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) + 8

    def make():
        hashes = WordHashes()

        def runs(ids: list[int], split: list[list[bytes]]) -> tuple[np.ndarray, ...]:
            a, d, s, n, own = runs_of(hashes([w for words in split for w in words]), np.array([len(w) for w in split], np.int64), length)
            return a, np.array(ids, np.int64)[d], s.astype(np.int32), n.astype(np.uint8), own

        def pack(parts: list[tuple[np.ndarray, ...]], out: list[tuple]) -> None:
            a, doc, s, n, own = (np.concatenate(c) for c in zip(*parts))
            parts.clear()
            order = np.argsort(a, kind="stable")
            a, doc, s, n = a[order], doc[order], s[order], n[order]
            new = np.append(True, a[1:] != a[:-1]) if len(a) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(a)))
            # An anchor that is met several times here, or whose run may repeat itself.
            several = np.repeat((size > 1) | np.logical_or.reduceat(own[order], first), size) if len(a) else new
            shard = (a % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            ends = np.flatnonzero(np.append(shard[by][1:] != shard[by][:-1], True)) + 1 if len(by) else []
            for low, high in zip([0, *ends[:-1]], ends):
                part = by[low:high]
                one, many = part[~several[part]], part[several[part] & new[part]]
                out.append((int(shard[part[0]]), _pack(a[one], doc[one], s[one], n[one]), _pack(a[many]), None))
            if several.any():
                out.append((int(a[0] % np.uint64(shards)), None, None, _pack(a[several], doc[several], s[several], n[several])))

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, texts, out, parts, split, held, size, packed = batch.column(0).to_pylist(), batch.column(1), [], [], [], [], 0, 0
            for i in range(batch.num_rows):
                split.append((texts[i].as_py() or b"").split())
                held.append(ids[i])
                size += len(split[-1])
                last = i == batch.num_rows - 1
                if size >= HELD_WORDS or last:
                    parts.append(runs(held, split))
                    packed += size
                    split, held, size = [], [], 0
                if packed >= PACK_WORDS or last:
                    pack(parts, out)
                    packed = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "once", "several", "own"]) if out else None

        return one

    def shard(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        place = ("u8", "i8", "i4", "u1")
        once = [_unpack(x, *place) for x in group["once"] if x is not None]
        several = [_unpack(x, "u8")[0] for x in group["several"] if x is not None]
        own = [_unpack(x, *place) for x in group["own"] if x is not None]
        columns = [np.concatenate([c[k] for c in once]) if once else np.zeros(0, t) for k, t in enumerate(place)]
        met, count = np.unique(np.concatenate([columns[0], *several, *several]), return_counts=True)
        keep = count[np.searchsorted(met, columns[0])] > 1 if len(columns[0]) else np.zeros(0, bool)
        columns = [np.concatenate([c[keep], *(x[k] for x in own)]) for k, c in enumerate(columns)]
        if not len(columns[0]):
            return None
        a, doc, s, n = columns
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s), pa.array(n.astype(np.int32)), pa.array(a.view(np.int64))], names=["doc_id", "first", "windows", "anchor"])

    packed = map_batches(docs.select("doc_id", "text"), make, "shard int, once binary, several binary, own binary")
    return map_groups(packed, ["shard"], shard, "doc_id long, first int, windows int, anchor long")


class SuffixAutomaton:
    """Of several word sequences; each state keeps the place (document, word) where its sequences first ended."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, link: int, moves: dict, first) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list[bytes], doc: int, start: int) -> None:
        last = 0
        for i, w in enumerate(words, start):
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
                continue
            new = self._state(self.length[last] + 1, 0, {}, (doc, i))
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
            last = new

    def matches(self, words: list[bytes], length: int) -> list[tuple[int, int] | None]:
        """For the window that ends at each word from the ``length``-th: where its words first ended, or None."""
        state, size, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            if i < length - 1:
                continue
            if size < length:
                out.append(None)
                continue
            v = state
            while self.length[self.link[v]] >= length:
                v = self.link[v]
            state, size = v, min(size, self.length[v])
            out.append(self.first[v])
        return out


def repeated(rows: list[tuple[tuple[int, int], int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """rows: (document (id, hash of the text), first word, words joined by spaces) of a reference shard, in order of place. Spans of each row's words that
    windows with an earlier place cover."""
    automaton, out = SuffixAutomaton(), []
    for k, (doc, start, text) in enumerate(rows):
        words, spans = text.split(b" "), []
        if len(rows) == 1 and len(set(words)) > len(words) - length:
            out.append(spans)  # too few repeats of words for a window to come again within the run
            continue
        found = automaton.matches(words, length) if k else [None] * (len(words) - length + 1)
        if len(set(words)) <= len(words) - length:
            # The run may repeat itself: it is laid down before it is streamed, as places are compared anyway.
            automaton.add(words, doc, start)
            found = automaton.matches(words, length)
        elif None in found and k < len(rows) - 1:
            automaton.add(words, doc, start)
        for j, end in enumerate(found):
            if end is not None and (end[0], end[1] - length + 1) < (doc, start + j):
                if spans and start + j <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], start + j + length)
                else:
                    spans.append((start + j, start + j + length))
        out.append(spans)
    return out


def shard_spans(rows: list[list], length: int) -> list[tuple[int, int, int, int]]:
    """(document, key, begin, end) to be removed, of a reference shard's rows (document, key, begin, words) in order of place.

    A run that is equal to an earlier one goes as a whole; different ones are streamed through the automaton."""
    first: dict[bytes, tuple[tuple[int, int], int]] = {}
    for doc, key, begin, text in rows:
        first.setdefault(text, ((doc, key), begin))
    found: dict[bytes, list[tuple[int, int]]] = {}
    if len(first) > 1 or rows and len(set(w := rows[0][3].split(b" "))) <= len(w) - length:
        found = dict(zip(first, repeated([(d, b, t) for t, (d, b) in first.items()], length)))
    out = []
    for doc, key, begin, text in rows:
        if first[text] != ((doc, key), begin):
            out.append((doc, key, begin, begin + text.count(b" ") + 1))
        elif found:
            out += [(doc, key, a, b) for a, b in found[text]]
    return out


class _Firsts:
    """Of equal runs, the first place; the others are spans to be removed. Told among what GIVEN_BYTES hold, whatever the batches are."""

    def __init__(self, length: int):
        self.length, self.held, self.spans, self.bytes = length, {}, [], 0

    def add(self, anchor: int, doc: int, key: int, first: int, text: bytes) -> None:
        now = (doc, key, first)
        before = self.held.setdefault((anchor, text), now)
        if before is now:
            self.bytes += len(text) + 400  # with its key, place and entry
            return
        if now == before:
            return
        if now < before:
            self.held[anchor, text], now = now, before
        self.spans.append((*now, now[2] + text.count(b" ") + 1))
        self.bytes += 200

    def full(self) -> bool:
        return self.bytes >= GIVEN_BYTES

    def take(self) -> pa.RecordBatch | None:
        rows = [(a, d, k, f, None, t) for (a, t), (d, k, f) in self.held.items()] + [(None, d, k, a, b, None) for d, k, a, b in self.spans]
        self.held, self.spans, self.bytes = {}, [], 0
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["anchor", "doc_id", "key", "begin", "end", "words"]) if rows else None


_RUNS = "anchor long, doc_id long, key long, begin int, end int, words binary"


def _first_runs(rows: DataFrame, put: Callable[..., None], length: int) -> DataFrame:
    """What _Firsts makes of the runs that ``put`` adds for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = _Firsts(length)
        for batch in batches:
            for i in range(batch.num_rows):
                put(firsts, *(c[i].as_py() for c in batch.columns))
                if firsts.full():
                    yield firsts.take()
        if (out := firsts.take()) is not None:
            yield out

    return rows.mapInArrow(lean(run), _RUNS)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, begin, end): words of columns doc_id, key (a hash of the text), text (bytes) that are to go.

    Copies of a row have the same runs, which are gathered once for all of them. Runs come by a hash of id and text; should two
    documents share one, each is tried at the other's runs as well, which decides nothing by itself."""
    document = F.xxhash64("doc_id", "key")
    found = shared_runs(docs.select(document.alias("doc_id"), "text"), length)
    candidates = found.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(F.struct("first", "windows", "anchor")).alias("runs"))

    def give(firsts: _Firsts, doc: int, key: int, text: bytes | None, found: list[dict]) -> None:
        words = (text or b"").split()
        for run in found:
            a, n = run["first"], run["windows"] + length - 1
            if a + n <= len(words):  # the runs may be another document's as well
                firsts.add(run["anchor"], doc, key, a, b" ".join(words[a : a + n]))

    runs = written(_first_runs(docs.join(candidates, document == F.col("_of")).select("doc_id", "key", "text", "runs"), give, length), "runs")
    texts = runs.where("anchor is not null")
    hot = written(texts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    marked = texts.join(F.broadcast(hot) if hot.count() <= BROADCAST_ANCHORS else hot, "anchor", "left")

    def deal(firsts: _Firsts, doc: int, key: int, begin: int, run: bytes) -> None:
        words = run.split(b" ")
        for j in range(len(words) - length + 1):
            firsts.add(0, doc, key, begin + j, b" ".join(words[j : j + length]))

    dealt = written(_first_runs(marked.where("hot").select("doc_id", "key", "begin", "words"), deal, length), "hot-runs")
    # Of equal windows the first stays; the rest go by their places, each a key of its own, so nothing gathers what every batch may hold.
    windows = dealt.where("anchor is not null").select("doc_id", "key", "begin", "end", "words")
    firsts = windows.groupBy("words").agg(F.min(F.struct("doc_id", "key", "begin")).alias("place")).select("place.*")
    later = windows.select("doc_id", "key", "begin", (F.col("begin") + length).alias("end")).join(firsts, ["doc_id", "key", "begin"], "left_anti")
    shards = marked.where("hot is null").select("anchor", "doc_id", "key", "begin", "words")

    def match(batches):
        rows, anchor = [], None

        def spans(batch: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "key", "begin", "end"])

        for batch in batches:
            out = []
            for a, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if a != anchor:
                    out += shard_spans(rows, length)
                    rows, anchor = [], a
                rows.append(row)
            if out:
                yield spans(out)
        if out := shard_spans(rows, length):
            yield spans(out)

    dealt_out = shards.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "begin")
    found = dealt_out.mapInArrow(lean(match), "doc_id long, key long, begin int, end int")
    decided = [r.where("anchor is null").select("doc_id", "key", "begin", "end") for r in (runs, dealt)]
    return found.unionByName(decided[0]).unionByName(decided[1]).unionByName(later)


def without_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row, then n_words, n_removed, kept (the words left, joined by one space; null for a null text) and spans.

    A word goes if a window over it also starts earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the
    input. Words are split at ASCII white space and compared byte by byte. Repeated rows (same id and text) are one
    document and keep or lose the same words; other texts with the same id are other documents, in the order of their hashes. Texts with a null id are documents behind
    all ids (below 2^62), in the order of their hashes; so no key gathers them. Texts of fewer than ``length`` words stay. An empty table gives no rows."""
    key = F.xxhash64(text_col)
    place = F.coalesce(F.col(id_col).cast("long"), key.bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    sent, text_at = with_text(docs, keep, text_col)
    rows = docs.select(*sent, place.alias("_doc"), key.alias("_key"))
    spans = _spans(docs.select(place.alias("doc_id"), key.alias("key"), text_bytes(text_col).alias("text")), length)
    own = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("_spans"))
    joined = rows.join(own, ["_doc", "_key"], "left").select(*rows.columns[: len(sent)], "_spans")
    spans_at = len(sent)
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, out = batch.column(spans_at), []
            for i, text in enumerate(bytes_of(batch.column(text_at))):
                spans = found[i].as_py() or []
                words, merged, kept, at = (text or b"").split(), [], [], 0
                for s in spans:
                    if merged and s["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                for s in merged:
                    kept += words[at : s["begin"]]
                    at = s["end"]
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), None if text is None else b" ".join(kept).decode(), merged))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), span_type))]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=[*keep, "n_words", "n_removed", "kept", "spans"])

        return one

    kept_columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_batches(joined, make, f"{kept_columns}, n_words long, n_removed long, kept string, spans array<struct<begin:int,end:int>>", ROWS)

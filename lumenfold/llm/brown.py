"""Brown class-based bigrams: exchange clustering of words into classes, and smoothed log probabilities of texts.

1. All training words are counted. The core are the words that make up at least ``core_share`` of the tokens: at most
   1 / core_share words, however large the corpus; they and the text's end are what is broadcast.
2. Texts become chunks of numbers: core words by their place, others by a small dictionary of the chunk.
3. Bigrams of units are counted. A unit is a core word, the end, or a spelling group (other words by their last two bytes). In each exchange round
   a share of the units move, each to the class that raises the likelihood of the class bigrams most, given all others' classes (exact
   gains). A round that lowers the likelihood is taken back, and fewer units move at once from then on.
4. Every other word is taken out of its spelling group and moved in the same way, by its own neighbours. Their counts and classes stay in a
   table and reach the chunks by a join.

``P(w | before) = mix * T(class | class before) * E(w | class) + (1 - mix) * base(w)``. E is c(w) / N(class), less the share
of the class that words seen once take: that share is for unknown words (Good and Turing's estimate), which have their spelling group's class. In T's counts,
a neighbour of a word outside the core that is itself outside the core stands for its spelling group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import LOWER, map_batches, text_bytes, written
from lumenfold.llm.components import map_groups

#: The text's end as a word; no word holds white space.
END = b"\n"
SPELLINGS = 64
#: Words outside the core, and all words, of one chunk; distinct words and bigrams that a task counts before it hands them on.
CHUNK_RARE, CHUNK_TOKENS, HELD_WORDS, HELD_BIGRAMS = 200_000, 1_000_000, 1_000_000, 2_000_000
#: Counts below which gains are looked up.
_SMALL = 256
#: Training tokens whose bigrams are one shard.
SHARD_TOKENS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """classes: besides the end's own, at most 84. core_share: see above. rounds: of exchange. mix: weight of the class model."""

    classes: int = 32
    core_share: float = 4e-7
    rounds: int = 8
    mix: float = 0.9

    def __post_init__(self):
        if not 1 <= self.classes <= 84:
            raise ValueError("1 to 84 classes")


def spelling(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SPELLINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of a column text (bytes), with END once a document."""

    def count(batches):
        held: Counter = Counter()

        def rows(batch: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(batch), pa.binary()), pa.array(list(batch.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or b"").translate(LOWER).split())
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Units:
    """Unit numbers: core words, then spelling groups, then the end."""

    def __init__(self, core: list[bytes]):
        self.index = {w: i for i, w in enumerate(core)}
        self.core, self.end = len(core), len(core) + SPELLINGS
        self.count = self.end + 1


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


@dataclass
class Chunk:
    """Texts as numbers: codes are core words, or -1 - place for the chunk's own words; spellings are those words' groups."""

    ids: list
    training: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    spellings: np.ndarray
    words: bytes

    @staticmethod
    def of(row: dict) -> Chunk:
        blobs = row["blobs"]
        return Chunk(row["ids"], *(_unpack(b, t) for b, t in zip(blobs, ("?", "i4", "i4", "u1"))), zstandard.ZstdDecompressor().decompress(blobs[4]))

    def tokens(self, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts with the end (code ``units`` - 1) after each, and each token's text."""
        n = len(self.lengths)
        out = np.full(len(self.codes) + n, units - 1, np.int64)
        out[np.arange(len(self.codes)) + np.repeat(np.arange(n), self.lengths)] = self.codes
        return out, np.repeat(np.arange(n), self.lengths + 1)

    def units(self, codes: np.ndarray, units: Units) -> np.ndarray:
        if not len(self.spellings):
            return codes
        return np.where(codes < 0, units.core + self.spellings.astype(np.int64)[np.where(codes < 0, -1 - codes, 0)], codes)


def before(tokens: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([np.full(min(1, len(tokens)), end), tokens[:-1]])


def chunks(docs: DataFrame, units) -> DataFrame:
    """(chunk, ids, blobs) of columns doc_id, text (bytes), training."""

    def run(batches):
        get = units.value.index.get
        number, made, at = TaskContext.get().partitionId() << 32, 0, {}
        held: list[tuple] = []
        tokens = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, at, made, tokens
            ids, training, codes = zip(*held)
            columns = [np.array(training, bool), np.array([len(c) for c in codes], np.int32), np.concatenate(codes), np.array([spelling(w) for w in at], np.uint8)]
            blobs = [*map(_pack, columns), zstandard.ZstdCompressor(level=1).compress(END.join(at))]
            row = pa.RecordBatch.from_arrays([pa.array([number + made]), pa.array([list(ids)], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary()))], names=["chunk", "ids", "blobs"])
            held, at, tokens = [], {}, 0
            made += 1
            return row

        for batch in batches:
            ids, texts, training = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").translate(LOWER).split()
                codes = np.array([get(w, -1) for w in words], np.int32)
                rare = np.flatnonzero(codes < 0)
                if len(rare):
                    codes[rare] = [-1 - at.setdefault(words[j], len(at)) for j in rare.tolist()]
                held.append((ids[i], bool(training[i]), codes))
                tokens += len(words) + 1
                if len(at) >= CHUNK_RARE or tokens >= CHUNK_TOKENS:
                    yield emit()
        if held:
            yield emit()

    return docs.select("doc_id", "text", "training").mapInArrow(run, "chunk long, ids array<long>, blobs array<binary>")


def count_bigrams(encoded: DataFrame, units, shards: int) -> DataFrame:
    """(shard, after, after_n, before, before_n): packed bigrams of units, once by the first unit's shard and once by the second's.

    Keys are first << 32 | second and second << 32 | first, with the shard's own unit high."""

    def run(batches):
        known = units.value
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
            parts.clear()
            turned = (keys & 0xFFFFFFFF) << 32 | keys >> 32
            order = np.argsort(turned, kind="stable")
            cut = []
            for k, c in ((keys, counts), (turned[order], counts[order])):
                shard = (k >> 32) % shards
                order = np.argsort(shard, kind="stable")
                cut.append((k[order], c[order], np.searchsorted(shard[order], np.arange(shards + 1))))
            rows = []
            for s in range(shards):
                (k0, c0), (k1, c1) = ((k[at[s] : at[s + 1]], c[at[s] : at[s + 1]]) for k, c, at in cut)
                if len(k0) or len(k1):
                    rows.append((s, _pack(np.diff(k0, prepend=0)), _pack(c0.astype(np.int32)), _pack(np.diff(k1, prepend=0)), _pack(c1.astype(np.int32))))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk.of(batch.slice(i, 1).to_pylist()[0])
                tokens, text = chunk.tokens(known.count)
                line = chunk.units(tokens, known)
                learned = chunk.training[text]
                keys, counts = np.unique(before(line, known.end)[learned] << 32 | line[learned], return_counts=True)
                parts.append((keys, counts.astype(np.int64)))
                if sum(len(k) for k, _ in parts) > HELD_BIGRAMS:
                    yield emit()
        if any(len(k) for k, _ in parts):
            yield emit()

    def merge(group: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = [pa.array([group["shard"][0]], pa.int32())]
        for side in ("after", "before"):
            keys = np.concatenate([np.cumsum(_unpack(x, "i8")) for x in group[side]])
            counts = np.concatenate([_unpack(x, "i4").astype(np.int64) for x in group[f"{side}_n"]])
            keys, counts = _summed(keys, counts)
            out += [pa.array([_pack(np.diff(keys, prepend=0))], pa.binary()), pa.array([_pack(counts)], pa.binary())]
        return pa.RecordBatch.from_arrays(out, names=names)

    names = ["shard", "after", "after_n", "before", "before_n"]
    schema = "shard int, after binary, after_n binary, before binary, before_n binary"
    return map_groups(encoded.select("ids", "blobs").mapInArrow(run, schema), ["shard"], merge, schema)


def _bigrams(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.cumsum(_unpack(keys, "i8"))
    return k >> 32, k & 0xFFFFFFFF, _unpack(counts, "i8")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Of class bigrams, up to what doesn't depend on the classes."""
    t = table.astype(float)
    return float(_xlogx(t).sum() - _xlogx(t.sum(0)).sum() - _xlogx(t.sum(1)).sum())


def add_gains(gains: np.ndarray, row: np.ndarray, seen: np.ndarray, n: np.ndarray, now: np.ndarray, table: np.ndarray) -> None:
    """Adds to ``gains`` (movers, classes) what one side of the movers' bigrams gains if they join each class.

    row, seen, n: a mover's bigrams with a class on the other side, added up and sorted by row. now: each mover's class. table[own class,
    other class]: class bigrams now, with the mover still in its class, from which it is taken out first."""
    free = gains.shape[1]
    there = table[:free].T.astype(float)  # by the class on the other side
    plain = _xlogx(there)
    small = np.arange(_SMALL)[:, None, None]
    known = _xlogx(there + small) - plain  # what small counts gain, by count, class on the other side and class
    for at in range(0, len(row), 50_000):
        r, c, s = row[at : at + 50_000], seen[at : at + 50_000], n[at : at + 50_000]
        gain = known[np.minimum(s, _SMALL - 1), c]
        large = np.flatnonzero(s >= _SMALL)
        gain[large] = _xlogx(there[c[large]] + s[large, None]) - plain[c[large]]
        own = there[c, now[r]]
        gain[np.arange(len(r)), now[r]] = _xlogx(own) - _xlogx(np.maximum(own - s, 0))
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        gains[r[first]] += np.add.reduceat(gain, first, axis=0)
    total = np.bincount(row, weights=n, minlength=len(gains))[:, None]
    mass = np.broadcast_to(table[:free].sum(1).astype(float), gains.shape).copy()
    mass[np.arange(len(gains)), now] -= total[:, 0]
    np.maximum(mass, 0, out=mass)
    gains -= _xlogx(mass + total) - _xlogx(mass)


def best_classes(after: tuple, before_: tuple, now: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class that each mover gains most by, the one it has on ties. after, before_: (row, class on the other side, n)."""
    k, gains = table.shape[0], np.zeros((len(now), table.shape[0] - 1))
    for (row, seen, n), t in ((after, table), (before_, table.T)):
        key, total = _summed(row * k + seen, n)
        add_gains(gains, key // k, key % k, total, now, t)
    stay = gains[np.arange(len(now)), now]
    return np.where(gains.max(1) > stay + 1e-9, gains.argmax(1), now)


def class_table(bigrams: DataFrame, classes: np.ndarray, k: int, core: int | None = None) -> np.ndarray:
    """Bigrams of classes, (k, k); what reaches the driver is k * k numbers. core: only those without spelling groups."""
    held = bigrams.sparkSession.sparkContext.broadcast(classes)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            total = np.zeros(k * k, np.int64)
            for row in batch.to_pylist():
                a, b, n = _bigrams(row["after"], row["after_n"])
                if core is not None:
                    keep = ((a < core) | (a == len(held.value) - 1)) & ((b < core) | (b == len(held.value) - 1))
                    a, b, n = a[keep], b[keep], n[keep]
                total += np.bincount(held.value[a].astype(np.int64) * k + held.value[b], weights=n, minlength=k * k).astype(np.int64)
            cells = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

        return one

    rows = map_batches(bigrams.select("after", "after_n"), make, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k, np.int64)
    out[rows["cell"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return out.reshape(k, k)


def cluster(bigrams: DataFrame, core: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's class, and the class bigrams. The end has the last class to itself."""
    k, units = settings.classes + 1, len(core) + SPELLINGS + 1
    classes = np.empty(units, np.uint8)
    classes[: len(core)] = [spelling(w) % settings.classes for w in core]
    classes[len(core) : -1] = np.arange(SPELLINGS) % settings.classes
    classes[-1] = settings.classes
    spark = bigrams.sparkSession
    table, parts, still = class_table(bigrams, classes, k), 2, 0
    for r in range(settings.rounds):
        if still == parts:  # no unit of any share gains by a move
            break
        held, now = spark.sparkContext.broadcast(classes), table

        def make(held=held, now=now, turn=r % parts, parts=parts):
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows, classes = [], held.value.astype(np.int64)
                for row in batch.to_pylist():
                    sides = [_bigrams(row["after"], row["after_n"]), _bigrams(row["before"], row["before_n"])]
                    mine = np.union1d(sides[0][0], sides[1][0])
                    mine = mine[((mine * 2654435761 >> 16) % parts == turn) & (mine != len(classes) - 1)]
                    if not len(mine):
                        continue
                    place = np.full(len(classes), -1, np.int64)
                    place[mine] = np.arange(len(mine))
                    own = [(place[u][pick], classes[o][pick], n[pick]) for u, o, n in sides for pick in (place[u] >= 0,)]
                    rows.append((_pack(mine.astype(np.int32)), _pack(best_classes(*own, classes[mine], now).astype(np.uint8))))
                return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.binary()) for i in (0, 1)], names=["unit", "class"])

            return one

        moved = classes.copy()  # five bytes a unit reach the driver
        for row in map_batches(bigrams.select("after", "after_n", "before", "before_n"), make, "unit binary, class binary").collect():
            moved[_unpack(row["unit"], "i4")] = _unpack(row["class"], "u1")
        if (moved == classes).all():
            still += 1
            continue
        still = 0
        after = class_table(bigrams, moved, k)
        if likelihood(after) < likelihood(table):
            parts *= 2
        else:
            classes, table = moved, after
    return classes, table


def neighbours(encoded: DataFrame, units, classes: np.ndarray) -> DataFrame:
    """(word, slots) of the words outside the core: a byte for the class before each training occurrence, and one for the class after it.

    Bytes: the class before; k + the class after; 2k + the class after if that is a spelling group's."""
    held, k = encoded.sparkSession.sparkContext.broadcast(classes), int(classes[-1]) + 1

    def make():
        def one(batch: pa.RecordBatch):
            out = []
            for i in range(batch.num_rows):
                chunk = Chunk.of(batch.slice(i, 1).to_pylist()[0])
                if not len(chunk.spellings):
                    continue
                tokens, text = chunk.tokens(units.value.count)
                own = held.value[chunk.units(tokens, units.value)]
                at = np.flatnonzero((tokens < 0) & chunk.training[text])
                if not len(at):
                    continue
                local = -1 - tokens[at]
                order = np.argsort(local, kind="stable")
                at, local = at[order], local[order]
                previous = own[np.where(at > 0, at - 1, 0)].astype(np.int64)
                previous[at == 0] = k - 1
                slots = np.stack([previous, own[at + 1] + np.where(tokens[at + 1] < 0, 2 * k, k)], 1).astype(np.uint8)
                first = np.flatnonzero(np.append(True, local[1:] != local[:-1]))
                offsets = np.append(first, len(local)).astype(np.int32) * 2
                words = chunk.words.split(END)
                blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(slots))])
                out.append(pa.RecordBatch.from_arrays([pa.array([words[j] for j in local[first].tolist()], pa.binary()), blobs], names=["word", "slots"]))
            return out

        return one

    def run(batches):
        one = make()
        for batch in batches:
            yield from one(batch)

    return encoded.select("ids", "blobs").mapInArrow(run, "word binary, slots binary")


def place_words(found: DataFrame, classes: np.ndarray, core: int, table: np.ndarray) -> DataFrame:
    """found: (word, slots). Rows (word, c, cls) of every word, and rows (cell, n) of what the words add to the final class bigrams."""
    k = len(table)
    held = found.sparkSession.sparkContext.broadcast((classes, table))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            classes, table = held.value
            words = batch.column(0).to_pylist()
            data = [b"".join(x) for x in batch.column(1).to_pylist()]
            slot = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
            count = np.array([len(x) for x in data]) // 2
            row = np.repeat(np.arange(len(words)), 2 * count)
            now = classes[core + np.array([spelling(w) for w in words])].astype(np.int64)
            first, ones = slot < k, np.ones(len(slot), np.int64)
            cls = best_classes((row[~first], slot[~first] % k, ones[~first]), (row[first], slot[first], ones[first]), now, table)
            into = (slot >= k) & (slot < 2 * k)  # a word outside the core after this one adds the bigram itself
            cells = np.bincount(np.concatenate([slot[first] * k + cls[row[first]], cls[row[into]] * k + slot[into] - k]), minlength=k * k)
            cell = np.flatnonzero(cells)
            none = lambda t: pa.nulls(len(cell), t)
            columns = [[pa.array(words, pa.binary()), pa.array(count.astype(np.int64)), pa.array(cls.astype(np.int32)), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.int64())], [none(pa.binary()), none(pa.int64()), none(pa.int32()), pa.array(cell.astype(np.int32)), pa.array(cells[cell])]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*columns)], names=["word", "c", "cls", "cell", "n"])

        return one

    return map_batches(found.groupBy("word").agg(F.collect_list("slots").alias("slots")), make, "word binary, c long, cls int, cell int, n long")


@dataclass
class Model:
    """Of training: tokens, types; counts and classes of units; class transitions, class sizes and unknown shares."""

    tokens: int
    types: int
    units: Units
    counts: np.ndarray
    classes: np.ndarray
    moves: np.ndarray
    sizes: np.ndarray
    unknown: np.ndarray
    mix: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def probability(self, c: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        share = np.where(c > 0, (1 - self.unknown[own]) * c / self.sizes[own], self.unknown[own])
        return self.mix * self.moves[before, own] * share + (1 - self.mix) * self.base(c)


def train(docs: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame, DataFrame]:
    """docs: doc_id, text (bytes), training. Returns the model, the table (word, c, cls) of all words outside the core, and all texts' chunks."""
    spark = docs.sparkSession
    vocabulary = written(count_words(docs.where("training")), "vocabulary")
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = vocabulary.where(F.col("c") >= max(1.0, settings.core_share * tokens)).toArrow()
    found = sorted(zip(rows["word"].to_pylist(), rows["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    words, counts = [w for w, _ in found if w != END], [c for w, c in found if w != END]
    ends = vocabulary.where(F.col("word") == F.lit(bytearray(END))).select("c").first()
    units = Units(words)
    held = spark.sparkContext.broadcast(units)
    encoded = written(chunks(docs, held), "chunks")
    bigrams = written(count_bigrams(encoded, held, max(1, -(-tokens // SHARD_TOKENS))), "bigrams")
    classes, table = cluster(bigrams, words, settings)
    k = settings.classes + 1
    placed = written(place_words(neighbours(encoded, held, classes), classes, len(words), table), "placed")
    table = class_table(bigrams, classes, k, len(words)) + 0
    for r in placed.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[divmod(r["cell"], k)] += r["n"]
    others = placed.where("word is not null").select("word", "c", "cls")
    sizes, once = np.zeros(k), np.zeros(k)
    own = classes.astype(np.int64)
    full = np.array([*counts, *[0] * SPELLINGS, ends["c"] if ends else 0], np.int64)
    np.add.at(sizes, own, full)
    np.add.at(once, own[: len(words)], full[: len(words)] == 1)
    for r in others.groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect():
        sizes[r["cls"]] += r["c"]
        once[r["cls"]] += r["once"]
    unknown = np.minimum((once + 0.01) / (sizes + 0.02), 0.5)
    moves = (table + 0.01) / (table.sum(1, keepdims=True) + 0.01 * k)
    return Model(tokens, types, units, full, own, moves, np.maximum(sizes, 1.0), unknown, settings.mix if tokens else 0.0), others, encoded


def score(encoded: DataFrame, model: Model, others: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row for each text of the chunks."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                number, words = batch.column(0)[i].as_py(), zstandard.ZstdDecompressor().decompress(batch.column(1)[i].as_py()[4]).split(END)
                for at in range(0, len(words) if words != [b""] else 0, 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(part)), pa.array(part, pa.binary()), pa.array(range(at, at + len(part)), pa.int32())], names=["chunk", "word", "local"])

    own_words = encoded.select("chunk", "blobs").mapInArrow(run, "chunk long, word binary, local int")
    known = own_words.join(others, "word").select("chunk", "local", "c", "cls")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        m, chunk = held.value, Chunk.of(left.to_pylist()[0])
        end, n = m.units.end, len(chunk.spellings)
        count, cls = np.append(m.counts, np.zeros(n, np.int64)), np.append(m.classes, m.classes[m.units.core + chunk.spellings.astype(np.int64)])
        local = right["local"].to_numpy() + end + 1
        count[local], cls[local] = right["c"].to_numpy(), right["cls"].to_numpy()
        tokens, text = chunk.tokens(m.units.count)
        tokens = np.where(tokens < 0, end - tokens, tokens)  # the chunk's own words behind all units
        c, texts = count[tokens], len(chunk.lengths)
        known = np.bincount(text[c > 0], minlength=texts)
        base = np.bincount(text, np.log10(m.base(c)), texts)
        full = np.bincount(text, np.log10(m.probability(c, cls[before(tokens, end)], cls[tokens])), texts)
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.lengths.astype(np.int64) + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(full)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    heads = encoded.withColumnRenamed("chunk", "number")
    return heads.groupBy("number").cogroup(known.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, training: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows where ``training`` holds.

    Lower-cases A-Z; words are split at ASCII white space; each text ends with one end token. A null text is empty: its end alone. With nothing to learn from,
    both scores are the base's. Repeated rows count and are scored once each. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    model, others, encoded = train(rows, settings)
    return score(encoded, model, others).select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

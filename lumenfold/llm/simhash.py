"""SimHash fingerprints, and near-duplicate links among them by pigeonring filtering.

A 64-bit fingerprint is cut into four segments on a ring. If two fingerprints differ in at most 3 bits, then some
segment starts a chain whose first 1, 2, 3 and 4 segments together differ in at most 0, 1, 2 and 3 bits (3/4 bit a
segment, in whole bits). Candidates therefore share a whole segment and one half of the next (of two halves with one differing
bit at most, one is equal): 24 bits. A candidate must keep the chain's budgets before all 64 bits are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import LOWER, map_batches, text_bytes, written
from lumenfold.llm.components import block_pairs, connected_components, forest, hot_keys, join_facts, map_groups

SEED, SHINGLE, DISTANCE = 42, 3, 3
SEGMENTS, SEGMENT_BITS = 4, 16
#: Fingerprints of one block of a candidate group.
BLOCK = 512


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    """Bit by bit, whether over half of the shingles' hashes have it; 0 without words."""
    n = len(words)
    if not n:
        return 0
    k = min(size, n)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    counts = np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(bits)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits in a signed long. Null and blank texts have 0. Ids of any type."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = []
            for at in range(0, batch.num_rows, 256):
                fps += [fingerprint((t or b"").translate(LOWER).split()) for t in batch.column(1).slice(at, 256).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

        return one

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col)), make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _segment(i: int):
    return F.shiftrightunsigned("fp", 64 - SEGMENT_BITS * (i % SEGMENTS + 1)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of a (distinct) column fp within DISTANCE bits, directly or by others.

    A candidate group gives at most as many edges as it has members, never all its pairs."""
    keys = []
    for start in range(SEGMENTS):
        following = _segment(start + 1)
        for half, bits in enumerate((F.shiftrightunsigned(following, 8), following.bitwiseAND(F.lit(255)))):
            keys.append(F.lit((start * 2 + half) << 24) + F.shiftleft(_segment(start), 8) + bits)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pairs = block_pairs(written(rows.join(shared, "key"), "candidates"), ["key"], block, F.col("fp"))

    def one(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        start = int(group["key"][0]) >> 25
        fp = np.unique(group["fp"]).astype(np.int64).view(np.uint64)
        differ = fp[:, None] ^ fp[None, :]
        part = lambda i: np.bitwise_count((differ >> np.uint64(64 - SEGMENT_BITS * (i % SEGMENTS + 1))) & np.uint64(0xFFFF)).astype(np.int16)
        spent, near = np.zeros(differ.shape, np.int16), np.ones(differ.shape, bool)
        for length in range(1, SEGMENTS + 1):
            spent += part(start + length - 1)
            near &= spent <= DISTANCE * length // SEGMENTS
        label = forest(len(fp), near)
        away = np.flatnonzero(label != np.arange(len(fp)))
        if not len(away):
            return None
        return pa.RecordBatch.from_arrays([pa.array(fp[away].view(np.int64)), pa.array(fp[label[away]].view(np.int64))], names=["a", "b"])

    return map_groups(pairs.select("key", "block_a", "block_b", "fp"), ["key", "block_a", "block_b"], one, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, the document itself included.

    Equal fingerprints are one class, so copies add no pairs. A null id is carried along and is never a component's smallest
    unless all are null; repeated rows are repeated; an empty table gives no rows; other columns are not read."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    reached = written(classes.join(connected_components(links(classes.select("fp"))), F.col("fp") == F.col("id"), "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component")), "classes")
    smallest = reached.groupBy("component").agg(F.min("first").alias("component_id"))
    # One fingerprint may be that of a large part of all rows (blank texts, copies).
    answers = written(reached.join(smallest, "component").select(hex16().alias("key"), "n", "component_id"), "answers")
    return join_facts(marked.withColumn("key", hex16()), hot_keys(answers).drop("n"), "key").select("doc_id", "fp", "component_id")


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")

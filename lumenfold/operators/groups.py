"""Building blocks for pair work: written intermediate tables, groups one at a time, block pairs, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local is a temporary folder used."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder, read again.

    A lost executor costs nothing then, and an expensive frame that is used twice is made once."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of Arrow batches that gives its memory back when its task ends: workers stay for the next one, beside those of other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return task


#: Edges that a task contracts by itself.
TASK_EDGES = 1 << 18


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (a, b): each end that isn't the smallest of its component, and that smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(left):
        x, y = label[left], label[right]
        open_ = x != y
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (jumped := label[label])).any():
            label = jumped
    away = np.flatnonzero(label != np.arange(len(ids)))
    return ids[away], ids[label[away]]


def _contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """The edges of each of so many tasks as stars: what they connect stays connected, with fewer edges and smaller ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        types = None

        def stars() -> tuple[np.ndarray, np.ndarray]:
            return contracted(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            types = [c.type for c in batch.columns]
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(x) for x, _ in held) > 2 * TASK_EDGES:
                held[:] = [stars()]
                if len(held[0][0]) > TASK_EDGES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held.pop(), types)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(stars(), types)], names=["a", "b"])

    return edges.coalesce(tasks).mapInArrow(lean(run), edges.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge of (a, b) reaches.

    Tasks contract their own edges first, as many tasks as the edges fill. If that is one, they are the answer. If not, large-star and
    small-star rounds follow, each a map-side combined minimum and an equi-join, until nothing changes; they end for every graph. Each round writes its
    edges to the shared folder. Nothing is collected but a count and a checksum. Self-loops and repeated edges are fine; an edge with a null end is none."""
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = sign(now)
    while seen[0]:
        tasks = -(-seen[0] // TASK_EDGES)
        local = written(_contracted(now, tasks), "edges")
        if tasks == 1:
            now = local
            break
        both = local.unionByName(local.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(b.alias("a"), F.col("m").alias("b")).where(a != b).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(small, "edges")
        if (sign_now := sign(now)) == seen:
            break
        seen = sign_now
    return now.select(a.alias("id"), b.alias("component")).unionByName(now.select(b.alias("id"), b.alias("component")).distinct())


#: Keys that hold more than one in so many rows are hot: no table has more hot keys than that, so a list of them is small.
HOT_SHARE = 2000


def hot_keys(counts: DataFrame, n: str = "n", least: int = 1000) -> DataFrame:
    """Marks the rows of a table (key, n), a row a key: ``hot`` where n is more than ``least`` and than one in HOT_SHARE of the sum."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.withColumn("hot", F.col(n) > max(least, total / HOT_SHARE))


def join_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of string keys with facts (a row a key, with ``hot`` as of hot_keys).

    Hot keys' facts are broadcast (at most HOT_SHARE rows) and their rows stay where they are; only the others are dealt by key."""
    own = [c for c in facts.columns if c not in (key, "hot")]
    few = facts.where("hot").select(F.col(key).alias("_few"), F.struct(*own).alias("_hot"))
    many = facts.where("not hot").select(F.col(key).alias("_many"), F.struct(*own).alias("_cold"))
    near = rows.join(F.broadcast(few), F.col(key) == F.col("_few"), "left")
    # A hot key's rows meet no other fact: they are dealt by themselves.
    spread = F.when(F.col("_few").isNull(), F.col(key)).otherwise(F.concat_ws(" ", key, F.xxhash64(*rows.columns, F.spark_partition_id()).cast("string")))
    both = near.withColumn("_spread", spread).join(many, F.col("_spread") == F.col("_many"), "left")
    return both.select(*rows.columns, *(F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in own))


def block_pairs(rows: DataFrame, group: list[str], size: int, order: Column, blocks: DataFrame | None = None) -> DataFrame:
    """Gives each row to the pairs of blocks of its group that it takes part in: columns block_a <= block_b, in_a, in_b.

    A group of n rows is cut into ceil(n / size) blocks by a hash of ``order``; a pair of blocks is one small task's work,
    so that a group of any size is spread over many tasks. A row goes to as many pairs as its group has blocks."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    cut = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(order), F.col("_blocks")).cast("int"))
    spread = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return spread.select(*rows.columns, F.least("_own", "_other").alias("block_a"), F.greatest("_own", "_other").alias("block_b"), F.col("_own").alias("block"))


def forest(n: int, adjacent: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes of a symmetric boolean matrix with a true diagonal."""
    label = np.arange(n)
    while True:
        new = np.where(adjacent, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each group of ``keys`` in turn, of batches that are sorted by them, as NumPy arrays (objects for strings, bytes and lists)."""
    kept: list[dict[str, np.ndarray]] = []

    def done() -> Iterator[dict[str, np.ndarray]]:
        if kept:
            yield {n: np.concatenate([k[n] for k in kept]) for n in names}
        kept.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        if kept and any(kept[-1][k][-1] != columns[k][0] for k in keys):
            yield from done()
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if i:
                yield from done()
            kept.append({n: v[a:b] for n, v in columns.items()})
    yield from done()


def map_groups(df: DataFrame, keys: list[str], one: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Calls ``one`` with the columns of each group of ``keys`` in turn, as of in_groups.

    Rows are dealt by the keys and sorted; a task holds one group and one batch at a time, so groups must be small by construction."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, keys, names):
            if (out := one(group)) is not None:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), schema)


#: Buckets that hashes are dealt to (as a power of two), and values that a task holds before it deals them.
BUCKET_BITS, DEALT = 12, 1 << 20

Columns = tuple[np.ndarray, ...]


def gathered(pieces: Iterator[Columns], least: int | None = None) -> Iterator[Columns]:
    """Pieces of equally long columns, joined to such of ``least`` values or more, and what is left."""
    held, total = [], 0
    for piece in pieces:
        held.append(piece)
        total += len(piece[0])
        if total >= (least or DEALT):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, total = [], 0
    if total:
        yield tuple(np.concatenate(x) for x in zip(*held))


def bucket_lists(rows: DataFrame, pieces: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], schema: dict[str, str]) -> DataFrame:
    """(bucket, lists of ``schema``): many small values that are to meet by a hash, as few rows: one a bucket and piece.

    ``pieces`` makes columns of a task's batches: a 64-bit hash, then those of ``schema`` (bigint or int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, *columns in pieces(batches):
            bucket = (hashes.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int16)
            order = np.argsort(bucket, kind="stable")
            bucket, at = np.unique(bucket[order], return_index=True)
            cuts = pa.array(np.append(at, len(order)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *(pa.ListArray.from_arrays(cuts, pa.array(c[order])) for c in columns)], names=["bucket", *schema])

    return rows.mapInArrow(lean(run), ", ".join(["bucket int", *(f"{n} array<{t}>" for n, t in schema.items())]))


def in_buckets(batches: Iterator[pa.RecordBatch], schema: dict[str, str]) -> Iterator[Columns]:
    """The values of each bucket in turn, of bucket_lists that are dealt and sorted by bucket."""
    for group in in_groups(batches, ["bucket"], ["bucket", *schema]):
        yield tuple(np.concatenate(list(group[n])) for n in schema)


def by_bucket(lists: DataFrame) -> DataFrame:
    return lists.repartition("bucket").sortWithinPartitions("bucket")

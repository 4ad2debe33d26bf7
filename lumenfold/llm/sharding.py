"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved.

A byte that stays in its shard costs nothing, one that moves costs 1. The flow between shards (a small graph, never the rows) is
solved on the driver; each old shard is then cut, in a fixed order of its rows, into consecutive runs of the lengths
that the flow gives, and a row goes where its middle byte lies. Only files of shards that gain or lose rows are written.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import shared_dir

#: Bytes besides the text that a row takes.
ROW_BYTES = 16
#: Rows are ordered inside blocks of about so many bytes, at most MAX_BLOCKS for a shard.
BLOCK_BYTES, MAX_BLOCKS = 4 << 20, 4096


def capacities(total: int, shards: int) -> list[int]:
    """Equal to within one byte."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def cheapest_flow(old: dict[int, int], new: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, fewest moved (i != j), by successive shortest augmenting paths.

    The new capacities must add up to the old sizes."""
    if sum(old.values()) != sum(new.values()):
        raise ValueError("capacities must add up to the sizes")
    source, sink = ("s",), ("t",)
    room: dict[tuple, dict[tuple, int]] = {source: {}, sink: {}}
    cost: dict[tuple[tuple, tuple], int] = {}

    def edge(u, v, capacity, price):
        room.setdefault(u, {})[v] = capacity
        room.setdefault(v, {}).setdefault(u, 0)
        cost[u, v], cost[v, u] = price, -price

    for i, size in old.items():
        edge(source, ("old", i), size, 0)
        for j in new:
            edge(("old", i), ("new", j), size, int(i != j))
    for j, capacity in new.items():
        edge(("new", j), sink, capacity, 0)
    while True:
        far, before, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for v, c in room[u].items():
                if c > 0 and far[u] + cost[u, v] < far.get(v, 1 << 60):
                    far[v], before[v] = far[u] + cost[u, v], u
                    if v not in queued:
                        queued.add(v)
                        queue.append(v)
        if sink not in before:
            break
        path, v = [], sink
        while v != source:
            path.append((before[v], v))
            v = before[v]
        amount = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= amount
            room[v][u] += amount
    return {(i, j): room["new", j]["old", i] for i in old for j in new if room["new", j]["old", i] > 0}


def cuts(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end, new shard): what stays comes first, then the moves in order of the new shard."""
    out, at = [], {}
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        out.append((i, at.get(i, 0), at.get(i, 0) + amount, j))
        at[i] = at.get(i, 0) + amount
    return out


def reshard(docs: DataFrame, shards: int, old_col: str = "old_shard", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """The rows with their new ``shard`` and ``slot`` (gapless from 0), reread from the rewritten files; and the cuts.

    docs: with the old shard (a non-null int, few values) of each row. Null texts have no bytes but ROW_BYTES. Repeated rows are rows of their
    own; a null id sorts first. An empty table gives no rows. The result has doc_id, text, shard, slot."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(old_col).cast("int").alias("old"), size.alias("size"))
    sizes = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    segments = cuts(cheapest_flow(sizes, dict(enumerate(capacities(sum(sizes.values()), shards)))))
    if not sizes:
        return rows.select("doc_id", "text", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")), []

    counts = {i: min(MAX_BLOCKS, -(-n // block_bytes)) for i, n in sizes.items()}
    of = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    block = F.pmod(F.xxhash64("doc_id", "size"), of[F.col("old")]).cast("int")
    rows = rows.withColumn("block", block)
    totals = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values(["old", "block"])
    totals["bytes0"] = totals.groupby("old")["bytes"].cumsum() - totals["bytes"]
    totals["rows0"] = totals.groupby("old")["rows"].cumsum() - totals["rows"]
    begins = spark.createDataFrame(totals[["old", "block", "bytes0", "rows0"]].astype(np.int64), "old int, block int, bytes0 long, rows0 long")

    order = Window.partitionBy("old", "block").orderBy("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.select("*", before.alias("_bytes"), (F.row_number().over(order) - 1).alias("_rows"))
    # At most shards x MAX_BLOCKS begins and old + new cuts: bounded, so both are broadcast.
    placed = placed.join(F.broadcast(begins), ["old", "block"]).withColumns({"at": F.col("_bytes") + F.col("bytes0") + F.shiftright("size", 1), "place": (F.col("_rows") + F.col("rows0")).cast("long")})
    runs = spark.createDataFrame(segments, "old int, low long, high long, shard int")
    placed = placed.join(F.broadcast(runs), "old").where("at >= low and at < high").select("doc_id", "text", "old", "place", "shard")

    moved = {i for i, _, _, j in segments if i != j} | {j for i, _, _, j in segments if i != j}
    path = shared_dir(spark, "shards")
    placed.where(F.col("shard").isin(*moved) if moved else F.lit(False)).write.partitionBy("shard").parquet(path)
    files = spark.read.schema("doc_id long, text string, old int, place long, shard int").parquet(path)
    now = files if moved else placed
    if moved and len(moved | set(sizes)) > len(moved):
        now = files.unionByName(placed.where(~F.col("shard").isin(*moved)))
    parts = now.groupBy("shard", "old").agg(F.min("place").alias("first"), F.count("*").alias("n")).toPandas().sort_values(["shard", "old"])
    parts["base"] = parts.groupby("shard")["n"].cumsum() - parts["n"] - parts["first"]
    bases = spark.createDataFrame(parts[["shard", "old", "base"]].astype(np.int64), "shard int, old int, base long")
    return now.join(F.broadcast(bases), ["shard", "old"]).select("doc_id", "text", "shard", (F.col("place") + F.col("base")).alias("slot")), segments

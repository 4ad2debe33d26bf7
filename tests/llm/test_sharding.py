import struct
import zlib
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm.helpers import documents, frame

from lumenfold.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=4), st.integers(1, 4))
def test_flow_moves_the_fewest_bytes(sizes, shards):
    old = dict(enumerate(sizes))
    new = dict(enumerate(sharding.capacities(sum(sizes), shards)))
    flow = sharding.cheapest_flow(old, new)
    for i in old:
        assert sum(a for (x, _), a in flow.items() if x == i) == old[i]
    for j in new:
        assert sum(a for (_, y), a in flow.items() if y == j) == new[j]
    moved = sum(a for (i, j), a in flow.items() if i != j)
    stays = sum(min(old[k], new[k]) for k in set(old) & set(new))
    assert moved == sum(sizes) - stays


def test_capacities_must_fit():
    with pytest.raises(ValueError):
        sharding.cheapest_flow({0: 3}, {0: 2})


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_rows_are_whole_and_slots_gapless(spark, block):
    docs = documents(n=200)
    df = frame(spark, docs).withColumn("old_shard", (F.col("doc_id") % 3).cast("int"))
    rows, cuts = sharding.reshard(df, 5, block_bytes=block)
    got = rows.collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((d[0], d[1] or "") for d in docs)
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += len((r["text"] or "").encode()) + 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((d[1] or "").encode()) + 16 for d in docs)
    assert max(size.values()) - sum(size.values()) / 5 <= 4 * largest


def test_unaffected_shards_stay_and_empty_tables(spark):
    same = [(i, "abcd", None, None, 4) for i in range(20)]
    rows, cuts = sharding.reshard(frame(spark, same).withColumn("old_shard", (F.col("doc_id") % 2).cast("int")), 2)
    assert all(i == j for i, _, _, j in cuts) and {(r["doc_id"] % 2, r["shard"]) for r in rows.collect()} == {(0, 0), (1, 1)}
    rows, cuts = sharding.reshard(frame(spark, []).withColumn("old_shard", F.lit(0)), 4)
    assert rows.collect() == [] and cuts == [] and zlib.crc32(b"") == 0


def plain(docs, shards, block_bytes):
    """(doc_id, text, shard, slot) row by row: rows of an old shard in order of block, id, size and checksum; each goes where its middle byte lies."""
    size = lambda t: len((t or "").encode()) + sharding.ROW_BYTES
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[0] % 3] += size(d[1])
    runs = sharding.cuts(sharding.cheapest_flow(dict(sizes), dict(enumerate(sharding.capacities(sum(sizes.values()), shards)))))
    counts = {i: min(sharding.MAX_BLOCKS, -(-n // block_bytes)) for i, n in sizes.items()}

    def block(d):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", d[0]), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", size(d[1])), seed)
        return (h - (h >> 63 << 64)) % counts[d[0] % 3]

    at, placed = defaultdict(int), defaultdict(list)
    for d in sorted(docs, key=lambda d: (d[0] % 3, block(d), d[0], size(d[1]), zlib.crc32((d[1] or "").encode()))):
        old, n = d[0] % 3, size(d[1])
        middle = at[old] + n // 2
        at[old] += n
        placed[next(j for i, low, high, j in runs if i == old and low <= middle < high)].append((old, d[0], d[1]))
    return sorted(((i, t, shard, slot) for shard, rows in placed.items() for slot, (_, i, t) in enumerate(sorted(rows, key=lambda r: r[0]))), key=repr)


@pytest.mark.parametrize(("block", "shards"), [(300, 5), (1 << 20, 3), (700, 2)])
def test_every_row_goes_where_a_plain_assignment_puts_it(spark, block, shards):
    docs = documents(seed=4, n=120)
    df = frame(spark, docs).withColumn("old_shard", (F.col("doc_id") % 3).cast("int"))
    rows, _ = sharding.reshard(df, shards, block_bytes=block)
    assert sorted(((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows.collect()), key=repr) == plain(docs, shards, block)

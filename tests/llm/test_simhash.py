import random

import numpy as np
import xxhash
from tests.llm.helpers import documents, frame

from lumenfold.llm import simhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute_fp(text):
    w = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def check(spark, docs):
    got = simhash.near_duplicates(frame(spark, docs)).select("doc_id", simhash.hex16().alias("f"), "component_id").collect()
    fps = [brute_fp(d[1]) for d in docs]
    roots = components(fps)
    smallest = {}
    for d, r in zip(docs, roots):
        smallest[r] = min(smallest.get(r, 1 << 60), d[0])
    assert sorted(tuple(r) for r in got) == sorted((d[0], format(f, "016x"), smallest[r]) for d, f, r in zip(docs, fps, roots))


def test_against_brute_force(spark):
    check(spark, documents(n=120))
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_fingerprints_that_many_rows_share(spark):
    """Blank texts and copies of one text, each more than a thousand rows, are dealt apart from the other fingerprints."""
    docs = documents(n=12)
    check(spark, docs + [(9000 + i, "" if i % 3 else None, "en", "s", 0) for i in range(1100)] + [(20000 + i, docs[0][1], "en", "s", 0) for i in range(1100)])


def test_native_hash_is_the_same(spark):
    text = "Ünï cöde"
    assert spark.sql(f"select xxhash64('{text}') h").first()["h"] == int.from_bytes(xxhash.xxh64_digest(text.encode(), 42), "big", signed=True)


def test_links_miss_nothing_in_dense_groups(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    from lumenfold.llm.components import connected_components

    for block in (512, 8):
        edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block)
        got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
        roots = components(fps)
        groups = {}
        for s, r in zip(signed, roots):
            groups.setdefault(r, []).append(s)
        for members in groups.values():
            assert {got.get(m, m) for m in members} == {min(members)}

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import warc

TRAP = "<p>WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nmore</p>"
PAGES = [(1, "http://a/", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", TRAP), (6, "u", TRAP), (7, "u", "é" * 5000), (9, "u", "x\r\n\r\ny"), (1, "http://a/", "same"), (None, "u", "lost")]


def want(at_least=0):
    first, out = {}, []
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    for p, _, h in PAGES:
        data = (h or "").encode()
        again = p is not None and first[h or ""] != p and len(data) >= at_least
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "z", 1) for p in PAGES], "page_id long, url string, html string, sha1 string, first int")
    for k, (files, least) in enumerate([(2000, 0), (2, 0), (2000, 5)]):
        path = f"{tmp_path}/{k}"
        warc.write_warc(df, path, at_least=least, records_per_file=files)
        got = warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want(least)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "u", "x" * n + str(i)) for i, n in enumerate([10] * 50 + [900] * 20 + [20_000] * 6 + [400_000] * 3)]
    path = f"{tmp_path}/b"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, records_per_file=16, file_bytes=64_000)
    sizes = spark.read.format("binaryFile").load(path).select("content").rdd.map(lambda r: len(gzip.decompress(bytes(r[0])))).collect()
    assert sum(s > 100_000 for s in sizes) == 3
    assert sorted(r["page_id"] for r in warc.read_warc(spark, path).collect()) == list(range(79))


def test_versions_and_broken_chains(spark, tmp_path):
    head = b"%s\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: 7\r\n\r\n\r\n\r\nabc\r\n\r\n"
    good = head % (b"WARC/1.0", 1) + head % (b"WARC/1.1", 2)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(good)
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    assert sorted(r["page_id"] for r in warc.read_warc(spark, f"{tmp_path}/w").collect()) == [1, 2]
    (tmp_path / "w" / "b.warc").write_bytes(good + b"junk" + good)
    (tmp_path / "w" / "c.warc").write_bytes(b"junk")
    with pytest.raises(Exception, match="breaks at"):
        warc.read_warc(spark, f"{tmp_path}/w").collect()
    got = warc.read_warc(spark, f"{tmp_path}/w", broken="mark").select(F.element_at(F.split("path", "/"), -1).alias("f"), "page_id", "record_type", "offset", "payload_bytes").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a.warc", 1, "response", 0, 3), ("a.warc", 2, "response", len(good) // 2, 3), ("b.warc", 1, "response", 0, 3), ("b.warc", 2, "response", len(good) // 2, 3), ("b.warc", None, "broken", len(good), len(good) + 4), ("c.warc", None, "broken", 0, 4)], key=repr)


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/e")
    assert warc.read_warc(spark, f"{tmp_path}/e").collect() == []


def test_magic_inside_a_payload_is_a_candidate_but_not_reached(spark, tmp_path):
    path = f"{tmp_path}/t"
    warc.write_warc(spark.createDataFrame([(5, "u", TRAP)], "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "t").glob("part-*.gz")))
    found = warc.candidates(data)
    assert [c[2] for c in found] == [5, 99]
    keep = warc.reachable(np.array([c[0] for c in found]), np.array([c[1] for c in found]))
    assert keep.tolist() == [True, False]


def test_pointer_jumping():
    offset = np.array([0, 10, 15, 20, 30, 45])
    assert warc.reachable(offset, np.array([10, 20, 30, 30, 99, 60])).tolist() == [True, True, False, True, True, False]
    assert warc.reachable(np.array([3]), np.array([9])).tolist() == [False]


def test_one_gzip_member_a_record(spark, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Length: 7\r\n\r\n\r\n\r\nabc\r\n\r\n"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.warc.gz").write_bytes(b"".join(gzip.compress(record % i) for i in range(3)) + b"\0" * 8)
    got = warc.read_warc(spark, f"{tmp_path}/m").select("page_id", "payload_bytes").collect()
    assert sorted(map(tuple, got)) == [(0, 3), (1, 3), (2, 3)]

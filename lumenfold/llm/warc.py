"""WARC archives by Spark's own writer, and a reader that trusts no magic string by itself.

Tasks look for every ``WARC/1.1`` in a file and emit it as a candidate with the offset where its record would end, its
successor. Pointer jumping from the file's first byte then keeps the candidates that the chain of successors reaches;
a magic string inside a payload is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches, written
from lumenfold.llm.components import hot_keys, join_facts, map_groups

MAGIC = b"WARC/1.1\r\n"
#: Versions that are read.
MAGICS = re.compile(rb"WARC/1\.[01]\r\n")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file.
RECORDS_PER_FILE = 2000
#: Bytes of the payloads of one archive file, unless it holds a single larger one.
FILE_BYTES = 128 << 20


def sha1_base32(column: Column) -> Column:
    """Each 5 hex digits of the SHA-1 are 4 base32 digits."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.sha1(column).substr(i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, s: F.lit(BASE32).substr(F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(digits, lambda v: F.concat(*(letter(v, s) for s in (15, 10, 5, 0)))), "")


def write_warc(pages: DataFrame, path: str, at_least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """One record a row, in gzip files of at most ``records_per_file`` records and ``file_bytes`` bytes of payload (a larger payload has a file to itself). Of rows with equal payloads of at least ``at_least`` bytes, those with the smallest id are responses, others revisit it.

    A null html is an empty payload, a null url leaves its header out. A row with a null id is a response without a record id, and
    nothing refers to it. Line ends in a url are percent-encoded. Repeated rows are repeated records of the same type. An empty table writes no records."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    payload = F.concat_ws(" ", F.sha1("html"), F.octet_length("html")).alias("key")
    firsts = rows.where(F.octet_length("html") >= at_least).select("page_id", payload).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # One payload (an empty page) may be that of a large part of all rows.
    joined = join_facts(rows.withColumn("key", payload), hot_keys(written(firsts, "payloads")).drop("n"), "key")

    again, crlf = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)), "\r\n"
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(crlf + crlf))
    block = F.when(again, http).otherwise(F.concat(http, "html"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.col(c).cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(crlf)), F.lit(""))
    safe_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", urn("page_id")), line("WARC-Refers-To", F.when(again, urn("first"))),
        line("WARC-Target-URI", safe_url), line("WARC-Date", F.lit("2000-01-01T00:00:00Z")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1_base32(F.col("html")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")), F.lit(crlf), block,
    )
    # Payloads of a size class are written together, so that a number of records bounds a file's bytes.
    steps, most = [], max(1, file_bytes // records_per_file)
    while not steps or steps[-1][1] is not None:
        steps.append((steps[-1][1] if steps else -1, most if most <= file_bytes else None))
        most *= 16
    bytes_ = F.octet_length("html")
    within = lambda low, high: (bytes_ > low) & (bytes_ <= high) if high is not None else bytes_ > low
    there = rows.agg(*(F.count_if(within(low, high)) for low, high in steps)).first()
    for k, (low, high) in enumerate(steps):
        if there[k] or not k:
            number = min(records_per_file, max(1, file_bytes // high)) if high is not None else 1
            part = joined.where(within(low, high)).select(record.alias("value"))
            part.write.mode("append").option("lineSep", crlf + crlf).option("compression", "gzip").option("maxRecordsPerFile", number).text(path)


def unzipped(content: bytes) -> bytes:
    """Plain bytes of a file: all members of a gzip file, one after the other; other files as they are.

    Zero padding after a member ends the file; a member that is cut short or followed by anything else is an error."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        if not member.eof:
            raise zlib.error("incomplete gzip member")
        content = member.unused_data if member.unused_data.strip(b"\0") else b""
    return b"".join(parts)


def _field(header: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"\r\n" + name + rb": ([^\r]*)", header)
    return m and m[1]


def candidates(data: bytes) -> list[tuple]:
    """(offset, successor, page id, type, refers to, payload bytes, payload digest) of every magic string that heads a whole record.

    The digest is taken of the payload itself, for a revisit from the header."""
    out = []
    for m in MAGICS.finditer(data):
        at = m.start()
        head = data.find(b"\r\n\r\n", at)
        header = data[at : head + 2]
        length = _field(header, b"Content-Length")
        if head >= 0 and length and length.isdigit():
            begin = head + 4
            end = begin + int(length)
            if data[end : end + 4] == b"\r\n\r\n":
                body = data.find(b"\r\n\r\n", begin, end)
                kind = (_field(header, b"WARC-Type") or b"").decode()
                ids = [int(m[1]) if (v := _field(header, n)) and (m := re.fullmatch(rb"<urn:x-page:(-?\d+)>", v)) else None for n in (b"WARC-Record-ID", b"WARC-Refers-To")]
                payload = data[body + 4 : end] if body >= 0 else b""
                size, digest = len(payload), None
                if kind == "revisit":
                    size = int(_field(b"\r\n" + data[begin:body] + b"\r\n", b"Content-Length") or 0)
                    digest = (_field(header, b"WARC-Payload-Digest") or b"").removeprefix(b"sha1:").decode()
                else:
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append((at, end + 4, ids[0], kind, ids[1], size, digest))
    return out


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which of the sorted offsets the chain from offset 0 visits, by pointer jumping: in each round jumps double."""
    n = len(offset)
    place = np.searchsorted(offset, successor)
    jump = np.where((place < n) & (offset[np.minimum(place, n - 1)] == successor), place, n)
    jump = np.append(jump, n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offset[0] == 0
    for _ in range(n.bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


#: Record types of no record: the file's end among the candidates, and the place where a chain stops.
END, BROKEN = "end", "broken"
FIELDS = "path string, offset long, successor long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """The records (FIELDS) of all archives below ``path``: WARC 1.0 and 1.1, plain or gzip of one member or many.

    A file whose chain breaks before its end fails the job; with ``broken="mark"`` its records up to there are followed by a row of the record
    type ``broken`` at the offset where the chain stops, and payload_bytes are the bytes that were not read. An empty file has no records."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for i in range(batch.num_rows):
                data = unzipped(batch.column(1)[i].as_py())
                # The file's end is a candidate as well: an unbroken chain reaches it.
                found = [*candidates(data), (len(data), -1, None, END, None, 0, None)]
                rows += [(batch.column(0)[i].as_py(), *c) for c in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names) if rows else None

        return one

    def chain(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        order = np.argsort(group["offset"], kind="stable")
        keep = order[reachable(group["offset"][order], group["successor"][order])]
        end = order[group["record_type"][order] == END][0]
        whole_file = len(keep) > 0 and keep[-1] == end
        if not whole_file:
            at = int(group["successor"][keep[-1]]) if len(keep) else 0
            if broken == "fail":
                raise ValueError(f"the chain of {group['path'][0]} breaks at {at} of {group['offset'][end]} bytes")
            group["record_type"][end], group["payload_bytes"][end] = BROKEN, group["offset"][end] - at
            group["offset"][end], group["successor"][end] = at, at
        keep = np.append(keep, end) if not whole_file else keep[:-1]
        whole = lambda v: [None if x is None or x != x else int(x) for x in v]
        columns = [group[n][keep] if not pa.types.is_int64(t) else whole(group[n][keep]) for n, t in zip(names, types)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names) if len(keep) else None

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    # Ids go through NumPy as strings where null, so that none is rounded.
    found = map_batches(files, make, FIELDS)
    text_ids = found.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return map_groups(text_ids, ["path"], chain, FIELDS)

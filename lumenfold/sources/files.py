"""Files as a source: directory scans, signatures, and text out of zipped office formats.

Spark lists and reads the files (``binaryFile``); signatures are native expressions; only the zipped formats
need a small Python helper per file, fed in Arrow batches. Formats without a parser here take a function from outside.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a scan skips, in lower case.
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store", "ehthumbs.db", "$recycle.bin")
# First bytes of files, in order, as hexadecimal digits.
SIGNATURES = (
    ("pdf", "25504446"), ("ole-cfb", "D0CF11E0A1B11AE1"), ("zip", "504B0304"), ("jpeg", "FFD8FF"), ("png", "89504E470D0A1A0A"),
    ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"),
)
# Media types by extension.
MEDIA_TYPES = {
    "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroEnabled.12", "xls": "application/vnd.ms-excel",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "ppt": "application/vnd.ms-powerpoint", "pbix": "application/octet-stream", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "jfif": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "heic": "image/heic", "heif": "image/heif", "avif": "image/avif", "svg": "image/svg+xml", "txt": "text/plain", "csv": "text/csv",
}
MAX_BYTES = 256 << 20
EXTRACTED = "extractor string, text string, metadata string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """A full snapshot of a folder: path, name, extension, size, modified; junk names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed.where(~F.lower("name").isin(*JUNK_NAMES)).withColumn("extension", extension("name"))


def extension(name: str) -> Column:
    found = F.regexp_extract(F.col(name), r"\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def signature(content: Column, ext: Column) -> Column:
    """The first signature that fits, else ``unknown/<extension>``; a zip stays ``zip`` here."""
    out = F.concat(F.lit("unknown/"), F.coalesce(ext, F.lit("unknown")))
    for name, digits in reversed(SIGNATURES):
        out = F.when(F.hex(F.substring(content, 1, len(digits) // 2)) == digits, name).otherwise(out)
    return out


def media_type(ext: Column, detected: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])[F.lower(ext)]
    other = F.lit(None).cast("string") if detected is None else F.when(~detected.startswith("unknown/"), detected)
    return F.coalesce(known, other, F.lit("application/octet-stream"))


def media_route(mime: Column, ext: Column) -> Column:
    """image, video, audio or document: by the media type, then by the extension."""
    by = lambda kind, names: mime.startswith(f"{kind}/") | F.lower(ext).isin(*names)
    return F.when(by("image", ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic")), "image").when(by("video", ("mp4", "mov", "avi", "mkv", "webm")), "video").when(by("audio", ("mp3", "wav", "m4a", "flac", "ogg")), "audio").otherwise("document")


def plain_xml(xml: str) -> str:
    text = re.sub(r"<[^>]+>", " ", xml)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(entity, char)
    return re.sub(r"\s+", " ", text).strip()


def zip_kind(names: list[str]) -> str:
    """Power BI first: it is a zip that may hold parts of others."""
    for kind, marks in (("pbix", ("DataModel", "Report/Layout")), ("docx", ("word/document.xml",)), ("xlsx", ("xl/workbook.xml",)), ("pptx", ("ppt/presentation.xml",))):
        if any(n.startswith(m) for n in names for m in marks):
            return kind
    return "unknown-zip"


def _core(z: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in z.namelist():
        return {}
    xml = z.read("docProps/core.xml").decode("utf-8", "replace")
    tags = {"title": "dc:title", "creator": "dc:creator", "lastModifiedBy": "cp:lastModifiedBy", "created": "dcterms:created", "modified": "dcterms:modified"}
    return {k: m[1] for k, tag in tags.items() if (m := re.search(rf"<{tag}[^>]*>([^<]*)</{tag}>", xml))}


def _docx(z: zipfile.ZipFile) -> tuple[str, dict]:
    return plain_xml(z.read("word/document.xml").decode("utf-8", "replace")), _core(z)


def _pptx(z: zipfile.ZipFile) -> tuple[str, dict]:
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return "\n".join(plain_xml(z.read(n).decode("utf-8", "replace")) for _, n in slides), _core(z) | {"slideCount": len(slides)}


def _xlsx(z: zipfile.ZipFile, most_rows: int = 20, most_cols: int = 20, most_cells: int = 200) -> tuple[str, dict]:
    names, shared = z.namelist(), []
    if "xl/sharedStrings.xml" in names:
        shared = [plain_xml(m) for m in re.findall(r"<si>(.*?)</si>", z.read("xl/sharedStrings.xml").decode("utf-8", "replace"), re.S)]
    titles = re.findall(r'<sheet [^>]*?name="([^"]*)"', z.read("xl/workbook.xml").decode("utf-8", "replace"))
    sheets = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    lines, facts = [], []
    for title, (_, name) in zip(titles, sheets):
        headers, cells, formulas, rows = [], [], 0, re.findall(r"<row[^>]*?>(.*?)</row>", z.read(name).decode("utf-8", "replace"), re.S)
        for i, row in enumerate(rows[:most_rows]):
            for attributes, body in re.findall(r"<c\b([^>]*?)(?:/>|>(.*?)</c>)", row, re.S):
                kind = (re.search(r'\bt="(\w+)"', attributes) or [None, None])[1]
                formulas += "<f" in body
                value = re.search(r"<(?:v|t)[^>]*>(.*?)</(?:v|t)>", body, re.S)
                if value:
                    text = shared[int(value[1])] if kind == "s" else plain_xml(value[1])
                    if i == 0 and len(headers) < most_cols:
                        headers.append(text.strip())
                    if "<f" not in body:
                        cells.append(text)
        lines.append(" ".join([title, *headers, *cells[:most_cells]]))
        facts.append({"name": title, "rowCount": len(rows), "headers": headers, "formulaCount": formulas})
    return "\n".join(lines), _core(z) | {"sheetCount": len(sheets), "worksheets": facts}


def _pbix(z: zipfile.ZipFile, most: int = 500) -> tuple[str, dict]:
    def text(name: str) -> str | None:
        if name not in z.namelist():
            return None
        data = z.read(name)
        return data[2:].decode("utf-16-le", "replace") if data[:2] == b"\xff\xfe" else data.decode("utf-8", "replace")

    strings, pages = [], None
    try:
        layout = json.loads(text("Report/Layout") or "null")
    except ValueError:
        layout = None
    todo = [layout]
    while todo and len(strings) < most:
        node = todo.pop()
        if isinstance(node, str) and 1 < len(node) < 200:
            strings.append(node)
        elif isinstance(node, list):
            todo += node[::-1]
        elif isinstance(node, dict):
            todo += list(node.values())[::-1]
    if isinstance(layout, dict) and isinstance(layout.get("sections"), list):
        pages = len(layout["sections"])
    return " ".join(strings), {"version": (text("Version") or "").strip() or None, "reportPageCount": pages, "containerEntryCount": len(z.namelist())}


ZIPPED: dict[str, Callable] = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "pbix": _pbix}


def extract_one(content: bytes | None, kind: str, others: dict[str, Callable]) -> tuple[str, str, str]:
    """Never raises: what can't be read is ``unsupported`` with empty text."""
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                inner = zip_kind(z.namelist())
                if inner in ZIPPED:
                    text, facts = ZIPPED[inner](z)
                    return inner, text, json.dumps(facts, sort_keys=True)
        elif kind in others:
            text, facts = others[kind](content)
            return kind, text, json.dumps(facts, sort_keys=True)
        elif kind in ("unknown/txt", "unknown/csv", "unknown/md"):
            return kind[8:], content.decode("utf-8", "replace"), "{}"
    except Exception as error:  # a broken file is a row, not a failure
        return "unsupported", "", json.dumps({"error": type(error).__name__})
    return "unsupported", "", "{}"


def extract(files: DataFrame, others: dict[str, Callable] | None = None, most_bytes: int = MAX_BYTES) -> DataFrame:
    """files: path, content, extension, size. Adds the sniffed kind, extractor, text and metadata (JSON); files over the size limit
    are rows with the extractor ``skipped``. others: parsers by kind for formats that need one from outside (pdf, ole-cfb)."""
    kind = signature(F.col("content"), F.col("extension"))
    marked = files.withColumn("kind", kind).withColumn("content", F.when(F.col("size") <= most_bytes, F.col("content")))
    own = [f for f in marked.schema if f.name != "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [("skipped", "", "{}") if c is None else extract_one(bytes(c), k, others or {}) for c, k in zip(batch["content"], batch["kind"])]
            yield batch.drop(columns="content").assign(extractor=[f[0] for f in found], text=[f[1].replace("\x00", "") for f in found], metadata=[f[2] for f in found])

    return marked.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), EXTRACTED]))

"""Readable file names, descriptions of files that nothing could read, and text decoded with the wrong code page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenfold.functions.text import byte_size

# Dates, times and lone numbers (years excepted) that a file's name may hold.
_DATES = (r"(?<!\w)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\w)", r"(?<!\w)\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\w)", r"(?<!\w)\d{8,}(?!\w)", r"(?<!\w)\d{1,2}[.:h]\d{2}(?:[.:]\d{2})?(?!\w)")
_LONE_NUMBER = r"(?<!\S)(?!(?:19|20)\d{2}(?!\S))\d+(?!\S)"
# What formats are called.
KINDS = {
    "zip": "ZIP archive", "rar": "RAR archive", "7z": "7-Zip archive", "tar": "TAR archive", "gz": "Compressed archive", "exe": "Windows program", "msi": "Windows installer", "dll": "Program library",
    "pdf": "PDF document", "doc": "Word document", "docx": "Word document", "xls": "Excel spreadsheet", "xlsx": "Excel spreadsheet", "ppt": "PowerPoint presentation", "pptx": "PowerPoint presentation",
    "txt": "Text file", "csv": "CSV data file", "json": "JSON data file", "xml": "XML file", "eml": "Email message", "msg": "Email message",
}
CAVEAT = " Nothing could read its contents, so this describes where the file sits rather than what it says."


def readable_name(filename: Column) -> Column:
    """The words of a file's name; null where none are left."""
    out = F.regexp_replace(F.coalesce(filename, F.lit("")), r"(?i)\.[a-z0-9]{1,8}$", "")
    for pattern in _DATES:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[_\-.]+", " "), _LONE_NUMBER, " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when((out != "") & ~out.rlike(r"^\d+$"), out)


def kind_of(extension: Column, route: Column) -> Column:
    ext = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"^\.", "")
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[ext]
    named = F.concat_ws(" ", F.when(ext != "", F.upper(ext)), F.when(route == "image", "image").when(route == "video", "video").when(route == "audio", "recording").when(ext != "", "file").otherwise("File"))
    return F.coalesce(known, named)


def situation(kind: Column, size: Column, filename: Column, where: Column, date: Column) -> tuple[Column, Column]:
    """(caption, description) from facts alone."""
    words = readable_name(filename)
    opening = F.concat_ws(", ", kind, byte_size(size), where)
    named = F.coalesce(F.concat(F.lit(' Its filename reads "'), words, F.lit('".')), F.lit(""))
    dated = F.coalesce(F.concat(F.lit(" Dated "), F.date_format(date, "yyyy-MM-dd"), F.lit(".")), F.lit(""))
    return F.concat_ws(": ", kind, words), F.concat(opening, F.lit("."), named, dated, F.lit(CAVEAT))


def embedding_input(caption: Column, description: Column, source: Column, kind: Column, filename: Column, subject: Column) -> Column:
    """What is embedded: a description from facts gives its kind only, so that such files don't all look alike."""
    body = F.when(source == "metadata", kind).otherwise(description)
    return F.concat_ws("\n", caption, body, F.concat(F.lit("Filename: "), readable_name(filename)), F.concat(F.lit("Filed under: "), subject))


# Characters that a UTF-8 lead byte and its next byte become when each is read as a character of its own (Latin-1 or CP1252).
_LEAD = "Â-ï"
_NEXT = "\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def looks_misread(text: Column) -> Column:
    """Two such pairs, or one in a text of at most 24 characters."""
    pairs = F.regexp_count(text, F.lit(f"[{_LEAD}](?=[{_NEXT}])"))
    return F.coalesce((pairs >= 2) | ((pairs == 1) & (F.length(text) <= 24)), F.lit(False))


@F.pandas_udf(StringType())
def _reread(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            data = b"".join(bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252") for c in text)
            return data.decode("utf-8")
        except (UnicodeError, TypeError):
            return None

    return texts.map(one)


def repaired(text: Column) -> Column:
    """The text as it was meant, if rereading its bytes as UTF-8 works and no longer looks misread; else the text."""
    again = F.when(looks_misread(text), _reread(text))
    return F.when(again.isNotNull() & ~looks_misread(again), again).otherwise(text)

"""Text quality, scripts, names, dates and mail as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the text-quality verdict.
MIN_TOKENS = 5
MIN_LETTER_RATIO = 0.35
MAX_SINGLE_CHAR_TOKEN_RATIO = 0.55
MIN_LATIN_VOWEL_RATIO = 0.12
MAX_REPLACEMENT_RATIO = 0.03
NO_TEXT_LAYER_BYTES_PER_CHAR = 20000
# Code points of the scripts, in order of preference on ties.
SCRIPTS = {
    "arabic": r"[\x{0600}-\x{06ff}\x{0750}-\x{077f}]",
    "hebrew": r"[\x{0590}-\x{05ff}]",
    "cjk": r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]",
    "cyrillic": r"[\x{0400}-\x{04ff}]",
    "latin": r"[A-Za-z\x{00c0}-\x{024f}]",
}
VOWELS = "[aeiouyàâäéèêëïîôöùûüœæAEIOUYÀÂÄÉÈÊËÏÎÔÖÙÛÜŒÆ]"
# What counts as white space when a text is trimmed.
SPACE = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters as a string.
SPACES = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Extensions of files that may hold pictures of text.
OCR_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp", "heic")
# Signs of mass mail, and titles that say nothing.
BULK_SENDER = r"(?i)(no-?reply|newsletter|notifications?|marketing|mailer|do-?not-?reply)@"
PROMO_SUBJECT = r"(?i)\b(unsubscribe|% off|sale ends|limited time offer|free shipping|flash sale|exclusive deal)\b"
JUNK_TITLE = r"(?i)^(untitled|document\d*|new microsoft word document|presentation\d*|book\d*|slide\d*|model|normal|template|copy of .*)$"
BOILERPLATE_TITLE_FILES = 5


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a class a text has: the length of what is left of it without the others."""
    others = f"[^{pattern[1:]}+" if pattern.startswith("[") else f"[^{pattern}]+"
    return F.length(F.regexp_replace(text, others, ""))


def dominant_script(text: Column, latin: Column | None = None) -> Column:
    """The script with the most characters, the first listed on ties; null without any. latin: Latin characters besides those in ``text``."""

    def most(c: Column) -> Column:
        top = F.greatest(*(c[name] for name in SCRIPTS))
        out = F.lit(None).cast("string")
        for name in reversed(SCRIPTS):
            out = F.when(c[name] == top, name).otherwise(out)
        return F.when(top > 0, out)

    counts = {name: count_of(text, pattern) for name, pattern in SCRIPTS.items()}
    if latin is not None:
        counts["latin"] = counts["latin"] + latin
    return let(F.struct(*(c.alias(name) for name, c in counts.items())), most)


def quality_stats(text: Column) -> Column:
    """A struct of the counts that the verdict needs.

    ASCII letters are counted in one pass, all other classes in what is left of the text without ASCII."""

    def stats(trimmed: Column) -> Column:
        parts = F.struct(F.regexp_replace(trimmed, "[^A-Za-z]+", "").alias("ascii"), F.regexp_replace(trimmed, r"[\x00-\x7f]+", "").alias("rest"))
        return let(parts, lambda p: counted(trimmed, p["ascii"], p["rest"]))

    def counted(trimmed: Column, ascii_letters: Column, rest: Column) -> Column:
        words = F.array_remove(F.split(trimmed, r"[^\p{L}\p{N}'’-]+"), "")
        plain = F.length(ascii_letters)
        return F.struct(
            F.length(trimmed).alias("chars"),
            (plain + count_of(rest, r"\p{L}")).alias("letters"),
            count_of(rest, "[�]").alias("replacements"),
            (plain - F.length(F.translate(ascii_letters, "aeiouyAEIOUY", "")) + count_of(rest, VOWELS)).alias("vowels"),
            F.size(words).alias("n_tokens"),
            F.size(F.filter(words, lambda x: F.length(x) == 1)).alias("single_char_tokens"),
            dominant_script(rest, plain).alias("script"),
        )

    return let(trim_all(F.coalesce(text, F.lit(""))), stats)


def quality_verdict(size_bytes: Column) -> Column:
    """Of columns named as in quality_stats: empty, no_text_layer, gibberish, too_short or ok, in the order of the checks."""
    chars, letters = F.col("chars"), F.col("letters")
    return (
        F.when(chars == 0, "empty")
        .when(size_bytes > chars.cast("long") * NO_TEXT_LAYER_BYTES_PER_CHAR, "no_text_layer")
        .when(F.col("replacements") / chars > MAX_REPLACEMENT_RATIO, "gibberish")
        .when(letters / chars < MIN_LETTER_RATIO, "gibberish")
        .when(F.col("n_tokens") < MIN_TOKENS, "too_short")
        .when(F.col("single_char_tokens") / F.col("n_tokens") > MAX_SINGLE_CHAR_TOKEN_RATIO, "gibberish")
        .when((F.col("script") == "latin") & (F.when(letters > 0, F.col("vowels") / letters).otherwise(0) < MIN_LATIN_VOWEL_RATIO), "gibberish")
        .otherwise("ok")
    )


def benefits_from_ocr(verdict: Column, extension: Column) -> Column:
    return (verdict != "ok") & F.lower(extension).isin(*OCR_EXTENSIONS)


def markup_to_text(markup: Column) -> Column:
    """Tags become spaces, five entities are decoded (``&amp;`` first), white space is collapsed."""
    out = F.regexp_replace(markup, "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, f"{SPACE}+", " "))


def without_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


# Marks of a version in a file's name; neither letter nor digit may stand next to them.
_BEFORE, _AFTER, _SEP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", r"[_\s(-]*"
VERSION_MARKERS = (
    rf"(?iu){_SEP}{_BEFORE}v(?:er|ersion)?[_\s.-]*(\d+(?:\.\d+)*){_AFTER}\)?",
    rf"(?iu){_SEP}{_BEFORE}(?:rev|revision)[_\s.-]*(\d+){_AFTER}\)?",
    r"[_\s-]*\((\d+)\)",
    rf"(?iu){_SEP}{_BEFORE}copy(?:[_\s-]*\d+)?{_AFTER}",
    rf"(?iu){_SEP}{_BEFORE}(?:final|draft|clean|latest|old|new){_AFTER}",
)
VERSION_NUMBERS = (rf"(?iu){_BEFORE}v(?:er|ersion)?[_\s.-]*(\d+)", rf"(?iu){_BEFORE}(?:rev|revision)[_\s.-]*(\d+)", r"\((\d+)\)\s*$")
DATE_LIKE = r"(?<!\w)(?:19|20)\d{2}(?:[-_.]?(?:0[1-9]|1[0-2])(?:[-_.]?(?:0[1-9]|[12]\d|3[01]))?)?(?!\w)"


def _bare(filename: Column) -> Column:
    return F.regexp_replace(F.coalesce(filename, F.lit("")), r"\.[^.]+$", "")


def version_stem(filename: Column) -> Column:
    """The name without extension, version marks, dates and separators, in lower case."""
    out = _bare(filename)
    for pattern in (*VERSION_MARKERS, DATE_LIKE):
        out = F.regexp_replace(out, pattern, " ")
    return F.lower(F.regexp_replace(out, r"[^\p{L}\p{N}]+", ""))


def version_number(filename: Column) -> Column:
    found = [F.regexp_extract(_bare(filename), p, 1) for p in VERSION_NUMBERS]
    return F.coalesce(*(F.when(x != "", x.cast("int")) for x in found))


def has_version_marker(filename: Column) -> Column:
    bare, out = _bare(filename), F.lit(False)
    for pattern in VERSION_MARKERS:
        out = out | bare.rlike(pattern)
    return out


def filename_version_score(a: Column, b: Column) -> Column:
    """0 if the stems differ or are empty, 1 if a name has a version mark, else 0.5."""
    same = (version_stem(a) == version_stem(b)) & (version_stem(a) != "")
    return F.when(~same, 0.0).when(has_version_marker(a) | has_version_marker(b), 1.0).otherwise(0.5)


def similarity_confidence(score: Column) -> Column:
    """Content alone is never more than medium."""
    return F.when(score >= 0.85, "medium").when(score >= 0.65, "low")


def version_relationship(name_score: Column, content_score: Column, comparable: Column) -> tuple[Column, Column, Column]:
    """(is a candidate, score, confidence)."""
    both = content_score * 0.7 + name_score * 0.3
    score = F.when(name_score == 0, 0.0).when(~comparable, name_score * 0.5).otherwise(both)
    candidate = (name_score > 0) & (~comparable | (content_score >= 0.65))
    level = F.when(~candidate, F.lit(None)).when(~comparable, "low").when(both >= 0.85, "medium").otherwise("low")
    return candidate, score, level


def sanitize_segment(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")


def sanitize_title(text: Column) -> Column:
    out = F.regexp_replace(trim_all(F.coalesce(text, F.lit(""))), r'[\\/:*?"<>|]', "")
    out = F.regexp_replace(F.regexp_replace(out, f"{SPACE}+", "_"), "_+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def period(filename: Column) -> Column:
    found = F.regexp_extract(filename, r"(20\d{2})", 1)
    return F.when(found != "", found)


def usable_title(title: Column) -> Column:
    t = trim_all(title)
    return F.coalesce(F.length(t).between(2, 150) & ~t.rlike(JUNK_TITLE), F.lit(False))


def canonical_name(title: Column, subject: Column, document_type: Column, party: Column, date_or_period: Column, identifier: Column, filename: Column, extension: Column, version: Column, most: int = 120) -> Column:
    """A title comes first; without one the entities, and without those the subject and document type. The extension survives the cap on length."""
    clean = sanitize_title(title)
    when, lower = F.coalesce(date_or_period, period(filename)), F.lower(clean)
    some = lambda c: F.when(c != "", c)
    told = lambda c, plain: F.when(c.isNotNull() & ~F.contains(lower, plain), some(sanitize_segment(c)))
    by_title = F.concat_ws("_", clean, told(when, F.regexp_replace(F.lower(when), "[^a-z0-9]", "")), told(identifier, F.lower(identifier)))
    by_entity = F.concat_ws("_", some(sanitize_segment(F.coalesce(document_type, subject))), some(sanitize_segment(party)), some(sanitize_segment(when)), some(sanitize_segment(identifier)))
    s, d = sanitize_segment(subject), sanitize_segment(document_type)
    same = F.regexp_replace(F.lower(d), "s$", "") == F.regexp_replace(F.lower(s), "s$", "")
    by_bucket = F.concat_ws("_", some(s), F.when(~(same & (s != "")), some(d)), period(filename))
    base = F.when(clean != "", by_title).when(F.coalesce(party, date_or_period, identifier).isNotNull(), by_entity).otherwise(by_bucket)
    base = F.concat_ws("_", some(base), F.when(version > 1, F.concat(F.lit("v"), version.cast("string"))))
    ext = F.regexp_replace(F.coalesce(extension, F.lit("")), r"^\.", "")
    room = F.lit(most) - F.when(ext != "", F.length(ext) + 1).otherwise(0)
    return F.concat(F.substring(base, F.lit(1), room), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def mail_triage(subject: Column, sender: Column, labels: Column, unsubscribe: Column) -> Column:
    """junk, important, or null where the signs don't say."""
    has = lambda x: F.coalesce(F.array_contains(labels, x), F.lit(False))
    bulk = F.coalesce(sender, F.lit("")).rlike(BULK_SENDER)
    listed, promo = F.coalesce(unsubscribe, F.lit(False)), F.coalesce(subject, F.lit("")).rlike(PROMO_SUBJECT)
    junk = has("SPAM") | has("CATEGORY_PROMOTIONS") | has("CATEGORY_SOCIAL") | (listed & bulk) | (promo & (listed | bulk))
    return F.when(junk, "junk").when(has("IMPORTANT") | has("CATEGORY_PERSONAL"), "important")


def triage_reason(status: Column, job_status: Column, job_age: Column, extraction: Column, pipeline_state: Column, failure: Column, hash_: Column, has_content: Column, canonical: Column, needs_ocr: Column, quality: Column, grace_seconds: int = 300) -> Column:
    """Why a file needs a person, or null; the first reason that holds. job_age: seconds since the last job ended."""
    return (
        F.when(status == "missing", "missing")
        .when((job_status == "failed") & (job_age > grace_seconds), "job_failed")
        .when(extraction == "failed", "extraction_failed")
        .when((pipeline_state == "needs_user") & failure.isNotNull(), F.lit(None))
        .when(hash_.isNull() | ~has_content, "stalled")
        .when(canonical.isNotNull(), F.lit(None))
        .when(needs_ocr, "needs_ocr")
        .when(quality.isNotNull() & (quality != "ok"), "unreadable")
    )


TRIAGE_ORDER = ("missing", "job_failed", "extraction_failed", "stalled", "needs_ocr", "unreadable")


def retry_job(reason: Column, last_job: Column, hash_: Column) -> Column:
    """The job to run again: a failed one itself, else the earliest stage without a result; none for a missing file."""
    return F.when(reason.isNull() | (reason == "missing"), F.lit(None)).when((reason == "job_failed") & last_job.isNotNull(), last_job).when(hash_.isNull(), "hash").otherwise("extract_text")


def document_date(exif: Column, pdf: Column, created: Column, created_ticks: Column, modified: Column, modified_ticks: Column, fs_created: Column, fs_modified: Column, now: Column) -> tuple[Column, Column]:
    """(date, source): the most trustworthy plausible one (from 1900 to a year ahead)."""

    def plausible(c: Column) -> Column:
        return let(c, lambda x: F.when((x >= F.lit("1900-01-01").cast("timestamp")) & (x <= now + F.make_dt_interval(days=F.lit(366))), x))

    def stamped(c: Column) -> Column:
        m = F.regexp_extract
        pattern = r"^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?([Z+-])?(\d{2})?'?(\d{2})?"
        part = lambda i, other: F.coalesce(F.nullif(m(c, pattern, i), F.lit("")), F.lit(other))
        zone = F.when(m(c, pattern, 7).isin("+", "-"), F.concat(m(c, pattern, 7), part(8, "00"), F.lit(":"), part(9, "00"))).otherwise("Z")
        text = F.concat(m(c, pattern, 1), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), zone)
        return F.when(c.rlike(pattern), text.try_cast("timestamp"))

    def ticks(c: Column) -> Column:
        return F.when(c > 0, F.timestamp_millis((F.floor(c / 10000) - F.lit(11644473600000)).cast("long")))

    exif_text = F.regexp_replace(exif, r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}:\d{2}:\d{2}).*$", "$1-$2-$3T$4Z")
    found = [
        ("exif", F.when(exif.rlike(r"^\d{4}:\d{2}:\d{2}[ T]"), exif_text.try_cast("timestamp"))),
        ("pdf", stamped(F.trim(pdf))),
        ("embedded", F.trim(created).try_cast("timestamp")),
        ("ole", ticks(created_ticks)),
        ("embedded-modified", F.trim(modified).try_cast("timestamp")),
        ("ole-modified", ticks(modified_ticks)),
        ("filesystem", F.least(plausible(fs_created), plausible(fs_modified))),
    ]
    # Each value is made once; the first plausible one is both answers.
    fine = F.filter(F.array(*(F.struct(F.lit(name).alias("source"), plausible(value).alias("at")) for name, value in found)), lambda x: x["at"].isNotNull())
    first = F.get(fine, F.lit(0))
    return first["at"], F.coalesce(first["source"], F.lit("none"))


def slug(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "subject").otherwise(out)


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1 << 20, F.format_string("%.0f KB", n / 1024))
        .when(n < 1 << 30, F.format_string("%.1f MB", n / (1 << 20)))
        .otherwise(F.format_string("%.1f GB", n / (1 << 30)))
    )

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import filters
from lumenfold.functions import text as X
from lumenfold.operators import relational as R
from lumenfold.operators import retrieval as S
from lumenfold.sources import files, sinks


def test_filter_parsing():
    assert filters.parse_extensions(".PDF, pdf ,Docx,.docx") == ["pdf", "docx"]
    for bad in ("last tuesday", "2019", "31/12/2019", "2019-13-01x"):
        with pytest.raises(ValueError):
            filters.parse_day(bad)
    with pytest.raises(ValueError):
        filters.parse_extensions(",".join(f"e{i}" for i in range(41)))
    with pytest.raises(ValueError):
        filters.Filter(owner=None)
    day = datetime.date(2019, 1, 1)
    with pytest.raises(ValueError):
        filters.Filter(owner="o", day_from=day, day_to=day - datetime.timedelta(days=1))
    assert filters.Filter(owner="o", day_from=day, day_to=day).any() and not filters.Filter(owner="o").any()
    with pytest.raises(ValueError):
        filters.confidence_band("c", True)


FILES = [
    ("Archives/rapport-2019.pdf", "2019-06-15", "parent.child", "pdf"),
    ("Archives/lettre-2019.doc", "2019-12-31", "parent.child", "doc"),
    ("Archives/budget-2021.pdf", "2021-03-02", "parent", "pdf"),
    ("Recent/photo-2023.jpg", "2023-08-01", "parent", "jpg"),
    ("Recent/undated.pdf", None, "parent.child", "pdf"),
    ("Recent/README", "2019-01-01", None, None),
]


def test_filter_fixture(spark):
    rows = [("me", p, e, datetime.date.fromisoformat(d) if d else None, s, 1) for p, d, s, e in FILES] + [("other", "Archives/x.pdf", "pdf", None, None, 1)]
    df = spark.createDataFrame(rows, "owner string, path string, extension string, document_date date, subject_path string, location int")

    def names(**how):
        return sorted(r["path"].split("/")[1].split("-")[0].split(".")[0] for r in filters.Filter(owner="me", **how).apply(df).collect())

    y = (datetime.date(2019, 1, 1), datetime.date(2019, 12, 31))
    assert len(names()) == 6
    assert names(extensions=["pdf"]) == ["budget", "rapport", "undated"]
    assert len(names(extensions=["pdf", "jpg"])) == 4
    assert names(extensions=["none"]) == ["README"]
    assert names(day_from=y[0], day_to=y[1]) == ["README", "lettre", "rapport"]
    assert "undated" not in names(day_from=datetime.date(1900, 1, 1), day_to=datetime.date(2100, 1, 1))
    assert len(names(path_prefix="Archives")) == 3
    assert len(names(subject_path="parent")) == 5 and len(names(subject_path="parent.child")) == 3
    assert names(extensions=["pdf"], day_from=y[0], day_to=y[1], path_prefix="Archives") == ["rapport"]
    assert filters.page(df, [F.col("path")], limit=3, offset=-1).count() == 3


def column(spark, value, kind="string", **others):
    return spark.createDataFrame([(value,)], f"v {kind}")


@pytest.mark.parametrize(
    "text,size,verdict,script",
    [
        ("The committee met on Tuesday and approved the annual budget report", 1000, "ok", "latin"),
        ("L'économie générale de la congrégation était présentée à l'assemblée", 1000, "ok", "latin"),
        ("هذا تقرير سنوي عن أعمال اللجنة المركزية في المدينة", 1000, "ok", "arabic"),
        ("זהו דוח שנתי על עבודת הוועדה המרכזית בעיר", 1000, "ok", "hebrew"),
        ("", 10, "empty", None),
        ("    \n", 10, "empty", None),
        ("Scan 001", 100, "too_short", "latin"),
        ("Scan page", 100, "too_short", "latin"),
        ("tiny", 4_000_000, "no_text_layer", "latin"),
        ("a b c d e f g h i j k l", 100, "gibberish", "latin"),
        ("#### $$$$ %%%% &&&& abc", 100, "gibberish", "latin"),
        ("good words here ��� and more of them", 100, "gibberish", "latin"),
        ("bcdfg hjklm npqrs tvwxz bcdfg hjklm", 100, "gibberish", "latin"),
    ],
)
def test_text_quality(spark, text, size, verdict, script):
    df = column(spark, text).select(X.quality_stats(F.col("v")).alias("s")).select("s.*")
    r = df.withColumn("verdict", X.quality_verdict(F.lit(size))).first()
    assert (r["verdict"], r["script"]) == (verdict, script)


def test_versions(spark):
    names = ["Report_v2", "Report v3", "Report_version_2", "Report (2)", "Report_final", "Report - draft", "Report_rev4", "Report copy", "Report_latest", "Report"]
    df = spark.createDataFrame([(n + ".pdf",) for n in names], "n string")
    assert {r[0] for r in df.select(X.version_stem(F.col("n"))).collect()} == {"report"}
    numbers = {"R_v2": 2, "R version 11": 11, "R_rev3": 3, "R (4)": 4, "R_final": None, "R": None}
    df = spark.createDataFrame([(n + ".doc",) for n in numbers], "n string")
    assert [r[0] for r in df.select(X.version_number(F.col("n"))).collect()] == list(numbers.values())
    score = lambda a, b: spark.range(1).select(X.filename_version_score(F.lit(a), F.lit(b))).first()[0]
    assert (score("R_v1.doc", "R_v2.doc"), score("Report.doc", "Budget.doc"), score("Report.doc", "Report.pdf")) == (1, 0, 0.5)
    levels = spark.createDataFrame([(1.0,), (0.9,), (0.7,), (0.4,)], "s double").select(X.similarity_confidence(F.col("s"))).collect()
    assert [r[0] for r in levels] == ["medium", "medium", "low", None]
    candidate = lambda *a: tuple(spark.range(1).select(*X.version_relationship(*(F.lit(x) for x in a))).first())
    assert candidate(1.0, 0.95, True)[0] and not candidate(1.0, 0.2, True)[0] and candidate(1.0, 0.0, False) == (True, 0.5, "low")


def test_dates(spark):
    names = ["exif", "pdf", "created", "created_ticks", "modified", "modified_ticks", "fs_created", "fs_modified"]
    cases = [
        (dict(exif="2024:03:15 12:00:00", pdf="D:20200101"), "2024-03-15 12:00:00", "exif"),
        (dict(pdf="D:20230405103000+02'00'"), "2023-04-05 08:30:00", "pdf"),
        (dict(pdf="D:202304"), "2023-04-01 00:00:00", "pdf"),
        (dict(pdf="junk", created="2021-02-03T04:05:06Z", modified="2022-01-01T00:00:00Z"), "2021-02-03 04:05:06", "embedded"),
        (dict(created_ticks=0, modified_ticks=132223104000000000), "2020-01-01 00:00:00", "ole-modified"),
        (dict(created="1812-01-01T00:00:00Z", fs_created="2019-05-05", fs_modified="2018-05-05"), "2018-05-05 00:00:00", "filesystem"),
        (dict(), None, "none"),
    ]
    kinds = {"created_ticks": "long", "modified_ticks": "long", "fs_created": "timestamp", "fs_modified": "timestamp"}
    for given, date, source in cases:
        row = spark.range(1).select(*(F.lit(given.get(n)).cast(kinds.get(n, "string")).alias(n) for n in names))
        got = row.select(*X.document_date(*(F.col(n) for n in names), F.lit("2025-01-01").cast("timestamp"))).first()
        assert (str(got[0]) if got[0] else None, got[1]) == (date, source), given


def test_mail(spark):
    def triage(subject="", sender="a@b.c", labels=(), unsubscribe=False):
        tags = F.array(*(F.lit(x) for x in labels)) if labels else F.lit(None).cast("array<string>")
        return spark.range(1).select(X.mail_triage(F.lit(subject), F.lit(sender), tags, F.lit(unsubscribe))).first()[0]

    assert triage(labels=["SPAM", "IMPORTANT"]) == "junk" and triage(labels=["CATEGORY_SOCIAL"]) == "junk"
    assert triage(labels=["IMPORTANT"]) == "important" and triage() is None
    assert triage(sender="no-reply@x.y") is None and triage(unsubscribe=True) is None
    assert triage(sender="newsletter@x.y", unsubscribe=True) == "junk"
    assert triage("Flash sale today") is None and triage("50% off now", unsubscribe=True) == "junk"
    assert triage(None, None) is None


def test_triage_order(spark):
    base = dict(status="active", job=None, age=0, extraction=None, state="processing", failure=None, hash="h", content=True, canonical=None, ocr=False, quality="ok")
    cases = [
        (dict(status="missing"), "missing", None),
        (dict(job="failed", age=3600), "job_failed", "classify"),
        (dict(job="failed", age=60), None, None),
        (dict(extraction="failed"), "extraction_failed", "extract_text"),
        (dict(hash=None), "stalled", "hash"),
        (dict(content=False), "stalled", "extract_text"),
        (dict(content=False, state="needs_user", failure="x"), None, None),
        (dict(ocr=True, quality="no_text_layer"), "needs_ocr", "extract_text"),
        (dict(quality="gibberish"), "unreadable", "extract_text"),
        (dict(quality="gibberish", canonical="n"), None, None),
        (dict(quality=None), None, None),
    ]
    for change, reason, retry in cases:
        v = {k: F.lit(x).cast("string") if x is None else F.lit(x) for k, x in (base | change).items()}
        r = X.triage_reason(v["status"], v["job"], v["age"], v["extraction"], v["state"], v["failure"], v["hash"], v["content"], v["canonical"], v["ocr"], v["quality"])
        got = spark.range(1).select(r.alias("r"), X.retry_job(r, F.lit("classify"), v["hash"]).alias("j")).first()
        assert (got["r"], got["j"]) == (reason, retry), change


def test_names(spark):
    def name(title=None, subject=None, kind=None, party=None, when=None, ident=None, filename="x", ext="pdf", version=1):
        args = [F.lit(x).cast("string") for x in (title, subject, kind, party, when, ident, filename, ext)]
        return spark.range(1).select(X.canonical_name(*args, F.lit(version))).first()[0]

    assert name("Letter from Mom") == "Letter_from_Mom.pdf"
    assert name("Annual Returns 2024", when="2024") == "Annual_Returns_2024.pdf"
    assert name("Annual Returns", filename="scan 2024.pdf", version=2) == "Annual_Returns_2024_v2.pdf"
    assert name(None, "Finance", "Invoice", "ACME Ltd.", "2023-05", "INV/7") == "Invoice_ACMELtd_202305_INV7.pdf"
    assert name(None, "Certificates", "Certificate", filename="a 2019") == "Certificates_2019.pdf"
    assert len(name("long " * 60)) == 120 and name("long " * 60).endswith(".pdf")
    usable = lambda t: spark.range(1).select(X.usable_title(F.lit(t).cast("string"))).first()[0]
    assert not usable("Untitled") and not usable("x") and not usable(None) and not usable("Document12") and usable("Budget")
    safe = lambda n: spark.range(1).select(sinks.safe_name(F.lit(n).cast("string"))).first()[0]
    assert safe("a.pdf") and not any(safe(n) for n in ("", "a/b", "..", "CON.txt", "a.", "x" * 121, "a?b", None))
    df = spark.createDataFrame([(1, "A/x.pdf"), (2, "a/X.pdf"), (3, "a/y.pdf")], "id int, path string")
    assert sorted(r["path"] for r in sinks.disambiguated(df, "path", "id").collect()) == ["A/x.pdf", "a/X (2).pdf", "a/y.pdf"]
    path = lambda s: spark.range(1).select(sinks.mirror_path(F.lit(s).cast("string"), F.lit("n"))).first()[0]
    assert path("Finance.Budgets") == "Finance/Budgets/n" and path(None) == "_Unsorted/n"


def test_relational(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None)], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in R.latest_wins(df, ["k"], ["t"], ["v"]).collect()} == {(1, None), (2, None)}
    assert {(r["k"], r["v"]) for r in R.latest_non_null(df, ["k"], ["t"], "v").collect()} == {(1, "a"), (2, None)}
    versions = spark.createDataFrame([(1, 1, True), (2, 1, True)], "document_id int, version_number int, is_current boolean")
    swapped = sinks.swapped_version(versions, spark.createDataFrame([(1,), (3,)], "document_id int")).collect()
    assert {(r["document_id"], r["version_number"], r["is_current"]) for r in swapped} == {(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, True)}


def test_retrieval(spark):
    assert S.parse_query('budget "annual report" or rapport -draft') == ([["budget", "annual report"], ["rapport"]], ["draft"])
    df = spark.createDataFrame([(1, "the annual report on budget"), (2, "annual budget report"), (3, "rapport draft"), (4, "rapport")], "id int, t string")
    assert {r["id"] for r in df.where(S.matches(F.col("t"), 'budget "annual report" or rapport -draft')).collect()} == {1, 4}
    one = spark.createDataFrame([("alpha", 2), ("b", 1)], "id string, rank int")
    two = spark.createDataFrame([("alpha", 2), ("c", 1)], "id string, rank int")
    three = spark.createDataFrame([("alpha", 2), ("d", 1)], "id string, rank int")
    rows = sorted(S.fused([("x", one), ("y", two), ("z", three)], "id").collect(), key=lambda r: (-r["score"], r["id"]))
    assert [r["id"] for r in rows] == ["alpha", "b", "c", "d"] and rows[0]["matched_by"] == "x,y,z" and abs(rows[1]["score"] - 1 / 61) < 1e-12
    v = spark.range(1).select(S.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("a"), S.normalised(F.array(F.lit(0.0))).alias("z"), S.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).first()
    assert v["a"] == [0.6, 0.8] and v["z"] == [0.0] and v["d"] == 0.0


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_extraction(spark, tmp_path):
    core = "<cp:coreProperties><dc:title>The &amp; Title</dc:title><dc:creator>Me</dc:creator></cp:coreProperties>"
    docs = {
        "a.docx": archive({"word/document.xml": "<w:p>Hello</w:p><w:p>&amp;lt;world</w:p>", "docProps/core.xml": core}),
        "b.pptx": archive({"ppt/presentation.xml": "", **{f"ppt/slides/slide{i}.xml": f"<a>s{i}</a>" for i in (1, 2, 10)}}),
        "c.xlsx": archive({"xl/workbook.xml": '<sheets><sheet name="One" id="1"/></sheets>', "xl/sharedStrings.xml": "<si><t>Head</t></si>", "xl/worksheets/sheet1.xml": '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><f>A2</f><v>7</v></c></row>'}),
        "d.pbix": archive({"DataModel": "x", "Report/Layout": b"\xff\xfe" + '{"sections":[{"name":"Page one"}]}'.encode("utf-16-le"), "Version": "1.2"}),
        "e.zip": b"PK\x03\x04broken", "f.png": b"\x89PNG\r\n\x1a\n", "g.pdf": b"%PDF-1.4", "h.txt": "plain \x00text".encode(), "Thumbs.db": b"junk",
    }
    for name, data in docs.items():
        (tmp_path / name).write_bytes(data)
    listed = files.scan(spark, str(tmp_path))
    assert {r["name"] for r in listed.collect()} == set(docs) - {"Thumbs.db"}
    content = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r["name"]: r for r in files.extract(listed.join(content, "path"), others={"pdf": lambda c: ("pdf text", {})}).collect()}
    assert got["a.docx"]["text"] == "Hello <world" and '"creator": "Me"' in got["a.docx"]["metadata"]
    assert got["b.pptx"]["text"] == "s1\ns2\ns10" and got["c.xlsx"]["text"] == "One Head Head 7" and '"formulaCount": 1' in got["c.xlsx"]["metadata"]
    assert got["d.pbix"]["text"] == "Page one" and '"reportPageCount": 1' in got["d.pbix"]["metadata"]
    assert got["e.zip"]["extractor"] == "unsupported" and got["f.png"]["kind"] == "png" and got["g.pdf"]["text"] == "pdf text" and got["h.txt"]["text"] == "plain text"
    big = files.extract(listed.join(content, "path"), most_bytes=5)
    assert {r["extractor"] for r in big.where("size > 5").collect()} == {"skipped"}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', ["a"])], "id int, t string, l array<string>")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.splitlines()[1] == '"1","say ""hi""","[""a""]"'


def test_very_long_texts(spark):
    """Counts of a text of 200,000 characters, and a size that no int holds."""
    df = spark.createDataFrame([("ab cd, é " * 25_000, 1 << 40), ("word " * 40_000, 10)], "text string, bytes long")
    flat = df.select(X.quality_stats(F.col("text")).alias("s"), "bytes").select("s.*", "bytes").withColumn("verdict", X.quality_verdict(F.col("bytes")))
    a, b = sorted(flat.collect(), key=lambda r: -r["bytes"])
    assert (a["chars"], a["letters"], a["vowels"], a["n_tokens"], a["single_char_tokens"], a["verdict"]) == (224_999, 125_000, 50_000, 75_000, 25_000, "no_text_layer")
    assert (b["chars"], b["letters"], b["n_tokens"], b["script"], b["verdict"]) == (199_999, 160_000, 40_000, "latin", "ok")


def test_snippets(spark):
    from lumenfold.operators.retrieval import snippet

    words = [f"w{i}" for i in range(60)]
    one, two = list(words), list(words)
    one[20] = "Cat,"
    two[0], two[3], two[50] = "cat", "DOG", "(cat)"
    df = spark.createDataFrame([(1, " ".join(one)), (2, "  ".join(two)), (3, "concatenate"), (4, None), (5, "")], "id int, text string")
    got = {r["id"]: r["s"] for r in df.select("id", snippet(F.col("text"), ["cat", "dog"]).alias("s")).collect()}
    assert got[1] == " ".join([*words[12:20], "<mark>Cat,</mark>", *words[21:34]])
    assert got[2] == " ".join(["<mark>cat</mark>", "w1", "w2", "<mark>DOG</mark>", *words[4:14], "…", *words[42:50], "<mark>(cat)</mark>", *words[51:]])
    assert got[3] is None and got[4] is None and got[5] is None


def test_search_routes(spark):
    from lumenfold.operators import search

    assert [search.route(*a) for a in (("x",), ("x", "content"), (" ", "content", "missing"), ("x", None, "missing"), ())] == ["hybrid", "content", "status", "hybrid", "list"]
    with pytest.raises(ValueError):
        search.route("x", "other")
    df = spark.createDataFrame([("o", "pdf", 1), ("o", "txt", 2), ("p", "pdf", 3)], "owner string, extension string, id int")
    wanted = filters.Filter(owner="o", extensions=["pdf"])
    assert search.counted(df, wanted).first()["n"] == 1
    with pytest.raises(ValueError):
        search.counted(df, wanted, term="x")
    said = spark.createDataFrame([("content,semantic",), ("filename",), ("",)], "m string").select(search.explained(F.col("m"))).collect()
    assert [r[0] for r in said] == ["Found because its text holds the words and it is about the same.", "Found because its name holds the words.", "Found by the filter."]

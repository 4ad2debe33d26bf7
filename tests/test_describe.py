from pyspark.sql import functions as F

from lumenfold.functions import describe as D
from lumenfold.operators import proposals as P


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_readable_names(spark):
    cases = {"WhatsApp Video 2026-07-16 at 00.16.15.mp4": "WhatsApp Video at", "Tax_Returns_2019.pdf": "Tax Returns 2019", "cv2.txt": "cv2", "20240101.jpg": None, "report-12.doc": "report", None: None, "cv.txt": "cv"}
    for name, want in cases.items():
        assert one(spark, D.readable_name(F.lit(name).cast("string"))) == want, name


def test_situations(spark):
    kind = D.kind_of(F.lit(".ZIP"), F.lit("document"))
    caption, text = D.situation(kind, F.lit(4_400_000), F.lit("backup_2024.zip"), F.lit("stored in Backups"), F.lit("2024-05-06").cast("date"))
    assert one(spark, caption) == "ZIP archive: backup 2024"
    assert one(spark, text) == 'ZIP archive, 4.2 MB, stored in Backups. Its filename reads "backup 2024". Dated 2024-05-06.' + D.CAVEAT
    assert one(spark, D.kind_of(F.lit("mov"), F.lit("video"))) == "MOV video"
    said = D.embedding_input(F.lit("c"), F.lit("boilerplate"), F.lit("metadata"), F.lit("ZIP archive"), F.lit("a_b.zip"), F.lit("X"))
    assert one(spark, said) == "c\nZIP archive\nFilename: a b\nFiled under: X"


def test_misread_text(spark):
    for codec in ("latin-1", "cp1252"):
        bad = "Théologie à l’école été".replace("’", "'").encode().decode(codec)
        assert one(spark, D.looks_misread(F.lit(bad))) and one(spark, D.repaired(F.lit(bad))) == "Théologie à l'école été"
    for good in ("Théologie", "plain", "", "Ā¼ mixed"):
        assert one(spark, D.repaired(F.lit(good))) == good


def test_proposals(spark):
    files = spark.createDataFrame(
        [(1, "a", "x", "high", False, True), (2, "a", "x", "low", True, False), (3, "x", "x", "high", True, True), (4, "a", "x", "high", True, True), (5, "a", "x", "high", True, True), (6, "a", "x", "medium", True, True)],
        "file_id int, current_name string, proposed_name string, confidence string, readable boolean, has_title boolean",
    )
    history = spark.createDataFrame([(4, 1, "x", "rejected"), (5, 2, "x", "pending"), (6, 3, "y", "pending"), (7, 4, "z", "pending")], "file_id int, proposal_id int, proposed_name string, status string")
    new = P.decided(files, history)
    assert {r["file_id"]: r["decision"] for r in new.collect()} == {1: "unreadable", 2: "uncertain", 3: "unchanged", 4: "rejected_before", 5: "pending_already", 6: "propose"}
    assert {r["proposal_id"]: r["status"] for r in P.superseded(history, new).collect()} == {1: "rejected", 2: "pending", 3: "superseded", 4: "pending"}
    approved = P.reviewed(history, F.col("proposal_id") >= 3, "approved")
    own = spark.createDataFrame([(6, "a", None, True), (7, "b", None, False), (8, "c", None, True)], "file_id int, current_name string, canonical_name string, is_read_only boolean")
    got = {r["file_id"]: (r["current_name"], r["canonical_name"], r["outcome"]) for r in P.applied(own, approved).collect()}
    assert got == {6: ("a", "y", "named"), 7: ("z", None, "renamed"), 8: ("c", None, "skipped")}
    assert one(spark, P.auto_applies(F.lit(True), F.lit(True), F.lit("high"))) and not one(spark, P.auto_applies(F.lit(True), F.lit(True), F.lit("medium")))

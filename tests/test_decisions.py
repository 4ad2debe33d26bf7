import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import choices


def test_twins_pass_over_the_file_itself(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([True, False, None]), rng.randrange(3)) for i in range(200)] + [(500, "alone", True, 0), (501, "pair", True, 1), (502, "pair", None, 0)]
    df = spark.createDataFrame(rows, "id long, h string, donor boolean, rank int")
    got = {r["id"]: r["twin"] for r in choices.best_twins(df, ["h"], "id", F.col("donor"), [F.col("rank"), F.col("id")], "twin").collect()}
    for i, h, _, _ in rows:
        others = [(r, j) for j, g, d, r in rows if h is not None and g == h and d and j != i]
        assert got[i] == (min(others)[1] if others else None)


def test_caps_belong_to_their_lists(spark):
    frame = lambda rows: spark.createDataFrame(rows, "o string, id long, at long")
    first, second = frame([("x", i, i) for i in range(5)] + [("y", 1, 1)]), frame([("x", i, -i) for i in range(3, 9)] + [("z", 7, 7)])
    got = sorted((r["o"], r["place"], r["id"], r["list"]) for r in choices.capped_union([("p", first, 4), ("q", second, 3)], "o", "id", "at").collect())
    assert got == [("x", 1, 0, "p"), ("x", 2, 1, "p"), ("x", 3, 2, "p"), ("x", 4, 3, "p"), ("x", 5, 8, "q"), ("x", 6, 7, "q"), ("x", 7, 6, "q"), ("y", 1, 1, "p"), ("z", 1, 7, "q")]


def test_keywords(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Invoice_2019.pdf", "the invoice, INVOICED"), (2, None, "tax and invoice"), (3, "x", None), (4, "", ""), (None, "tax invoice", "tax")], "id long, name string, text string")
    taxonomy = spark.createDataFrame([("Finance", 1, "invoice"), ("Finance", 1, "Invoice"), ("Tax", 0, "tax"), ("Tax", 0, None), ("Tax", 0, ""), ("Finance", 1, "voice")], "subject string, ord int, word string")
    got = {r["id"]: (r["subject"], r["score"], r["confidence"]) for r in choices.classified(docs, taxonomy, "id", "name", "text").collect()}
    assert got == {1: ("Finance", 8, "high"), 2: ("Finance", 2, "medium"), 3: (None, 0, "low"), 4: (None, 0, "low"), None: ("Finance", 6, "high")}
    assert choices.classified(docs, taxonomy.limit(0), "id", "name", "text").where("score > 0").count() == 0
    monkeypatch.setattr(choices, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        choices.classified(docs, taxonomy, "id", "name", "text")

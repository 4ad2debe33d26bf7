import random

import pytest

from lumenfold.operators import retrieval


@pytest.mark.parametrize("floor", [None, 0.3])
def test_pieces_of_rows_and_queries_equal_brute_force(spark, monkeypatch, floor):
    """Ties, null and ragged vectors, empty ones; pieces far smaller than the tables."""
    monkeypatch.setattr(retrieval, "QUERY_PIECE", 4)
    monkeypatch.setattr(retrieval, "ROW_PIECE", 25)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)] + [(200, None), (201, []), (202, [1.0, 1.0]), (203, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in retrieval.nearest(df, df.where("vec_id % 10 = 0 or vec_id > 199"), 7, floor).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    want = {}
    for q, v in rows:
        if v is not None and (q % 10 == 0 or q > 199):
            scored = [(-round(sum(a * b for a, b in zip(v, w)), 6) if len(v) == len(w) else 0.0, i) for i, w in rows if w is not None]
            if best := sorted(x for x in scored if floor is None or -x[0] >= floor)[:7]:
                want[q] = best
    assert {q: sorted(x) for q, x in got.items()} == want


def test_nothing_to_ask_or_to_find(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert retrieval.nearest(empty, one).collect() == [] and retrieval.nearest(one, empty).collect() == []

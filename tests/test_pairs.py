import random

import pytest
from tests.oracle import connection, differences
from tests.test_similarity import sets

from lumenfold.operators import pairs
from lumenfold.plans import versions

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["version_pairs", "similar_findings"])
def test_equal_to_all_pairs(spark, name):
    a, b, wrong = differences(versions.QUERIES[name](spark, SF), connection(SF), versions.SQL[name])
    assert a == b > 0 and not wrong


def texts(seed, n, words=60):
    """Families of texts with a few words changed."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([words, words + 25, 5]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(0, 4)):
                copy[at] = f"x{rng.randrange(4000)}"
            out.append(" ".join(copy + [f"y{i}" for i in range(rng.randrange(0, 12))]))
    return out[:n]


def alike(a, b):
    (wa, sa), (wb, sb) = sets(a), sets(b)
    return round(len(sa & sb) / len(sa | sb), 6) if len(wa) >= 40 and len(wb) >= 40 else None


@pytest.mark.parametrize("block", [256, 3])
def test_best_pairs_of_groups(spark, block):
    found = texts(4, 90)
    rows = [(f"g{i % 2}", i, list({hash(x) for x in sets(t)[1]}), 1 + i % 4, float(i % 3 == 0)) for i, t in enumerate(found)] + [("g0", 500, [], 3, 0.0), ("g0", 501, None, 3, 0.0)]
    df = spark.createDataFrame(rows, "`group` string, key long, set array<long>, room int, mark double")
    score = lambda s, a, b: s + 0.5 * ((a[:, None] > 0) | (b[None, :] > 0))
    for used in (None, score):
        got = sorted(tuple(r) for r in pairs.best_pairs(df, 0.65, used, block).collect())
        want = []
        for g, i, s, room, mark in rows[:90]:
            near = [(-round((len(set(s) & set(o)) / len(set(s) | set(o))), 6) - (0.5 if used and (mark or m) else 0), j, len(set(s) & set(o)) / len(set(s) | set(o))) for h, j, o, _, m in rows[:90] if h == g and i != j]
            near = sorted(x for x in near if x[2] >= 0.65 - 1e-9)[:room]
            want += [(g, i, j, round(s, 6), -v, place) for place, (v, j, s) in enumerate(near, 1)]
        assert [(*r[:3], round(r[3], 6), round(r[4], 6), r[5]) for r in got] == [(*r[:4], round(r[4], 6), r[5]) for r in sorted(want)]


def test_a_stem_with_most_files_keeps_every_best_version(spark):
    """Ties, repeated contents, short texts, null owners and keys."""
    found = texts(7, 120)
    files = [(i, "o", "report", f"k{hash(t)}", f"report{'_v2' if i % 5 == 0 else ''}.txt", t) for i, t in enumerate(found)]
    files += [(900 + i, "o", "report", files[i][3], files[i][4], found[i]) for i in range(20)]
    files += [(990, None, "report", "k", "report.txt", found[0]), (991, "o", "report", None, "report.txt", found[0]), (992, "o", "", "k9", "x", found[0]), (993, "o", None, "k9", "x", found[0])]
    df = spark.createDataFrame(files, "file_id long, owner string, stem string, content_key string, name string, text string")
    got = sorted((r["first"], r["place"], r["other"], r["score"]) for r in pairs.version_pairs(df, 4).collect())
    contents = {}
    for i, owner, stem, key, name, text in files:
        if owner and key and stem:
            first, _, mark = contents.get(key, (i, text, False))
            contents[key] = (min(first, i), text, mark or "_v2" in name)
    want = []
    for i, t, m in contents.values():
        near = []
        for j, u, n in contents.values():
            if i != j:
                s, name = alike(t, u), 1.0 if m or n else 0.5
                if s is None or s >= 0.65:
                    near.append((-(0.5 * name if s is None else 0.7 * s + 0.3 * name), j))
        want += [(i, place, j, -v) for place, (v, j) in enumerate(sorted(near)[:4], 1)]
    assert got == sorted(want)


def test_nothing_in_empty_tables(spark):
    files = spark.createDataFrame([], "file_id long, owner string, stem string, content_key string, name string, location string, text string")
    moves, dismissed = spark.createDataFrame([], "file_id long, destination string"), spark.createDataFrame([], "a long, b long")
    assert pairs.version_pairs(files).collect() == [] and pairs.similar_findings(moves, files, dismissed).collect() == []


def test_cleared_contents_take_no_place(spark):
    base = " ".join(f"w{i}" for i in range(50))
    family = [f"{base} z{i}" for i in range(14)]
    files = spark.createDataFrame([(i, "o", f"k{i}", "s" if i % 2 else None, "here" if i == 13 else None, t) for i, t in enumerate(family)], "file_id long, owner string, content_key string, stem string, location string, text string")
    moves = spark.createDataFrame([(1, "here"), (0, None)], "file_id long, destination string")
    dismissed = spark.createDataFrame([(1, i) for i in range(2, 6)] + [(0, 1), (3, 1)], "a long, b long")
    got = {(r["file_id"], r["group_id"]): (r["kind"], r["blocking"], r["place"]) for r in pairs.similar_findings(moves, files, dismissed).collect()}
    assert {g for f, g in got if f == 1} == set(range(6, 14)) and {g for f, g in got if f == 0} == set(range(2, 12))
    assert got[1, 13][:2] == ("version", True) and got[1, 6][:2] == ("similar", False) and got[1, 7][:2] == ("version", False) and got[0, 3] == ("similar", False, 2)


def test_sets_are_fetched_for_meetings_only(spark, monkeypatch):
    """Sets that meet no other aren't carried into blocks, and what is cut into blocks carries no set."""
    cut = []
    real = pairs.block_pairs
    monkeypatch.setattr(pairs, "block_pairs", lambda rows, *more: cut.append(rows) or real(rows, *more))
    # Two alike; a third, much larger, shares a rare member with them and meets nobody.
    rows = [("g", 1, list(range(20)), 5, 0.0), ("g", 2, list(range(1, 21)), 5, 0.0), ("g", 3, [0, 20, *range(1000, 1300)], 5, 0.0), ("h", 1, list(range(20)), 5, 0.0)]
    df = spark.createDataFrame(rows, "`group` string, key long, set array<long>, room int, mark double")
    got = sorted((r["group"], r["key"], r["other"]) for r in pairs.best_pairs(df).collect())
    assert got == [("g", 1, 2), ("g", 2, 1)]
    assert "set" not in cut[0].columns and cut[0].groupBy("cluster", "meeting").count().where("count < 2").count() == 0

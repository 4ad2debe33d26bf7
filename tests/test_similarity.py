import random
import re

import pytest

from lumenfold.operators import similarity

WORDS = [f"w{i}" for i in range(30)]


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return w, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows, threshold):
    found = [sets(t) for _, t in rows]
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if len(found[i][0]) >= 40 and len(found[j][0]) >= 40:
                a, b = found[i][1], found[j][1]
                if len(a & b) >= threshold * len(a | b) - 1e-9:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out.append((rows[i][0], len(links[i]), min(rows[m][0] for m in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [256, 4])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += texts[:3] + [None, "", "one two"]
    rows = [(i * 2 + 7, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, set string")
    got = sorted(tuple(r) for r in similarity.near_duplicates(df, block=block).select("id", "n_links", "group_id").collect())
    assert got == brute(rows, 0.8)
    assert similarity.near_duplicates(df.where("false")).collect() == []


def test_hot_texts(spark, monkeypatch):
    """Texts with very many copies are handled apart: with and without partners, short and empty ones."""
    from lumenfold.operators import groups

    monkeypatch.setattr(similarity, "hot_keys", lambda counts: groups.hot_keys(counts, least=3))
    monkeypatch.setattr(groups, "HOT_SHARE", 8)
    rng = random.Random(6)
    base = [[f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(60)] for _ in range(6)]
    near = [*base[0][:-1], "changed"]
    texts = [" ".join(base[0])] * 9 + [" ".join(near)] * 2 + [" ".join(base[1])] * 8 + ["few words"] * 8 + [""] * 8 + [None] * 8 + [" ".join(b) for b in base[2:]]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_links", "group_id").collect())
    assert got == brute(rows, 0.8)


def test_jaccard_of_empty_sets(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(similarity.jaccard(similarity.shingles(F.array().cast("array<string>")), similarity.shingles(F.array(F.lit("a")))).alias("j")).first()
    assert r["j"] == 0
    assert similarity.threshold_prefix(100) == 21


def test_short_copies_are_linked_by_the_query(spark, tmp_path):
    from lumenfold.plans.registry import QUERIES

    texts = ["one two three four five six", "One two, three four five six", "hi", "Hi!", "", None, "..."]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["near_duplicate_components"](spark, str(tmp_path)).select("doc_id", "n_links", "group_id", "comparable").collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, False), (1, 1, 0, False), (2, 1, 2, False), (3, 1, 2, False), (4, 0, 4, False), (5, 0, 5, False), (6, 0, 6, False)]


def test_words_of_texts_are_hashed_as_the_pattern_finds_them(monkeypatch):
    import itertools

    from lumenfold.operators import words

    texts = ["", "...", "one two_three", "ONE".lower() + " é文字 𝒜𝒜x ²", "a" * 9000 + " " + "a" * 8999 + "b", " ab ba aab", "İx ς".lower()]
    want = [re.findall(r"[^\W_]+", t) for t in texts]
    for at_a_time in (1 << 20, 3):
        monkeypatch.setattr(words, "_LETTERS", at_a_time)
        hashes, counts = words.text_hashes(texts)
        assert counts.tolist() == [len(w) for w in want]
        told = {}
        for word, h in zip(itertools.chain(*want), hashes.tolist(), strict=True):
            assert told.setdefault(word, h) == h
        assert len(set(told.values())) == len(told)
    assert [len(x) for x in words.text_hashes([])] == [0, 0]


def test_rarest_members_are_chosen_once_and_shingles_travel_in_lists(spark, monkeypatch):
    made, before = [], similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, what: made.append((what, df)) or before(df, what))
    rng = random.Random(9)
    base = [[f"{rng.choice(WORDS)}{rng.randrange(90)}" for _ in range(60)] for _ in range(5)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "changed"]) for b in base]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_links", "group_id").collect())
    assert got == brute(rows, 0.8)
    frames = dict(made)
    assert "prefixes" in frames  # both of its uses read the table
    plans = [frames[what]._jdf.queryExecution().executedPlan().toString() for what in ("alone", "prefixes")]
    assert all(p.count("hashpartitioning(bucket") == 2 and "hashpartitioning(s" not in p for p in plans)
    assert "getbit" in frames["sets"]._jdf.queryExecution().optimizedPlan().toString()  # texts that are alone aren't dealt by key


def test_texts_that_may_be_among_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = spark.range(-5000, 5000).select("id", F.xxhash64("id").alias("k"))
    keys = texts.where("id % 50 = 0").select("k")
    got = {r["id"] for r in similarity._likely(texts, keys).select("id").collect()}
    assert got >= set(range(-5000, 5000, 50)) and len(got) < 250


def test_prefixes_are_the_rarest_members(spark):
    rng = random.Random(4)
    sets = [rng.sample(range(-40, 40), rng.randrange(1, 30)) for _ in range(60)]
    df = {s: sum(s in x for x in sets) for s in range(-40, 40)}
    want = set()
    for k, x in enumerate(sets):
        common = sorted((df[s], s) for s in x if df[s] > 1)
        room = similarity.threshold_prefix(len(x)) - (len(x) - len(common))
        want |= {(k, s) for _, s in common[: max(0, room)]}
    frame = spark.createDataFrame(list(enumerate(sets)), "row long, set array<long>").repartition(3)
    got = [tuple(r) for r in similarity.prefixes(frame, "row", 0.8).collect()]
    assert len(got) == len(want) and set(got) == want


def test_enough_words_are_told_by_the_beginning_or_the_whole(spark, tmp_path):
    from lumenfold.plans.registry import QUERIES

    texts = ["a " * 39, "a " * 40, "b" * 500 + " c" * 39, "b" * 500 + " c" * 38, " " * 450 + "d " * 40, "e " * 39 + " " * 400, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = QUERIES["near_duplicate_components"](spark, str(tmp_path))
    got = {r["doc_id"]: r["comparable"] for r in query.collect()}
    assert [got[i] for i in range(len(texts))] == [False, True, True, False, True, False, False]
    assert "substring" in query._jdf.queryExecution().optimizedPlan().toString()

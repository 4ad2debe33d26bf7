import random
import time
from collections import Counter

import pyarrow as pa
import xxhash
from tests.llm.helpers import documents, frame, sentence

from lumenfold.llm import common, substring


def brute(docs, length=20):
    def place(d):
        key = xxhash.xxh64_intdigest(d[1] or "", 42)
        return (substring.NO_ID + (key & substring.NO_ID - 1) if d[0] is None else d[0]), key - (key >> 63 << 64)

    split = {(place(d), d[1]): [w for w in (d[1] or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for d in docs}
    first = {}
    for (doc, _), w in split.items():
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, ((1 << 63, 0), 0)), (doc, i))
    out = []
    for d in docs:
        w, gone = split[place(d), d[1]], set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (place(d), i):
                gone |= set(range(i, i + length))
        out.append((d[0], len(w), len(gone), None if d[1] is None else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def check(spark, docs):
    got = substring.without_repeats(frame(spark, docs), ["doc_id", "label"]).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_against_brute_force(spark):
    check(spark, documents())
    check(spark, documents(seed=9, n=150))


def test_null_and_repeated_ids(spark, monkeypatch):
    """Texts with a null id are documents of their own behind all others; other texts under one id are ordered by their hashes."""
    monkeypatch.setattr(substring, "HELD_WORDS", 300)
    monkeypatch.setattr(substring, "PACK_WORDS", 700)
    docs = documents(seed=5, n=40)
    check(spark, [((None, d[0], 7)[i % 3], *d[1:]) for i, d in enumerate(docs) if d[1]])


def test_periodic_texts_and_hot_passages(spark, monkeypatch):
    rng = random.Random(1)
    passage = sentence(rng, 60)
    docs = [(i, sentence(rng, 15) + " " + passage + " " + sentence(rng, 15), None, None, 0) for i in range(80)]
    docs += [(100, "a b " * 300, None, None, 0), (101, "b a " * 100, None, None, 0), (102, "x " * 500, None, None, 0), (103, "p q r " * 9, None, None, 0)]
    check(spark, docs)
    monkeypatch.setattr(substring, "HOT", 10)
    check(spark, docs)


def test_empty_and_without_repeats(spark):
    assert substring.without_repeats(frame(spark, []), ["doc_id"]).collect() == []
    rng = random.Random(2)
    check(spark, [(i, sentence(rng, 30), None, None, 0) for i in range(5)])


def test_automaton_finds_first_places():
    rng = random.Random(4)
    texts = [[rng.choice(b"abc").to_bytes(1, "big") for _ in range(60)] for _ in range(6)]
    automaton = substring.SuffixAutomaton()
    for k, w in enumerate(texts):
        for i, end in enumerate(automaton.matches(w, 4)):
            want = next(((d, j + 3) for d, x in enumerate(texts[:k]) for j in range(len(x) - 3) if x[j : j + 4] == w[i : i + 4]), None)
            assert end == want
        automaton.add(w, k, 0)


def test_copies_of_a_row_cost_in_proportion(spark):
    """Thousands of copies of one row under one id, and of one text with null ids, take no longer than so many rows."""
    rng = random.Random(11)
    text, other = sentence(rng, 300), sentence(rng, 60)
    rows = [(5, text, None, None, 0)] * 4000 + [(None, other + " " + text[:400], None, None, 0)] * 4000 + [(9, text + " tail", None, None, 0), (1, other, None, None, 0)]
    began = time.time()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.without_repeats(frame(spark, rows), ["doc_id"]).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert time.time() - began < 60
    want = {row for row in brute([rows[0], rows[4000], *rows[-2:]])}
    assert set(got) == want and got[next(w for w in want if w[0] == 5)] == 4000


def test_many_different_texts_under_one_id(spark):
    rng = random.Random(12)
    passage = sentence(rng, 40)
    check(spark, [(1, sentence(rng, 12) + " " + passage, None, None, 0) for _ in range(60)])


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    """Runs are given when they fill GIVEN_BYTES, not when a batch ends, and whole texts are made a few rows at a time."""
    monkeypatch.setattr(substring, "GIVEN_BYTES", 5000)
    firsts, spans, kept = substring._Firsts(20), set(), {}

    def given():
        for r in firsts.take().to_pylist():
            if r["anchor"] is None:
                spans.add((r["doc_id"], r["begin"], r["end"]))
            else:
                kept.setdefault(r["words"], []).append(r["doc_id"])

    for i in reversed(range(300)):
        firsts.add(1, i, 0, 0, b" ".join(b"%d" % (i % 7 + j) for j in range(25)))
        assert firsts.bytes < 6000
        if firsts.full():
            given()
    given()
    # Every document is still told of once, as a first or as a repeat, and a text's first stays one.
    assert sorted([d for d, _, _ in spans] + [d for x in kept.values() for d in x]) == list(range(300))
    assert sorted(min(x) for x in kept.values()) == list(range(7)) and all(b - a == 25 for _, a, b in spans)
    rows = common.map_batches(spark.range(1000).coalesce(1), lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"]), "n long", 256)
    assert [r["n"] for r in rows.collect()] == [256, 256, 256, 232]

import hashlib
import random
import re

import numpy as np
from tests.llm.helpers import WORDS, documents, frame, sentence

from lumenfold.llm import decontaminate, fmindex, langid

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1):
            if n:
                grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d in docs:
        w, hit, found = words(d[1]), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        ids = sorted(found)
        out.append((d[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_against_brute_force(spark):
    rng, docs = random.Random(5), documents()
    items = [(i, " ".join((d[1] or "").split()[3:40])) for i, d in enumerate(docs[:20])] + [(100, "Alpha, beta!"), (101, None), (102, "?!"), (103, "one"), (103, "one"), (104, sentence(rng, 30)), (105, "é"), (106, " ".join(WORDS))]
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.contamination(df, bench, ["doc_id", "label"])
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == brute(docs, items)
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"] for r in got.collect())
    parts = decontaminate.contamination(df, bench, ["doc_id"], part_bytes=1500, piece_words=20)
    assert sorted(tuple(r) for r in parts.select(*columns).collect()) == brute(docs, items)
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not r[5] for r in brute(docs, items))
    none = decontaminate.contamination(df, bench.where("false"), ["doc_id"])
    assert sorted(tuple(r) for r in none.select(*columns).collect()) == brute(docs, [])
    assert decontaminate.contamination(df.where("false"), bench, ["doc_id"]).collect() == []


def test_blocks_of_the_benchmark_give_the_same():
    docs = documents()
    items = [(i, (d[1] or "").encode()) for i, d in enumerate(docs[:15])]
    split = [decontaminate.words_of((d[1] or "").encode()) for d in docs]
    one, many = decontaminate.benchmark_blocks(items), decontaminate.benchmark_blocks(items, block_words=60)
    assert len(one) == 1 and len(many) > 5
    def pairs(blocks):
        return sorted({tuple(p) for b in blocks for p in decontaminate.search(b, split)[1].tolist()})
    assert pairs(one) == pairs(many)


def test_fm_index():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 400)
    index = fmindex.FMIndex(text, 6)
    for n in (1, 2, 4):
        patterns = np.array([text[i : i + n] for i in range(0, 390, 7)] + [[5] * n])
        low, high = index.ranges(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_the_index_is_small_and_whole():
    """A wavelet level is a bit and a share of a count for each word, with ranks at every place as counted."""
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5000, 200_000)
    wavelet = fmindex.Wavelet(values, 5000)
    assert sum(x.nbytes for level in wavelet.levels for x in level) < len(values) * wavelet.bits
    places = np.concatenate([[0, 1, 63, 64, 65, 127, 128, 199_999], rng.integers(0, 200_000, 200)])
    symbol, rank = wavelet.access_rank(places)
    assert (symbol == values[places]).all()
    for value in values[:5].tolist():
        ends = np.append(places, len(values))
        want = [int((values[:i] == value).sum()) for i in ends.tolist()]
        start = wavelet.rank(np.array([value]), np.array([0]))
        assert (wavelet.rank(np.full(len(ends), value), ends) - start == want).all()


def test_a_kept_text_goes_to_the_workers_once(spark):
    docs, bench = frame(spark, documents()), spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    frames = [decontaminate.clean(docs, bench), langid.predict(docs, ["en"], np.zeros((langid.BUCKETS, 1), np.float32), ["doc_id", "text"])]
    for df in frames:
        assert "as binary" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_of_neighbouring_and_long_runs():
    """Runs that end at documents' ends, slices of many texts, and a word outside the vocabulary between two hits."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(6)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n)).encode()) for k, n in enumerate((1, 2, 5, 13, 20, 40))]
    docs = [decontaminate.words_of(x) for x in (b"", *(t for _, t in items), b" ".join(t for _, t in items), items[3][1] + b" else " + items[3][1], b"else")]
    docs += [[rng.choice([*vocabulary, "else"]).encode() for _ in range(rng.randrange(60))] for _ in range(40)]
    (block,) = decontaminate.benchmark_blocks(items)
    spans, pairs = decontaminate.search(block, docs)
    parts = [decontaminate.runs_of(block, docs[i : i + 7], i) for i in range(0, len(docs), 7)]
    sliced = decontaminate.occurrences(block, parts)
    assert sliced[0] == spans and (sliced[1] == pairs).all()
    hits = {}
    for d, a, b in spans:
        hits.setdefault(d, set()).update(range(a, b))
    want = brute([(d, b" ".join(w).decode()) for d, w in enumerate(docs)], [(k, t.decode()) for k, t in items])
    assert [(d, len(hits.get(d, ()))) for d in range(len(docs))] == [(r[0], r[2]) for r in want]
    assert [int((pairs[:, 0] == d).sum()) for d in range(len(docs))] == [r[3] for r in want]

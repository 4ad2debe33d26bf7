import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, frame

from lumenfold.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = brown.Settings(classes=6, core_share=1 / 400, rounds=5)
END = b"\n"


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))]


def spelling(w):
    return zlib.crc32(w[-2:]) % 64


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


def plain_model(texts, s):
    """The model by dictionaries: a function of a text's words that gives its log10 probability."""
    k = s.classes + 1
    counts = Counter(w for t in texts for w in [*t, END])
    n, v = sum(counts.values()), len(counts)
    core = sorted((w for w in counts if w != END and counts[w] >= max(1, s.core_share * n)), key=lambda w: (-counts[w], w))
    number = {w: i for i, w in enumerate(core)}
    unit = lambda w: len(core) + 64 if w == END else number.get(w, len(core) + spelling(w))
    pairs = [(a, b) for t in texts for a, b in zip([END, *t], [*t, END])]
    bigrams = Counter((unit(a), unit(b)) for a, b in pairs)
    cls = {i: spelling(w) % s.classes for i, w in enumerate(core)} | {len(core) + g: g % s.classes for g in range(64)} | {len(core) + 64: s.classes}

    def table(cls):
        out = Counter()
        for (a, b), c in bigrams.items():
            out[cls[a], cls[b]] += c
        return out

    def likelihood(t):
        rows, cols = Counter(), Counter()
        for (a, b), c in t.items():
            rows[a] += c
            cols[b] += c
        return sum(map(xlogx, t.values())) - sum(map(xlogx, rows.values())) - sum(map(xlogx, cols.values()))

    def best(now, after, before, t):
        gains = []
        for c in range(s.classes):
            gain = 0.0
            for side, key in ((after, lambda c, o: (c, o)), (before, lambda c, o: (o, c))):
                for o, m in side.items():
                    there = max(0, t[key(c, o)] - (m if c == now else 0))
                    gain += xlogx(there + m) - xlogx(there)
                total = sum(side.values())
                mass = max(0, sum(t[key(c, o)] for o in range(k)) - (total if c == now else 0))
                gain -= xlogx(mass + total) - xlogx(mass)
            gains.append(gain)
        top = max(range(s.classes), key=lambda c: (gains[c], -c))
        return top if gains[top] > gains[now] + 1e-9 else now

    t, parts = table(cls), 2
    for r in range(s.rounds):
        moved = dict(cls)
        for u in {x for p in bigrams for x in p} - {len(core) + 64}:
            if (u * 2654435761 >> 16) % parts == r % parts:
                after, before = Counter(), Counter()
                for (a, b), c in bigrams.items():
                    if a == u:
                        after[cls[b]] += c
                    if b == u:
                        before[cls[a]] += c
                moved[u] = best(cls[u], after, before, t)
        after_round = table(moved)
        if likelihood(after_round) < likelihood(t):
            parts *= 2
        else:
            cls, t = moved, after_round
    around = defaultdict(lambda: (Counter(), Counter()))
    for a, b in pairs:
        if b != END and b not in number:
            around[b][1][cls[unit(a)]] += 1
        if a != END and a not in number:
            around[a][0][cls[unit(b)]] += 1
    own = {w: best(cls[unit(w)], *sides, t) for w, sides in around.items()}
    of = lambda w: own.get(w, cls[unit(w)])
    final = np.zeros((k, k))
    for a, b in pairs:
        final[cls[unit(a)] if b in own else of(a), of(b)] += 1
    sizes, once = np.zeros(k), np.zeros(k)
    for w, c in counts.items():
        sizes[of(w)] += c
        once[of(w)] += c == 1
    unknown = np.minimum((once + 0.01) / (sizes + 0.02), 0.5)
    moves = (final + 0.01) / (final.sum(1, keepdims=True) + 0.01 * k)

    def score(t):
        out = 0.0
        for a, b in zip([END, *t], [*t, END]):
            c, o = counts[b], of(b)
            emission = (1 - unknown[o]) * c / max(sizes[o], 1) if c else unknown[o]
            out += math.log10(s.mix * moves[of(a), o] * emission + (1 - s.mix) * (c + 0.5) / (n + 0.5 * (v + 1)))
        return out

    return score, own, core


@pytest.mark.parametrize("settings", [SMALL, brown.Settings(classes=3, core_share=1 / 60, rounds=3), brown.Settings(classes=4, rounds=2)])
def test_scores_equal_those_of_a_plain_model(spark, settings):
    docs = documents()
    learned = [words(d[1]) for d in docs if d[0] % 3 == 1]
    score, own, core = plain_model(learned, settings)
    assert core and (own or settings.core_share < 1e-3)
    got = brown.train_and_score(frame(spark, docs), F.col("doc_id") % 3 == 1, settings).collect()
    texts = {d[0]: d[1] for d in docs}
    assert len(got) == len(docs)
    for r in got:
        want = score(words(texts[r["doc_id"]]))
        assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))


def test_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(brown, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(brown, "SHARD_TOKENS", 300)
    docs = [*documents(), (None, "no id Alpha", "en", "s", 1)]
    df = frame(spark, docs)
    got = brown.train_and_score(df, F.col("doc_id") % 3 == 1, SMALL).collect()
    assert len(got) == len(docs)
    counts = Counter(w for d in docs if d[0] is not None and d[0] % 3 == 1 for w in [*words(d[1]), END])
    n, v = sum(counts.values()), len(counts)
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        tokens = [*words(texts[r["doc_id"]]), END]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(counts[w] > 0 for w in tokens) and r["train_tokens"] == n
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0


def test_probabilities_add_up_to_one(spark):
    docs = frame(spark, documents()).select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(True).alias("training"))
    model, others, _ = brown.train(docs, SMALL)
    rows = [(r["c"], r["cls"]) for r in others.collect()]
    core = [(c, model.classes[u]) for u, c in enumerate(model.counts) if u < model.units.core or u == model.units.end]
    c, own = (np.array(x) for x in zip(*rows, *core))
    assert c.sum() == model.tokens and len(c) == model.types
    for before in range(len(model.sizes)):
        known = model.probability(c, np.full(len(c), before), own).sum()
        unknown = (model.mix * model.moves[before] * model.unknown).sum() + (1 - model.mix) * model.base(np.zeros(1))[0]
        assert abs(known + unknown - 1) < 0.02


def test_better_than_the_base_on_class_language(spark):
    rng = random.Random(3)
    groups = [[f"{a}{i}" for i in range(20)] for a in ("dog", "runs", "fast")]
    texts = [" ".join(rng.choice(groups[i % 3]) for i in range(60)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = brown.train_and_score(df, F.col("doc_id") % 5 != 1, SMALL).where("doc_id % 5 = 1").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"] * 0.8


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = frame(spark, documents())
    for r in brown.train_and_score(df, F.lit(False), SMALL).collect():
        assert r["n_known"] == 0 and r["train_tokens"] == 0 and abs(r["score"] - r["base_score"]) < 1e-9
    assert brown.train_and_score(df.where("false"), F.lit(True), SMALL).collect() == []

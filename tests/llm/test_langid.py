import math
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.llm.helpers import documents, frame

from lumenfold.llm import langid
from lumenfold.llm.common import held_out, table


def test_held_out_accuracy_and_mixtures(spark):
    docs = table(spark, SF, "documents")
    languages, model = langid.train(docs, ~held_out("doc_id", 4, 2))
    got = langid.predict(docs, languages, model, ["doc_id", "lang"]).where(held_out("doc_id", 4, 2)).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(m["share"] for m in r["mixture"]) - 1) < 1e-6 for r in got)
    halves = [docs.where(F.col("lang") == x).orderBy(F.desc("n_chars")).first()["text"] for x in ("en", "de")]
    mixed = " ".join(" ".join(t.split()[:150]) for t in halves)
    r = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), languages, model, ["doc_id"]).first()
    shares = {m["language"]: m["share"] for m in r["mixture"]}
    assert {"en", "de"} <= set(shares) and abs(shares["en"] - 0.5) < 0.2


def test_awkward_rows(spark):
    docs = frame(spark, documents())
    languages, model = langid.train(docs, F.lit(True))
    assert languages == ["en", "fr"]
    got = langid.predict(docs, languages, model, ["doc_id", "text", "label"]).collect()
    assert len(got) == len(documents())
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in languages) == lettered and (lettered or r["score"] == 0)
    empty = langid.train(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, *empty, ["doc_id"]).collect()} == {"und"}


def test_em_finds_the_shares():
    rng = np.random.default_rng(0)
    like = np.log(np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05]]))
    shares, chosen = langid.mixture(like, np.array([700.0, 300.0]))
    assert list(chosen) == [0, 1] and abs(shares[0] - 0.7) < 0.05 and rng is not None


def plain_answers(learned, texts):
    """Language and share by counting in dictionaries, then EM for every set of languages; the set with the best penalised likelihood wins."""

    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        return [w for w in low.encode().split() if any(c.isalpha() for c in w.decode())]

    def places(word):
        w = b" " + word + b" "
        return [((w[i] << 16 | w[i + 1] << 8 | w[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(w) - 2)]

    languages = sorted({x for x, _ in learned})
    counts = {x: Counter() for x in languages}
    for x, text in learned:
        for w in words(text):
            counts[x].update(places(w))
    total = {x: sum(c.values()) + 0.1 * 65536 for x, c in counts.items()}
    out = []
    for text in texts:
        seen = Counter(words(text))
        n = np.array(list(seen.values()), float)
        like = np.array([[sum(math.log((counts[x][g] + 0.1) / total[x]) for g in places(w)) for x in languages] for w in seen])
        top = like.max(1, keepdims=True)
        best = (-math.inf, None)
        for size in range(1, len(languages) + 1):
            for chosen in combinations(range(len(languages)), size):
                p, share = np.exp(like[:, chosen] - top), np.full(size, 1 / size)
                for _ in range(300):
                    r = p * share
                    share = n @ (r / np.maximum(r.sum(1, keepdims=True), 1e-300)) / n.sum()
                value = n @ (np.log(np.maximum(p @ share, 1e-300)) + top[:, 0]) - 0.5 * math.log(n.sum()) * (size - 1)
                if value > best[0] + 1e-6:
                    best = (value, (languages[chosen[int(np.argmax(share))]], share.max()))
        out.append(best[1])
    return out


def test_answers_are_those_of_a_plain_model(spark):
    docs = table(spark, SF, "documents").where("text is not null")
    languages, model = langid.train(docs, ~held_out("doc_id", 4, 2))
    learned = [(r["lang"], r["text"]) for r in docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull()).collect()]
    new = [r["text"] for r in docs.where(held_out("doc_id", 4, 2)).orderBy("doc_id").collect()]
    new = [t for t in new if 0 < len(t) < 4000 and any(c.isalpha() for c in t)][:40]
    new += [" ".join(a.split()[:90] + b.split()[: 10 * k]) for k, (a, b) in enumerate(zip(new, new[7:]), 1)]
    got = langid.predict(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), languages, model, ["doc_id"]).collect()
    want = plain_answers(learned, new)
    off = [(r["doc_id"], r["lang_pred"], r["score"], want[r["doc_id"]]) for r in got if r["lang_pred"] != want[r["doc_id"]][0] or abs(r["score"] - want[r["doc_id"]][1]) > 0.02]
    assert len(got) == len(new) and not off, off

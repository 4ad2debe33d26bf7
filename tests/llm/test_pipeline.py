import hashlib
import random
import re

import corpus_pipeline
from tests.conftest import SF
from tests.llm.helpers import documents, frame
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute_fp
from tests.llm.test_substring import brute as repeats

from lumenfold.llm.common import table, written


def test_stages_do_what_their_operators_say(spark):
    rows, bench = documents(n=40), [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [(*r[:4], len(r[1] or "")) for r in rows] + [(5000, bench[0][1], "en", "s", 1)]
    docs = frame(spark, rows, extra=False)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    take = lambda name: [tuple(r) for r in seen[name].select("doc_id", "text").collect()]
    lettered = sorted((r[0], r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert sorted(take("simhash_near_dedup")) == lettered
    inputs = [tuple(r) for r in seen["simhash_near_dedup"].collect()]
    assert sorted((tuple(r) for r in seen["substring_dedup"].collect()), key=repr) == sorted(brute_near(inputs), key=repr)
    left = {(d, k) if n else None for d, _, n, k in repeats(take("substring_dedup"))}
    assert {x for x in left if x} <= set(take("benchmark_decontamination"))
    clean = {r[0] for r in contaminated(take("benchmark_decontamination"), bench) if not r[5]}
    assert 5000 not in clean and {r["doc_id"] for r in docs.collect()} == clean


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    """One row of each group: rows are documents' columns; linked by fingerprints of 3 bits, five-word similarity of 0.8, or equal texts."""
    texts = sorted({r[1] or "" for r in rows})
    sets, fps = [shingles(t) for t in texts], [brute_fp(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if bin(fps[i] ^ fps[j]).count("1") <= 3 or a and b and len(a & b) >= 0.8 * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for r in rows:
        groups.setdefault(top(texts.index(r[1] or "")), []).append(r)
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    low = lambda x: (x is not None, x)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0, md5(r[1]), low(r[2]), low(r[3]), low(r[4]))) for g in groups.values()]


def test_near_copies_beyond_the_fingerprints_distance_go(spark):
    """Copies with a few words changed: five-word similarity of 0.8, fingerprints further apart than op10's 3 bits."""
    rng = random.Random(5)
    texts = []
    for n in (60, 150, 400, 1000):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            copy = list(base)
            for at in rng.sample(range(n), max(1, n // 60)):
                copy[at] = f"x{rng.randrange(5000)}"
            texts += [" ".join(base), " ".join(copy)]
    texts += ["short one here", "Short one, here", "another short one"]
    shingled = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(r"\w+", t.lower()) for t in texts)]
    near = lambda i, j: len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j])
    want = {i for i in range(len(texts)) if not any(near(i, j) for j in range(i))}
    far = [i for i in range(len(texts)) if i not in want and bin(brute_fp(texts[i]) ^ brute_fp(texts[i - 1])).count("1") > 3]
    assert len(far) > 5
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)], extra=False)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_repeated_rows_and_null_ids(spark):
    """Of repeated rows one is left, null ids lose against others, and each text under a common id is judged by itself."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(50)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] * 2
    rows += [(None, texts[k], "en", "s", 7) for k in (0, 0, 1)] + [(None, " ".join(f"n{i}" for i in range(30)), None, None, None)] * 3
    rows += [(3, texts[4] + " tail", "en", "s", 1), (5, "another text under the same id five", "en", "s", 1), (4, texts[4], "de", "s", 1), (20, None, "en", "s", None), (21, "", "en", "s", 0)]
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows, extra=False), SF).collect()]
    assert sorted(got, key=repr) == sorted(brute_near(rows), key=repr)
    assert len(got) == len(set(got)) == 15 and (3, texts[4] + " tail", "en", "s", 1) in got and (4, texts[4], "en", "s", len(texts[4])) not in got

"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Extra columns whose names operators use inside.
CLASH = "size int, text_crc32 string, shard int, label int, n long, key string, component string, word string, kept string, spans string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", str(rng.randrange(40))]) for _ in range(n))


def documents(seed=0, n=60):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = sentence(rng, 45)
    for i in range(0, n, 4):
        w = texts[i].split()
        texts[i] = " ".join(w[: len(w) // 2] + passage.split()[rng.randrange(10) :] + w[len(w) // 2 :])
    texts += texts[:8] + [texts[3] + " tail", "Alpha\tBETA\n\ngamma  " + texts[5], "one two " * 60, "", "   \n", None, "é", "!!! 123 ---", sentence(rng, 3000)]
    rows = [(i * 3 + 1, x, ["en", "fr", None][i % 3], f"s{i % 3}", len(x or "")) for i, x in enumerate(texts)]
    rows.append(rows[2])
    rows.append(rows[9])
    return rows


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "k", "c", "w", "t", "s") for r in rows], DOCS)

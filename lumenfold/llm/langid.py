"""Multilingual mixture inference: which languages a text mixes, and in what shares.

Each language has smoothed counts of hashed byte trigrams of its words (with their borders). A document's words are
draws from a mixture of the languages; expectation-maximisation finds the shares. Languages are dropped one by one
from the set while the likelihood, less half the log of the number of words for each further language, improves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import LOWER, bytes_of, map_batches, text_bytes, with_text

#: Hashed trigrams; a model has this many counts a language.
BUCKETS = 1 << 16
#: Places of the hash that chooses training documents: so many that a share is never rounded to nothing.
HASHES = 10**15
#: Words that a task remembers the likelihoods of.
CACHED_WORDS = 200_000
UNDETERMINED = "und"


def _has_letter(word: bytes) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word.decode("utf-8", "ignore"))


def word_trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, each between two spaces, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(n) - n
    code = ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    keep = np.ones(len(data), bool)
    keep[begin + n - 1] = keep[begin + n - 2] = False  # trigrams that reach into the next word
    first = np.cumsum(keep)[begin] - 1
    return code[keep[: len(code)]], first


def train(docs: DataFrame, usable: Column, docs_per_language: int = 2000, max_languages: int = 256, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (BUCKETS, languages).

    Learns from rows where ``usable`` holds and text and language are not null: about ``docs_per_language`` of
    each language, chosen by a hash of the id and text. The counts that reach the driver are bounded by
    BUCKETS x ``max_languages``; more languages than that raise an error."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, docs_per_language / n) * HASHES)).cast("long"))])
    sample = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(HASHES)) < share[F.col("lang")])
    place = {k: i for i, k in enumerate(languages)}

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.zeros((len(languages), BUCKETS), np.int64)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in text.translate(LOWER).split() if _has_letter(w)]
                if words:
                    counts[place[lang]] += np.bincount(word_trigrams(words)[0], minlength=BUCKETS)
            k, b = np.nonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[k, b])], names=["k", "b", "n"])

        return one

    rows = map_batches(sample.select("lang", text_bytes()), make, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(languages)), 0.1)
    counts[rows["b"].to_numpy(int), rows["k"].to_numpy(int)] += rows["n"].to_numpy(float)
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def mixture(like: np.ndarray, counts: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the chosen languages (0 for the rest) of a document, and the chosen set.

    like: log-likelihoods (words, languages); counts: of each word."""
    total = counts.sum()
    p = np.exp(np.maximum(like - like.max(1, keepdims=True), -60.0))
    single = counts @ like
    best = int(np.argmax(single))
    # The likelihood is concave in the shares: with no language gaining at this corner, it is the maximum.
    with np.errstate(over="ignore"):
        gain = counts @ np.exp(np.minimum(like - like[:, best : best + 1], 80.0))
    shares = np.zeros(like.shape[1])
    shares[best] = 1.0
    chosen = np.array([best])
    candidates = np.flatnonzero(gain > total * (1 + 1e-9))
    if not len(candidates):
        return shares, chosen

    def fit(members: np.ndarray) -> tuple[np.ndarray, float]:
        q, pi = p[:, members], np.full(len(members), 1.0 / len(members))
        for _ in range(rounds):
            r = q * pi
            new = counts @ (r / np.maximum(r.sum(1, keepdims=True), 1e-300)) / total
            if np.abs(new - pi).max() < 1e-4:
                pi = new
                break
            pi = new
        return pi, float(counts @ np.log(np.maximum(q @ pi, 1e-300)))

    penalty = 0.5 * np.log(total)
    members = np.union1d(candidates, chosen)
    pi, value = fit(members)
    while len(members) > 1:
        fewer = np.delete(members, np.argmin(pi))
        next_pi, next_value = fit(fewer)
        if next_value + penalty < value:
            break
        members, pi, value = fewer, next_pi, next_value
    shares[:] = 0
    shares[members] = pi / pi.sum()
    return shares, members


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, then lang_pred, score (its share) and mixture (language, share).

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned. Ties go to the first language in
    alphabetical order. Whole texts are read; the same text always gets the same answer. The model is broadcast:
    BUCKETS x languages floats."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = np.array(languages, object)
    sent, place = with_text(docs, keep, text_col)
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.list_(pa.struct([("language", pa.string()), ("share", pa.float64())])))])

    def make():
        table, index = held.value, {}
        rows = np.zeros((1 << 12, max(1, len(names))), np.float32)

        def learn(words: list[bytes]) -> None:
            nonlocal rows
            lettered = [w for w in words if _has_letter(w)]
            for w in words:
                index[w] = -1
            if not lettered:
                return
            codes, first = word_trigrams(lettered)
            like = np.add.reduceat(table[codes], first, axis=0)
            at = index["n"]
            while at + len(lettered) > len(rows):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            rows[at : at + len(lettered)] = like
            for i, w in enumerate(lettered, at):
                index[w] = i
            index["n"] = at + len(lettered)

        index["n"] = 0

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = batch.column(place), []
            for at in range(0, batch.num_rows, 64):
                if index["n"] > CACHED_WORDS:
                    index.clear()
                    index["n"] = 0
                split = [(t or b"").translate(LOWER).split() for t in bytes_of(texts.slice(at, 64))]
                missing = list(dict.fromkeys(w for words in split for w in words if w not in index))
                if missing and len(names):
                    learn(missing)
                for words in split:
                    known = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
                    known = known[known >= 0]
                    if not len(known) or not len(names):
                        out.append((UNDETERMINED, 0.0, []))
                        continue
                    ids, counts = np.unique(known, return_counts=True)
                    shares, chosen = mixture(rows[ids].astype(float), counts.astype(float))
                    k = int(np.argmax(shares))
                    out.append((names[k], min(1.0, float(shares[k])), [{"language": names[j], "share": float(shares[j])} for j in chosen]))
            kept = [batch.column(i) for i in range(len(keep))]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(zip(*out), schema))], names=[*keep, *schema.names])

        return one

    kept = docs.select(*keep)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return map_batches(docs.select(*sent), make, f"{columns}, lang_pred string, score double, mixture array<struct<language:string,share:double>>")

"""Near-duplicates by Jaccard similarity of word shingles, exactly, without pairs.

Documents with equal shingle sets are one class. A class's prefix are its rarest shingles, so many that two classes at the threshold
must share one (of n shingles, n - ceil(threshold * n) + 1). Classes that prefixes connect form a cluster; all similar
pairs lie inside clusters. A cluster of any size is compared in pairs of blocks, each a small task that multiplies 0/1 matrices of
the shingles its rows share, and returns link counts and a spanning forest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import tokens
from lumenfold.operators.groups import block_pairs, bucket_lists, by_bucket, connected_components, forest, gathered, hot_keys, in_buckets, join_facts, lean, map_groups, written
from lumenfold.operators.words import mixed, sequence_hashes, text_hashes

SHINGLE, THRESHOLD, MIN_TOKENS = 5, 0.8, 40
#: Eighths of the hash space in which sets without a partner are told before any set is kept. Any value gives the same links.
PART = 3
#: Texts and sets that a task remembers having given.
SEEN = 1 << 18
#: Words of 64 bits (as a power of two) of the table that tells which texts may be among given ones.
MASK_BITS = 17


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct hashes of k consecutive words; fewer words are one shingle, none an empty set."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(*(F.get(words, (i + j - 1).cast("int")) for j in range(k))))
    return F.when(n > k, F.array_distinct(many)).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def jaccard(a: Column, b: Column) -> Column:
    """0 where a set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's number of words (lower-cased runs of letters and digits), and the sorted distinct hashes of ``size`` consecutive ones.

    Fewer words are one shingle, none an empty set."""
    hashes, counts = text_hashes([(text or "").lower() for text in texts])
    many = sequence_hashes(hashes, size) if len(hashes) >= size else hashes[:0]
    sets = []
    for n, end in zip(counts.tolist(), np.cumsum(counts).tolist()):
        if n < size:
            grams = sequence_hashes(hashes[end - n : end], n) + np.uint64(size - n) if n else hashes[:0]
        else:
            grams = np.sort(many[end - n : end - size + 1])
            grams = grams[np.append(True, grams[1:] != grams[:-1])]
        sets.append(grams.view(np.int64))
    return counts, sets


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


def _owners(s: np.ndarray, k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles, with the smallest and the largest text that has each, and the size of such a text's set."""
    order = np.argsort(s)
    s, k, n = s[order], k[order], n[order]
    at = _runs(s)
    return s[at], np.minimum.reduceat(k, at), np.maximum.reduceat(k, at), n[at]


def _summed(k: np.ndarray, own: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(k)
    k, own, n = k[order], own[order], n[order]
    at = _runs(k)
    return k[at], np.add.reduceat(own, at), n[at]


def _alone(texts: DataFrame, threshold: float, size: int, min_tokens: int) -> DataFrame:
    """Hashes k of texts that can only be similar to exact copies of themselves.

    A set with a partner has at most (1 - threshold) of its shingles for itself, so no more than that in a part of the hash space either.
    Shingles meet in buckets of their hashes, then the texts' own ones are counted in buckets of texts."""
    shingle, text = {"s": "bigint", "k": "bigint", "n": "int"}, {"k": "bigint", "own": "int", "n": "int"}

    def parts(batches):
        seen = set()
        for batch in batches:
            if len(seen) > SEEN:
                seen.clear()
            for low in range(0, batch.num_rows, 256):
                new = {}
                for k, text in zip(batch.column(0).slice(low, 256).to_pylist(), batch.column(1).slice(low, 256).to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        new[k] = text
                for k, n_words, grams in zip(new, *shingle_sets(list(new.values()), size)):
                    if n_words >= min_tokens:
                        own = grams[grams & 7 < PART]
                        yield own, np.full(len(own), k), np.full(len(own), len(grams), np.int32)

    def spread(batches):
        for s, low, high, n in (_owners(*x) for x in gathered(parts(batches))):
            times = 1 + (low != high)  # of a shingle that several texts have, two go on
            k, s = np.repeat(low, times), np.repeat(s, times)
            k[np.cumsum(times) - 1] = high
            yield s, s, k, np.repeat(n, times)

    def owned(batches):
        def counts():
            for _, low, high, n in (_owners(*x) for x in in_buckets(batches, shingle)):
                mine = low == high
                yield low[mine], np.ones(mine.sum(), np.int32), n[mine]

        for k, own, n in (_summed(*x) for x in gathered(counts())):
            yield mixed(k.view(np.uint64)), k, own.astype(np.int32), n

    def told(batches):
        for k, own, n in (_summed(*x) for x in in_buckets(batches, text)):
            yield pa.RecordBatch.from_arrays([pa.array(k[own > n - np.ceil(n * threshold - 1e-9)])], names=["k"])

    dealt = by_bucket(bucket_lists(texts.select("k", "text"), spread, shingle))
    return by_bucket(bucket_lists(dealt, owned, text)).mapInArrow(lean(told), "k long")


def _likely(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``texts`` whose k may be among ``keys``: a bit table of at most 1 MB is broadcast, so that few others are dealt by key. An exact join decides."""
    word, bit = F.shiftrightunsigned("k", 6).bitwiseAND(F.lit((1 << MASK_BITS) - 1)), F.col("k").bitwiseAND(F.lit(63)).cast("int")
    table = keys.groupBy(word.alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(k & 63 AS int)))").alias("_bits"))
    return texts.join(F.broadcast(table), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


def _keyed_sets(texts: DataFrame, size: int, id_type: str) -> DataFrame:
    """(id, n_words, key, set) of columns id, text: equal sets have equal keys, and a task gives each set once (null again)."""

    def run(batches):
        seen = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, rows = batch.slice(low, 256), []
                if len(seen) > SEEN:
                    seen.clear()
                for n_words, grams in zip(*shingle_sets(part.column(1).to_pylist(), size)):
                    key = hashlib.sha256(grams.tobytes()).hexdigest()
                    rows.append((n_words, key, None if key in seen else grams))
                    seen.add(key)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.list_(pa.int64()))))], names=["id", "n_words", "key", "set"])

    return texts.select("id", "text").mapInArrow(lean(run), f"id {id_type}, n_words int, key string, set array<long>")


def overlaps(sets: np.ndarray, a: np.ndarray, b: np.ndarray, slice_size: int = 8192) -> np.ndarray:
    """How many members each of the sets at places ``a`` shares with each of those at ``b``, by products of 0/1 matrices of the members that several have."""
    size = np.array([len(x) for x in sets])
    flat, row = np.concatenate(list(sets)), np.repeat(np.arange(len(size)), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[code] > 1
    _, code = np.unique(code[keep], return_inverse=True)
    row, both = row[keep], np.zeros((len(a), len(b)), np.float32)
    at_a, at_b = np.full(len(size), -1), np.full(len(size), -1)
    at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
    for low in range(0, int(code.max()) + 1 if len(code) else 0, slice_size):
        part = (code >= low) & (code < low + slice_size)
        left, right = np.zeros((len(a), slice_size), np.float32), np.zeros((len(b), slice_size), np.float32)
        r, c = row[part], code[part] - low
        left[at_a[r][at_a[r] >= 0], c[at_a[r] >= 0]] = 1
        right[at_b[r][at_b[r] >= 0], c[at_b[r] >= 0]] = 1
        both += left @ right.T
    return both


def prefixes(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, s): of each set (columns key, a long without repeats, and set, not null) its rarest members, so many that two sets at the threshold share one; members that no other set has fill them first.

    Members meet in buckets of their hashes, where those of one set are left out, then in buckets of their sets."""
    member, common = {"s": "bigint", "k": "bigint", "n": "int"}, {"s": "bigint", "k": "bigint", "n": "int", "df": "int"}

    def parts(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                k, s = (c.slice(low, 256) for c in batch.columns)
                n = s.value_lengths().to_numpy()
                yield mixed(s.flatten().to_numpy().view(np.uint64)), s.flatten().to_numpy(), np.repeat(k.to_numpy(), n), np.repeat(n, n)

    def shared(batches):
        for s, k, n in in_buckets(batches, member):
            order = np.argsort(s)
            s, k, n = s[order], k[order], n[order]
            df = np.diff(np.append(_runs(s), len(s)))
            df = np.repeat(df, df).astype(np.int32)
            keep = df > 1
            yield mixed(k[keep].view(np.uint64)), s[keep], k[keep], n[keep], df[keep]

    def first(batches):
        for s, k, n, df in in_buckets(batches, common):
            order = np.lexsort((s, df, k))
            s, k, n = s[order], k[order], n[order]
            at = _runs(k)
            several = np.diff(np.append(at, len(k)))
            room = n[at] - np.ceil(n[at] * threshold - 1e-9) + 1 - (n[at] - several)
            keep = np.arange(len(k)) - np.repeat(at, several) < np.repeat(room, several)
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(s[keep])], names=[key, "s"])

    dealt = by_bucket(bucket_lists(sets.select(key, "set"), lambda batches: gathered(parts(batches)), member))
    return by_bucket(bucket_lists(dealt, lambda batches: gathered(shared(batches)), common)).mapInArrow(lean(first), f"{key} long, s long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, min_tokens: int = MIN_TOKENS, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_links, group_id): documents linked directly, and the smallest id that links reach, itself included.

    Texts of fewer than ``min_tokens`` words, and those without any word, link with nothing. Repeated rows are documents of their own."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("k"))
    # Most texts are alone: the others are the smaller list, and only they are read again; of a text with very many copies, one.
    alone = written(_alone(texts, threshold, k, min_tokens).withColumn("alone", F.lit(True)), "alone")
    counts = written(hot_keys(texts.groupBy("k").agg(F.count("*").alias("n"))), "counts")
    marked = written(counts.join(alone, "k", "left").select("k", "n", "hot", F.coalesce("alone", F.lit(False)).alias("alone")), "marked")
    hot, rest = marked.where("hot"), marked.where("not hot and not alone").select("k")  # hot: at most HOT_SHARE rows
    cold = texts.join(F.broadcast(hot.select("k")), "k", "left_anti")
    copy_key = F.concat(F.lit("copy "), F.sha2("text", 256))
    copies = cold.select("id", "k", copy_key.alias("key")).join(rest, "k", "left_anti").select("id", "key")
    one = texts.join(F.broadcast(hot.where("not alone").select("k", "n")), "k").groupBy("k").agg(F.any_value("text").alias("text"), F.max("n").alias("n"))
    hot_sets = written(_keyed_sets(one.select(F.struct("k", "n").alias("id"), "text"), k, "struct<k:bigint,n:bigint>"), "hot-sets")
    sets = written(_keyed_sets(_likely(cold, rest).join(rest, "k", "left_semi"), k, docs.schema[id_col].dataType.simpleString()), "sets")
    comparable = (F.col("n_words") >= min_tokens) & (F.col("n_words") > 0)
    hot_known = hot_sets.select("id.k", F.when(comparable, F.col("key")).alias("key"))
    hot_rows = texts.select("id", "k", copy_key.alias("copy")).join(F.broadcast(hot.select("k", "alone")), "k").join(F.broadcast(hot_known), "k", "left").select("id", F.when(F.col("alone"), F.col("copy")).otherwise(F.col("key")).alias("key"))
    ids = written(sets.select("id", F.when(comparable, F.col("key")).alias("key")).unionByName(copies).unionByName(hot_rows), "ids")
    both = sets.where(comparable).select("key", "set", F.lit(1).cast("long").alias("n")).unionByName(hot_sets.where(comparable).select("key", "set", F.col("id.n").alias("n")))
    classes = written(both.groupBy("key").agg(F.any_value("set", True).alias("set"), F.sum("n").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")

    prefix = written(prefixes(classes.select("cls", "set"), "cls", threshold), "prefixes")
    hubs = prefix.groupBy("s").agg(F.min("cls").alias("hub"), F.count("*").alias("n")).where("n > 1")
    clusters = connected_components(prefix.join(hubs, "s").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    members = written(classes.select("cls", "n", "set").join(clusters.select(F.col("id").alias("cls"), F.col("component").alias("cluster")), "cls"), "members")

    def one(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        first = group["block_a"][0]
        same = bool(group["block_b"][0] == first)
        a = np.flatnonzero(group["block"] == first)
        b = a if same else np.flatnonzero(group["block"] != first)
        if not len(a) or not len(b):
            return None
        size = np.array([len(x) for x in group["set"]])
        both = overlaps(group["set"], a, b)
        near = both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9
        if same:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            return None
        n, cls = group["n"].astype(np.int64), group["cls"].astype(np.int64)
        links = np.zeros(len(n), np.int64)
        np.add.at(links, a[i], n[b[j]])
        if not same:
            np.add.at(links, b[j], n[a[i]])
        linked, place = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
        adjacent = np.eye(len(linked), dtype=bool)
        adjacent[place[: len(i)], place[len(i) :]] = adjacent[place[len(i) :], place[: len(i)]] = True
        label = forest(len(linked), adjacent)
        return pa.RecordBatch.from_arrays([pa.array(cls[linked]), pa.array(cls[linked[label]]), pa.array(links[linked])], names=["a", "b", "links"])

    tiles = block_pairs(members, ["cluster"], block, F.col("cls")).select("cluster", "block_a", "block_b", "block", "cls", "n", "set")
    found = written(map_groups(tiles, ["cluster", "block_a", "block_b"], one, "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    reached = connected_components(found.select("a", "b")).withColumnRenamed("id", "cls")
    linked = classes.select("cls", "key").join(links, "cls").join(reached, "cls").select("key", "links", "component")
    known = ids.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(linked, "key", "left")
    smallest = known.where("component is not null").groupBy("component").agg(F.min("first").alias("smallest"))
    answers = known.join(smallest, "component", "left").select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("group_id"))
    done = join_facts(ids.where("key is not null"), hot_keys(written(answers, "answers")).drop("n"), "key").select("id", "n_links", "group_id")
    short = ids.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("group_id"))
    return done.unionByName(short)


def compared(pairs: DataFrame, docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each given pair (columns a, b): exact, not_comparable, probable or distinct, with the similarity and its confidence."""
    from lumenfold.functions.text import similarity_confidence

    words = written(docs.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("h"), tokens(F.col(text_col)).alias("w")), "words")
    sets = written(words.select("id", "h", (F.size("w") >= MIN_TOKENS).alias("enough"), shingles(F.col("w")).alias("set")), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.struct("h", "enough", "set").alias(f"_{x}"))
    joined = pairs.join(side(a), a).join(side(b), b)
    scored = joined.withColumn("similarity", F.round(jaccard(F.col(f"_{a}.set"), F.col(f"_{b}.set")), 6))
    verdict = F.when(F.col(f"_{a}.h") == F.col(f"_{b}.h"), "exact").when(~(F.col(f"_{a}.enough") & F.col(f"_{b}.enough")), "not_comparable").when(F.col("similarity") >= 0.65, "probable").otherwise("distinct")
    return scored.select(a, b, verdict.alias("verdict"), "similarity", F.when(verdict == "probable", similarity_confidence(F.col("similarity"))).alias("confidence"))


def threshold_prefix(n: int, threshold: float = THRESHOLD) -> int:
    """Length of the prefix of a set of n shingles."""
    return n - math.ceil(n * threshold - 1e-9) + 1

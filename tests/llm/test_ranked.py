import math
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import documents, frame
from tests.oracle import connection, differences

from lumenfold.llm import queries, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, bag in bags:
            m = 100 - 50 + 50 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(out):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out.collect()), key=str)


@pytest.mark.parametrize(("k", "block", "first"), [(50, ranked.ITEM_BYTES, 64), (3, ranked.ITEM_BYTES, 2), (5, 300, 4)])
def test_equal_to_brute_force(spark, k, block, first):
    docs = documents(n=150)
    docs += [(None, docs[7][1], "en", "s", 1), (5000, "ALPHA Beta-gamma_delta naïve\x7fÉtoile", "en", "s", 1)] + [docs[11]] * 30
    items = [(i, docs[i * 3][1]) for i in range(20)] + [(3, docs[9][1]), (100, None), (101, ""), (102, "no such words 0x0"), (103, "Naïve ALPHA"), (None, "beta gamma"), (104, "the " * 5 + "omega"), (103, "psi")]
    benchmark = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item long, score long")
    out = ranked.ranked_search(frame(spark, docs).repartition(3), benchmark, k, block_bytes=block, first=first)
    assert found(out) == plain([(d[0], d[1]) for d in docs], [(i, t) for i, t in items if t is not None], k)


def test_other_id_types(spark):
    docs = [(f"d{i:03}", d[1]) for i, d in enumerate(documents(n=30))] + [(None, "alpha beta")]
    out = ranked.ranked_search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("x", "alpha beta")], "item_id string, text string"), 7)
    got = [(r["rank"], r["doc_id"]) for r in out.orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(1, 8))


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert found(ranked.ranked_search(frame(spark, []), items)) == []
    assert found(ranked.ranked_search(frame(spark, documents()), items.limit(0))) == []


def test_trees_prune_without_loss():
    """Far fewer documents are scored than there are, and the best are those of the full product."""
    rng = np.random.default_rng(5)
    n_docs, n_terms, k = 4000, 300, 5
    row = np.repeat(np.arange(n_docs), 12)
    term = np.concatenate([np.sort(rng.choice(n_terms, 12, replace=False, p=(p := 1 / np.arange(1, n_terms + 1)) / p.sum())) for _ in range(n_docs)])
    value = rng.integers(1, 1_000_000, len(row))
    weights = (1000 * np.log(np.arange(2, n_terms + 2))).astype(np.int64)
    items = [np.sort(rng.choice(n_terms, 6, replace=False)) for _ in range(40)] + [np.zeros(0, np.int64)]
    search = ranked.Search(ranked.item_tree(items, weights), items, weights, np.zeros(len(items), np.int64), k)
    for low in range(0, n_docs, 1000):
        part = (row >= low) & (row < low + 1000)
        search.add(ranked.DocumentTree(row[part] - low, term[part], value[part], weights, 1000), list(range(low, low + 1000)))
    full = np.zeros((n_docs, n_terms), np.int64)
    full[row, term] = value
    for item, best in zip(items, search.best):
        scores = full[:, item] @ weights[item]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if s > 0)[:k]
        assert [(s, i) for s, _, i in best] == want
    assert search.scored < 0.5 * n_docs * len(items)


def test_long_texts_are_read_in_slices():
    text = b"Alpha " * 600_000
    assert sum(map(len, ranked.words_of(text))) == 600_000


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    a, b, wrong = differences(queries.op12_ranked_search(spark, sf), connection(sf), queries.SQL["op12_ranked_search"])
    assert a == b and not wrong

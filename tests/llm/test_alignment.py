import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tests.llm.helpers import documents, frame
from tokenizers import Tokenizer

from lumenfold.llm import alignment, queries

A, RANKS, B = map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
AWKWARD = ["a▁b", "日本語のテキスト 😀😀", "<|endoftext|> <s> </s>", "\u0000 nul", "  two  spaces \n\n", "é" * 900 + " " * 900, "x" * 5000, "𝔘𝔫𝔦‍code﻿", "don't I'll 1234567.89", "<0x41> ▁"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.ByteTokens(A, RANKS, public_tokenizers.PATTERN), alignment.PieceTokens(B))


def plain(texts):
    """Every row's columns, by loops over offsets."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    decode = alignment.ByteTokens(A).bytes
    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = tokenizer.encode(whole.decode(), add_special_tokens=False).ids if text else []
        ids_b = model.encode(text) if text else []
        sides = [(i, decode[i]) for i in ids_a], []
        for i in ids_b:
            piece = model.id_to_piece(i)
            sides[1].append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or any(b"".join(b for _, b in side) != whole for side in sides):
            rows.append(([], [], [], ""))
            continue
        ends = []
        for side in sides:
            at, own = 0, {}
            for k, (i, piece) in enumerate(side):
                at += len(piece)
                own[at] = k
            ends.append(own)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids_a[ends[0][e]], ids_b[ends[1][e]]) for e in shared]
        counts.update(links)
        groups, last = [], (0, 0)
        for e in shared:
            to = ends[0][e] + 1, ends[1][e] + 1
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((ids_a, ids_b), last, to)))
            last = to
        rows.append((ids_a, ids_b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), digest) for a, b, x, digest in rows]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20])
def test_equal_to_loops(spark, frequent):
    docs = documents(n=30) + [(1000 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, AWKWARD[1], "en", "s", 3)]
    out = alignment.cross_tokenizer(frame(spark, docs).repartition(3), A, B, ["doc_id", "n", "label"], RANKS, public_tokenizers.PATTERN, frequent=frequent)
    got = sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in out.collect())
    assert got == sorted((str(d[0]), *row) for d, row in zip(docs, plain([d[1] for d in docs])))


def test_every_row_equal_to_loops_at_scale(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((d, *row) for (d, _), row in zip(rows, plain([t for _, t in rows])))


def test_empty_table(spark):
    assert alignment.cross_tokenizer(frame(spark, [], extra=False), A, B, ["doc_id"]).collect() == []


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)

    def csr(m):
        at = np.nonzero(m)
        return alignment.Csr(np.append(0, np.cumsum((m != 0).sum(1))), at[1], m[at], m.shape[1])

    def dense(m):
        out = np.zeros((m.rows, m.columns), np.int64)
        out[m.row_of(), m.indices] = m.values
        return out

    for _ in range(30):
        a = rng.integers(0, 3, (rng.integers(0, 7), rng.integers(1, 6))) * rng.integers(0, 2)
        b = rng.integers(0, 3, (a.shape[1], rng.integers(1, 8)))
        assert (dense(alignment.product(csr(a), csr(b))) == a @ b).all()
        assert (dense(alignment.transpose(csr(b))) == b.T).all()
        assert (alignment.product_sizes(csr(a), csr(b)) == ((a != 0) @ (b != 0).sum(1)).T).all()


def test_links_by_bytes(aligner):
    texts = [*AWKWARD, None, ""]
    x = aligner(texts)
    m = x.overlaps()
    for i, j, n in zip(m.row_of(), m.indices, m.values):
        assert n == min(x.ends[0][i], x.ends[1][j]) - max(x.starts[0][i], x.starts[1][j])
    assert m.values.sum() == x.size
    one = aligner(["don't I'll 1234567.89"])
    group_a, group_b = one.groups
    shared = one.shared_groups()
    assert set(zip(shared.row_of().tolist(), shared.indices.tolist())) == {(i, j) for i, g in enumerate(group_a) for j, h in enumerate(group_b) if g == h}
    assert alignment.product_sizes(one.group_incidence()[0], alignment.transpose(one.group_incidence()[1])).sum() == len(shared.indices)


def test_both_encoders_agree():
    fast, slow = alignment.ByteTokens(A, RANKS, public_tokenizers.PATTERN), alignment.ByteTokens(A)
    texts = [f" {t}" for t in AWKWARD] + [" ab" * 40 + " " * 399 + "x" * 399 + "\n" * 300]
    assert fast.encode(texts) == slow.encode(texts)

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.helpers import documents, frame
from tokenizers import Tokenizer

from lumenfold.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces_by_doc(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=64, segments=5, loss=64, pool=16, min_cut=4), packing.Limits(tokens=64, segments=3, loss=20, pool=16)])
def test_every_id_once_within_limits(spark, limits):
    docs = documents()
    rows = packing.pack_documents(frame(spark, docs), PATH, limits).collect()
    own, tokenizer = pieces_by_doc(rows), Tokenizer.from_file(PATH)
    texts = {}
    for d in docs:
        texts.setdefault(d[0], []).append(d[1])
    for doc, found in texts.items():
        ids = np.array(tokenizer.encode(found[0] or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        got = sum(len(r["ids"]) // 4 for r in own[doc])
        assert got == len(ids) * len(found)
        for r in own[doc]:
            assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.segments and at <= max(limits.loss, 1)


def test_little_padding(spark):
    rows = packing.pack_documents(frame(spark, documents(n=400)).coalesce(1), PATH, packing.Limits(tokens=256, pool=128, min_cut=8)).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in total.values())
    assert padding < 0.02 * sum(total.values())


def test_words_and_whole_texts_agree():
    texts = ["Don't stop, O'Neill's (x) 12a3... <|endoftext|> naïve İstanbul ΣΑΣ. a\u00a0b\x1cc e\u0301t\u0065", "", "x" * 3000]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.WordTokenizer(PATH).encode(texts) == want


class Counted:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, words, **options):
        self.n += len(words)
        return self.inner.encode_batch_fast(words, **options)


def whole_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda texts: [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_letters_before_marks_are_not_encoded_word_by_word():
    letters = [a + b + c for a in "abcDEFé" for b in "ghijKLñ" for c in "mnopQRß"]
    texts = [" ".join(w + mark for w in letters) for mark in ("", ",", "!!", ".%%%", "$$$")]
    tokens = packing.WordTokenizer(PATH)
    tokens.model = Counted(tokens.model)
    assert tokens.encode(texts) == whole_tokenizer()(texts)
    assert tokens.model.n < 20


def test_letters_beyond_ascii_and_marks_agree():
    texts = [f"a{chr(c)}b, {chr(c)}!? {chr(c)}\u0301. ({chr(c)}) '{chr(c)}'s" for c in [*range(128, 0x3200), 0x212A, 0x2126, 0xAC00, 0xF900, *range(0xFB00, 0xFB50), 0x1D400, 0x1F600, 0x2EBF0]]
    assert packing.WordTokenizer(PATH).encode(texts) == whole_tokenizer()(texts)


def test_texts_in_blocks_agree(monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 300)
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    texts = [d[1] for d in documents()]
    found = packing.WordTokenizer(PATH).encoded(pa.array(["cut off", *texts]).slice(1))
    assert list(found) == whole_tokenizer()([t or "" for t in texts])


def test_conversations_bear_loss_on_the_assistant_only(spark):
    turns = [(1, 0, "user", "a b"), (1, 1, "assistant", "c d e"), (2, 0, None, None), (3, 0, "assistant", "x " * 50)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = packing.pack_conversations(df, PATH, packing.Limits(tokens=32, segments=4, loss=10, pool=8, min_cut=2)).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 51
    by = defaultdict(int)
    for r in rows:
        if r["doc_id"] == 3:
            by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 10


def test_empty(spark):
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


def test_crc(spark):
    r = packing.pack_documents(frame(spark, [(1, "hello world", None, None, 0)]), PATH).selectExpr("crc32(ids) c", "ids").first()
    assert r["c"] == zlib.crc32(bytes(r["ids"]))

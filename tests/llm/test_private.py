import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import documents, frame

from lumenfold.llm import private, queries

#: The patterns as the contract states them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def stated(text):
    return [(kind, *m.span()) for kind, p in STATED.items() for m in re.finditer(p, text) if valid(kind, m[0])]


PIECES = ["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "255", "256", "4539578763621486", "4539 5787 6362 1486", "x@y.zz", "10.0.0.1", "+1 (555) 010-9999", "é", "\n", "00", "(", "%", "_"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_base_spans_equal_stated_patterns(parts):
    text = "".join(parts)
    assert private.base_spans(text) == stated(text)


def test_time_in_proportion():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 400_000, "a@" * 200_000, "@a." * 130_000, "+1" + "(" * 400_000, "1 -" * 130_000):
        private.base_spans(text)


def plain(texts, disclosure=0.9, need=3, size=8):
    """Spans of every text, by loops over all words and entities."""
    word = re.compile(r"[^\W_]+")
    held, joint, contexts, of_entity = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for i, text in enumerate(texts):
        for m in word.finditer(text or ""):
            w = m[0].lower()
            held[w].add(i)
            if len(w) > 3:
                held[w[:3] + "*"].add(i)
        base = stated(text or "")
        inside = {p for _, a, b in base for p in range(a, b)}
        blank = "".join(" " if p in inside else c for p, c in enumerate(text or ""))
        words = [(m.start(), m[0].lower()) for m in word.finditer(blank)]
        for kind, a, b in base:
            value = text[a:b]
            e = (kind, value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
            near = tuple([w for p, w in words if p < a][-size:] + [w for p, w in words if p >= b][:size])
            of_entity[e].add(i)
            contexts[e].add(near)
            for t in {*near, *(w[:3] + "*" for w in near if len(w) > 3)}:
                joint[e, t].add(i)
                contexts[e, t].add(near)
    n = sum(t is not None for t in texts)

    def tells(e, t):
        content = math.log2(n / len(of_entity[e]))
        return len(contexts[e, t]) >= need and content > 0 and math.log2(n * len(joint[e, t]) / (len(held[t]) * len(of_entity[e]))) >= disclosure * content

    fate = {}
    for e, t in joint:
        if not t.endswith("*") and tells(e, t):
            fate.setdefault(t, []).append(t[:3] + "*" if len(t) > 3 and not tells(e, t[:3] + "*") else None)
    out = []
    for text in texts:
        base = stated(text or "")
        inside = {p for _, a, b in base for p in range(a, b)}
        terms = [("term", *m.span(), None if None in fate[m[0].lower()] else fate[m[0].lower()][0]) for m in word.finditer(text or "") if m[0].lower() in fate and m.start() not in inside]
        out.append([(*b, None) for b in base] + terms)
    return out, fate


def corpus(seed=3):
    rng = random.Random(seed)
    rows = documents(seed, 80)
    people = [("Marguerite", "Okonkwo", "m.okonkwo@mail.example.org"), ("Bartholomew", "Al", "+44 20 7946 0958"), ("Margo", "Oak", "192.168.77.4")]
    texts = []
    for first, last, value in people:
        for _ in range(6):
            filler = [rng.choice(rows)[1] or "" for _ in range(2)]
            texts.append(f"{filler[0][:80]} {first} {last} writes {value} {rng.choice(['today', 'often', 'now'])} {filler[1][:60]}")
        texts.append(f"no address here, but {first} again")
    texts += [texts[0]] * 5 + ["card 4539578763621486 and 4539 5787 6362 1486; x@y.zz", "margins and oakum", "MARGUERITE okonkwo's"]
    return rows + [(None if i == 4 else 9000 + i, t, "en", "s", 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("options", [{}, {"disclosure": 0.7, "contexts": 2, "window": 3}])
def test_equal_to_loops(spark, options):
    docs = corpus()
    out = private.find(frame(spark, docs).repartition(3), ["doc_id", "n", "kept"], **options)
    got = sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in out.collect())
    want, fate = plain([d[1] for d in docs], **dict(zip(("disclosure", "need", "size"), options.values())))
    assert got == sorted((str(d[0]), w, *(sum(s[0] == k for s in w) for k in private.KINDS)) for d, w in zip(docs, want))
    assert "marguerite" in fate and "okonkwo" in fate and "alpha" not in fate


def test_generalised_and_removed(spark):
    docs = corpus()
    out = {r["doc_id"]: r["text"] for r in private.sanitised(frame(spark, docs)).collect()}
    assert "Okonkwo" not in out[9000] and "<email>" in out[9000]
    assert out[9000 + 6].startswith("no address here, but ") and "Marguerite" not in out[9006]
    assert {k: v for k, v in out.items() if k and k < 9000} == {d[0]: d[1] for d in docs if d[0] and d[0] < 9000}
    assert private.sanitised(frame(spark, docs)).columns == frame(spark, docs).columns


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want, _ = plain([t for _, t in rows])
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
    expected = sorted((d, *(sum(s[0] == k for s in w) for k in private.KINDS), hashlib.sha256(say([s for s in w if s[0] != "term"]).encode()).hexdigest(), say(w)) for (d, _), w in zip(rows, want))
    assert sorted(tuple(r) for r in queries.op13_private_data(spark, sf).collect()) == expected


def test_empty_table(spark):
    assert private.find(frame(spark, []), ["doc_id"]).collect() == []

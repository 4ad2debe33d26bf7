"""Personal data by patterns, and the words that give it away, by information content.

Protected entities are what the patterns find: mail addresses, IP addresses, card and phone numbers. An entity e that d(e) of N
documents hold has the information content log2(N / d(e)). A word t near it discloses PMI(t; e) = log2(N d(t, e) / (d(t) d(e))) bits
of that; d(t, e) counts documents that hold t in a window around e. Where this is ``disclosure`` of the content or more, and e has t in at least ``contexts``
windows that differ (so that copies of one text prove nothing), t is sanitised wherever it occurs: it is generalised to its first letters if those, judged by the same counts,
disclose less than the threshold, else removed.

1. One pass finds the entities and writes their windows (rows only for documents that have some).
2. Words with enough windows of one entity are candidates; a second pass counts the documents that hold them. Tasks know candidates
   by a bit table of fixed size, and sum before the shuffle; the join behind it is exact.
3. A last pass gives each document's spans. Words that the bit table lets through are joined with the disclosing words exactly.

Nothing but bit tables of fixed size and one number goes through the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_batches, written

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information content from which a word discloses it; windows that differ; words on either side of an entity.
DISCLOSURE, CONTEXTS, WINDOW = 0.9, 3, 8
#: Letters that a generalised word keeps.
KEPT_LETTERS = 3
#: Bits of a table of words, and words that a task remembers the bit of.
BITS, KNOWN = 1 << 22, 400_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that begins no address is passed over as a whole.
_IP = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start; leftmost matches of each kind that don't overlap, and of these the ones that are valid.

    Every pattern takes time in proportion to the text, whatever it holds."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, last := m.end()))
    for m in _IP.finditer(text) if text.count(".") > 2 else ():
        if m[1] and all(map(_byte, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_OTHER.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """Spellings of one address or number are one entity."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _OTHER.sub('', value)}"


def general(word: str) -> str | None:
    """What a word is generalised to; short words have nothing more general."""
    return f"{word[:KEPT_LETTERS]}*" if len(word) > KEPT_LETTERS else None


def words_of(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def windows(text: str, spans: list[tuple[str, int, int]], size: int = WINDOW) -> list[tuple[str, list[str]]]:
    """(entity, the lower-cased words of its window) of each span; words inside any span are left out.

    Words are sought outward from a span in stretches, so that a long text isn't split once for each."""
    covered = sorted((a, b) for _, a, b in spans)
    merged: list[list[int]] = []
    for a, b in covered:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    blank = "".join([*(text[x:a] + " " * (b - a) for x, (a, b) in zip([0, *(b for _, b in merged)], merged)), text[merged[-1][1] :]]) if merged else text
    out = []
    for kind, a, b in spans:
        reach = 32 * size
        while True:
            low, high = max(0, a - reach), min(len(text), b + reach)
            # The outermost words may be cut; they count only where the text ends.
            before = [m[0] for m in _WORD.finditer(blank, low, a) if low == 0 or m.start() > low]
            after = [m[0] for m in _WORD.finditer(blank, b, high) if high == len(text) or m.end() < high]
            if (len(before) >= size or low == 0) and (len(after) >= size or high == len(text)):
                break
            reach *= 4
        out.append((entity(kind, text[a:b]), [w.lower() for w in before[-size:] + after[:size]]))
    return out


def entity_windows(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(entity, context, first, terms): a row an occurrence; ``first`` once a document, ``terms`` the window's words and their general
    forms, each with whether the document hadn't it before beside that entity."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for text in batch.column(0):
                text = text.as_py()
                spans = base_spans(text) if text else []
                had: dict[str, set[str]] = {}
                for name, words in windows(text, spans, size) if spans else ():
                    context = xxhash.xxh64_intdigest(" ".join(words).encode()) - (1 << 63)
                    new = name not in had
                    seen = had.setdefault(name, set())
                    terms = dict.fromkeys([*words, *filter(None, map(general, words))])
                    out.append((name, context, new, [(t, t not in seen) for t in terms]))
                    seen.update(terms)
            types = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("term", pa.string()), ("new", pa.bool_())])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["entity", "context", "first", "terms"]) if out else None

        return one

    return map_batches(docs.select(text_col), make, "entity string, context long, first boolean, terms array<struct<term:string,new:boolean>>")


class Bits:
    """Words that may be in a table: a bit for each of BITS hash values; broadcast, 512 KB whatever the table."""

    def __init__(self, words: DataFrame, column: str):
        set_bits = words.select(F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int").alias("b")).distinct().toPandas()["b"]
        table = np.zeros(BITS, bool)
        table[set_bits.to_numpy()] = True
        self.any = bool(len(set_bits))
        self.packed = words.sparkSession.sparkContext.broadcast(np.packbits(table))

    def test(self):
        """A function of one word, which remembers its answers up to a bound."""
        table, known = np.unpackbits(self.packed.value).astype(bool), {}

        def may(word: str) -> bool:
            if (answer := known.get(word)) is None:
                if len(known) > KNOWN:
                    known.clear()
                # As Spark's xxhash64, which is signed; BITS divides 2^64.
                answer = known[word] = bool(table[xxhash.xxh64_intdigest(word.encode(), 42) % BITS])
            return answer

        return may


def term_counts(docs: DataFrame, candidates: Bits, text_col: str) -> DataFrame:
    """(term, n): documents that hold each word, or general form of a word, that may be a candidate."""
    def count(batches):
        may, held = candidates.test(), Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py() or "")
                held.update(filter(may, words))
                held.update(filter(may, {w[:KEPT_LETTERS] + "*" for w in words if len(w) > KEPT_LETTERS}))
            if len(held) > KNOWN:
                yield given()
                held.clear()
        if held:
            yield given()

    return docs.select(text_col).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, contexts: int = CONTEXTS, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """(term, general): words that disclose an entity; ``general`` is what stands for them, null where even that would disclose one."""
    found = written(entity_windows(docs, window, text_col), "windows")
    entities = found.groupBy("entity").agg(F.count_distinct("context").alias("contexts"), F.sum(F.col("first").cast("long")).alias("n_entity")).where(F.col("contexts") >= contexts)
    shared = found.join(entities.select("entity"), "entity", "left_semi").select("entity", "context", F.inline("terms"))
    pairs = written(shared.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.sum(F.col("new").cast("long")).alias("n_both")).where(F.col("contexts") >= contexts).drop("contexts").join(entities.drop("contexts"), "entity"), "pairs")
    candidates = Bits(pairs, "term")
    n_docs = docs.where(F.col(text_col).isNotNull()).count() if candidates.any else 1
    counts = term_counts(docs if candidates.any else docs.limit(0), candidates, text_col)
    content = F.log2(F.lit(n_docs) / F.col("n_entity"))
    bits = F.log2(F.lit(n_docs) * F.col("n_both") / (F.col("n") * F.col("n_entity")))
    # An entity that every document holds has no content to disclose.
    judged = written(pairs.join(counts, "term").withColumn("discloses", (content > 0) & (bits >= disclosure * content)), "judged")
    word = judged.where("discloses and not endswith(term, '*')").withColumn("general", F.when(F.length("term") > KEPT_LETTERS, F.concat(F.left("term", F.lit(KEPT_LETTERS)), F.lit("*"))))
    forms = judged.where("discloses and endswith(term, '*')").select(F.col("term").alias("general"), "entity", F.lit(True).alias("too"))
    fate = word.join(forms, ["general", "entity"], "left").select("term", F.when(F.col("too").isNull(), F.col("general")).alias("general"))
    # A word that must go for one entity goes for all.
    return written(fate.groupBy("term").agg(F.when(F.count("general") == F.count("*"), F.max("general")).alias("general")), "disclosing")


_SPAN = "struct<kind:string,start:bigint,end:bigint,general:string>"


def _spans(docs: DataFrame, keep: list[str], disclosure: float, contexts: int, window: int, text_col: str) -> DataFrame:
    """``keep`` columns of every row as _0, _1 and so on, and ``spans``."""
    terms = disclosing_terms(docs, disclosure, contexts, window, text_col)
    bits = Bits(terms, "term")
    n = len(keep)
    hit_type = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("general", pa.string())]))

    def make():
        may = bits.test() if bits.any else None

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, hits = [], []
            for text in batch.column(n):
                text = text.as_py() or ""
                base = base_spans(text)
                spans.append([(*s, None) for s in base])
                if may is None or not any(map(may, words_of(text))):
                    hits.append([])
                    continue
                covered = np.zeros(len(text) + 1, np.int32)
                for _, a, b in base:
                    covered[a] += 1
                    covered[b] -= 1
                covered = np.cumsum(covered)
                hits.append([(w, *m.span()) for m in _WORD.finditer(text) if may(w := m[0].lower()) and not covered[m.start()]])
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(spans, span_type), pa.array(hits, hit_type)], names=[*(f"_{i}" for i in range(n)), "spans", "hits"])

        return one

    own = docs.select(*keep).schema
    schema = "".join(f"_{i} {f.dataType.simpleString()}, " for i, f in enumerate(own)) + f"spans array<{_SPAN}>, hits array<struct<term:string,start:bigint,end:bigint>>"
    rows = map_batches(docs.select(*keep, F.col(text_col).alias("_text")), make, schema).withColumn("_row", F.monotonically_increasing_id())
    if bits.any:
        rows = written(rows, "spans")
        hit = rows.where(F.size("hits") > 0).select("_row", F.inline("hits")).join(terms, "term").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", "general"))).alias("more"))
        rows = rows.join(hit, "_row", "left").withColumn("spans", F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))
    return rows.select(*(f"_{i}" for i in range(n)), "spans")


def find(docs: DataFrame, keep: list[str], disclosure: float = DISCLOSURE, contexts: int = CONTEXTS, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row, then n_email, n_ip, n_card, n_phone and ``spans``: array of (kind, start, end, general) in code points, end exclusive,
    by kind (email, ip, card, phone, term) and start. Of a term, ``general`` is what it is generalised to, null if it is to be removed.

    Null and empty texts have no spans. Repeated rows and null ids are documents like others, and count each. An empty table gives no rows. No ids are
    compared; columns that aren't kept may have any names."""
    rows = _spans(docs, keep, disclosure, contexts, window, text_col)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), *map(of, KINDS), "spans")


def said(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != "term")


def cleaned(text: str, spans: list) -> str:
    """The text with entities named by their kind, and disclosing words generalised or removed. Of spans that overlap, the first that begins stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind']}>" if s["kind"] != "term" else s["general"] or ""]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, contexts: int = CONTEXTS, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with their texts cleaned; null texts stay null."""
    names = docs.columns
    rows, at = _spans(docs, names, disclosure, contexts, window, text_col), names.index(text_col)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t if t is None else cleaned(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

        return one

    return map_batches(rows, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

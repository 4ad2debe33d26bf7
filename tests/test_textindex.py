import random
import re

import pytest
from tests.conftest import SF

from lumenfold.functions.dictionaries import DICTIONARIES, arabic, english, french
from lumenfold.operators import textindex as T
from lumenfold.plans import textsearch


@pytest.mark.parametrize(
    ("stem", "pairs"),
    [
        (english, "consigned consign|consistency consist|conferences confer|relational relat|hopping hop|hoping hope|agreed agre|skies sky|dying die|knackeries knackeri|generously generous|happily happili|vietnamization vietnam|gaps gap|knives knive|conspirators conspir|cry cri|say say|news news"),
        (french, "continuait continu|continuellement continuel|contractions contract|majestueusement majestu|maintenant mainten|maïs maï|maladies malad|contraires contrair|chevaux cheval|conférences conférent|rapidement rapid|nationalités national"),
        (arabic, "المؤتمر ميتمر|مؤتمرات ميتمر|الكتاب كتاب|كتابها كتاب|والكتاب كتاب|hello hello"),
    ],
)
def test_word_pairs(stem, pairs):
    for pair in pairs.split("|"):
        word, want = pair.split()
        assert stem(word) == want


def test_stop_words():
    assert english("the") is french("les") is None or (english("the"), french("des")) == (None, None)
    assert DICTIONARIES["simple"]("the") == "the"
    for make in DICTIONARIES.values():
        for word in ("", "a", "y", "é", "s", "日本", "x" * 300, "yyy", "ss", "ied"):
            make(word)


def test_parse():
    clauses = T.parse('one "two three" -four or five-six -"seven eight" OR -nine or "" or')
    assert [(c.wanted, c.unwanted) for c in clauses] == [([["one"], ["two", "three"]], [["four"]]), ([["five", "six"]], [["seven", "eight"]])]


def brute_cover(lists):
    total = 0.0
    for stretch in range(4):
        own = [{p for p in x if p // T.STRETCH == stretch} for x in lists]
        every = sorted(set().union(*own))
        covers = [(a, b) for a in every for b in every if a <= b and all(any(a <= p <= b for p in x) for x in own)]
        smallest = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
        total += sum(0.1 / (1 + (b - a + 1) - len(lists)) for a, b in smallest)
    return total


def test_proximity_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n, free = rng.randrange(1, 4), list(range(1, 25)) + list(range(T.STRETCH + 1, T.STRETCH + 12))
        rng.shuffle(free)
        lists = [[free.pop() for _ in range(rng.randrange(0, 6))] for _ in range(n)]
        assert T.proximity(lists) == pytest.approx(brute_cover(lists))


VOCABULARY = "conference conferences conferred the of and nation nations national nationale maison maisons la les running runs ran study studies studied".split()


def plain(text, query, configs):
    """Whether a text satisfies a query, dictionary by dictionary, and its rank."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    where = {}
    for n, c in enumerate(configs):
        for i, w in enumerate(words, 1):
            if (x := DICTIONARIES[c](w)) is not None:
                where.setdefault(x, set()).add(n * T.STRETCH + i)
    best = None
    for c in configs:
        for clause in T.parse(query):
            def found(phrase, c=c):
                lexemes = [(i, DICTIONARIES[c](w)) for i, w in enumerate(phrase)]
                lexemes = [(i, x) for i, x in lexemes if x is not None]
                return lexemes and any(all(p + i - lexemes[0][0] in where.get(x, ()) for i, x in lexemes) for p in where.get(lexemes[0][1], ()))

            real = [p for p in clause.wanted if any(DICTIONARIES[c](w) is not None for w in p)]
            if real and all(map(found, real)) and not any(map(found, clause.unwanted)):
                lists = [sorted(where[x]) for x in sorted({DICTIONARIES[c](w) for p in real for w in p} - {None})]
                best = max(best or 0, brute_cover(lists))
    return best


@pytest.mark.parametrize("query", ['conference', 'studying', '"the nation"', '"nation of the" -maison', "running or maison -la", '"conference of nations" or study', "the", "-the", '"studies the running"', "unknown", "", 'nationals -"the nations" les'])
def test_search_equals_brute_force(spark, query):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(0, 14))) for _ in range(80)] + [None, "", "!!", "Conferences-of,NATIONS"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lexeme string")
    got = {r["id"]: r["rank"] for r in T.search(T.positions(docs), query).collect()}
    want = {i: r for i, t in enumerate(texts) if (r := plain(t, query, T.CONFIGS)) is not None}
    assert got == pytest.approx(want)


def test_documents_are_added_replaced_and_merged(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path, merged = str(tmp_path / "index"), str(tmp_path / "merged")
    T.add(frame([(1, "a conference"), (2, "many nations"), (3, "study")]), path, 0)
    T.add(frame([(2, "the conferences"), (3, None), (4, "nation")]), path, 1)
    T.add(frame([(2, "the conferences"), (3, None), (4, "nation")]), path, 1)  # a repeated attempt
    T.merge(spark, path, merged)
    for at in (path, merged):
        index = T.read(spark, at)
        ids = lambda q, index=index: sorted(r["id"] for r in T.search(index, q).collect())
        assert ids("conference") == [1, 2] and ids("nations") == [4] and ids("study") == [] and ids('"many nation"') == []
    only = T.search(T.read(spark, merged), "conference or nation", docs=spark.createDataFrame([(1,), (4,)], "id long"))
    assert sorted(r["id"] for r in only.collect()) == [1, 4]


def test_a_search_reads_only_its_lexemes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    T.add(docs, str(tmp_path / "index"), 0, ["simple"])
    found = T.search(T.read(spark, str(tmp_path / "index")), '"of the" or und', ["simple"])
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*folder#\d+ IN \(", plan) and re.search(r"PushedFilters: \[.*In\(lexeme", plan) and "text" not in re.search(r"ReadSchema: (.*)", plan)[1]


def test_stemmed_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["rank"] for r in textsearch.stemmed_search(spark, SF).collect()}
    want = {}
    for i, text in rows:
        if not any(x in (text or "").lower() for x in ("here", "tion")):
            continue
        if (r := quick(text)) is not None:
            want[i] = r
    assert set(got) == set(want)


def quick(text):
    """As ``plain`` for the registered query, without the rank."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    query = 'heres or "the tion" -edly'
    sets = {}
    for c in T.CONFIGS:
        for i, w in enumerate(words):
            if (x := DICTIONARIES[c](w)) is not None:
                sets.setdefault(x, set()).add((c, i))
    for c in T.CONFIGS:
        for clause in T.parse(query):
            def found(phrase, c=c):
                lexemes = [(i, x) for i, x in ((i, DICTIONARIES[c](w)) for i, w in enumerate(phrase)) if x is not None]
                return lexemes and any(all((k, p + i - lexemes[0][0]) in sets.get(x, ()) for i, x in lexemes) for k, p in sets.get(lexemes[0][1], ()))

            real = [p for p in clause.wanted if any(DICTIONARIES[c](w) is not None for w in p)]
            if real and all(map(found, real)) and not any(map(found, clause.unwanted)):
                return True
    return None


def test_postings_of_many_texts_are_made_together():
    """A row a lexeme, not one a lexeme of each text, whatever the task still remembers."""
    rng = random.Random(8)
    texts = [[rng.choice(VOCABULARY) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    lexicon = T.Lexicon(T.CONFIGS)
    for _ in range(2):
        rows = list(zip(*(c.to_pylist() for c in T._postings(lexicon, texts))))
        assert len({x for x, *_ in rows}) == len(rows)
        got = sorted((i, x, places[a:b]) for x, at, ends, places in rows for i, a, b in zip(at, [0, *ends], ends))
        want = {}
        for i, words in enumerate(texts):
            for n, c in enumerate(T.CONFIGS):
                for p, w in enumerate(words, 1):
                    if (x := DICTIONARIES[c](w)) is not None:
                        want.setdefault((i, x), []).append(n * T.STRETCH + p)
        assert got == sorted((*k, v) for k, v in want.items())
        lexicon.clear()
    assert [len(x) for x in T._postings(T.Lexicon(["english"]), [["the", "of"]])] == [0, 0, 0, 0]

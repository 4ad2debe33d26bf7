"""Queries on texts: quality, classification, names, mail, triage and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.functions.filters import Filter
from lumenfold.operators import relational as R
from lumenfold.operators import retrieval as S
from lumenfold.operators import search
from lumenfold.plans.relational import DOCUMENTS, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_SPACE = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIMMED = rf"regexp_replace(coalesce(text, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


@query(f"""SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, len(w) >= 40 AS comparable FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)""")
def tokenize_stats(spark, d):
    words = t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), (F.size("w") >= 40).alias("comparable"))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(x, '{pattern}'))"


_STATS = f"""s AS (SELECT doc_id, source, lang, n_chars, length(x) AS chars, {_count(chr(92) + 'p{L}')} AS letters, {_count('�')} AS replacements, {_count(X.VOWELS)} AS vowels,
    list_filter(regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}''’-]+'), lambda w: w <> '') AS w,
    {_count(X.SCRIPTS['arabic'])} AS ar, {_count(X.SCRIPTS['hebrew'])} AS he, {_count(X.SCRIPTS['cjk'])} AS cj, {_count(X.SCRIPTS['cyrillic'])} AS cy, {_count(X.SCRIPTS['latin'])} AS la
    FROM (SELECT *, {_TRIMMED} AS x FROM documents)),
    q AS (SELECT *, len(w) AS n_tokens, len(list_filter(w, lambda y: length(y) = 1)) AS single, CASE WHEN greatest(ar, he, cj, cy, la) = 0 THEN NULL WHEN ar = greatest(ar, he, cj, cy, la) THEN 'arabic' WHEN he = greatest(ar, he, cj, cy, la) THEN 'hebrew'
      WHEN cj = greatest(ar, he, cj, cy, la) THEN 'cjk' WHEN cy = greatest(ar, he, cj, cy, la) THEN 'cyrillic' ELSE 'latin' END AS script FROM s),
    v AS (SELECT *, CASE WHEN chars = 0 THEN 'empty' WHEN n_chars * 10 > chars * 20000 THEN 'no_text_layer' WHEN replacements / chars > 0.03 THEN 'gibberish' WHEN letters / chars < 0.35 THEN 'gibberish' WHEN n_tokens < 5 THEN 'too_short'
      WHEN single / n_tokens > 0.55 THEN 'gibberish' WHEN script = 'latin' AND (CASE WHEN letters > 0 THEN vowels / letters ELSE 0 END) < 0.12 THEN 'gibberish' ELSE 'ok' END AS verdict FROM q)"""


def _quality(spark, d):
    stats = t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", X.quality_stats(F.col("text")).alias("s"))
    flat = stats.select("doc_id", "source", "lang", "n_chars", "s.*")
    return flat.withColumn("verdict", X.quality_verdict(F.col("n_chars") * 10))


@query(f"""WITH {_STATS} SELECT doc_id, verdict, n_tokens, round(CASE WHEN chars > 0 THEN letters / chars ELSE 0 END, 6) AS letter_ratio, verdict <> 'ok' AND lower(lang) IN ('pdf', 'png', 'en') AS ocr FROM v""")
def text_quality(spark, d):
    ratio = F.round(F.when(F.col("chars") > 0, F.col("letters") / F.col("chars")).otherwise(0.0), 6)
    ocr = (F.col("verdict") != "ok") & F.lower("lang").isin("pdf", "png", "en")
    return _quality(spark, d).select("doc_id", "verdict", F.col("n_tokens").cast("long").alias("n_tokens"), ratio.alias("letter_ratio"), ocr.alias("ocr"))


@query(f"""WITH {_STATS} SELECT coalesce(script, 'none') AS script, verdict, count(*) AS n FROM v GROUP BY 1, 2""")
def dominant_script(spark, d):
    return _quality(spark, d).groupBy(F.coalesce("script", F.lit("none")).alias("script"), "verdict").agg(F.count("*").alias("n"))


_RULES = """k(subject, ord, word) AS (VALUES ('Finance', 0, 'the'), ('Finance', 0, 'and'), ('Academic', 1, 'le'), ('Academic', 1, 'que'), ('Legal', 2, 'der'), ('Legal', 2, 'und'), ('Personal', 3, 'el'), ('Personal', 3, 'los'))"""
SUBJECTS = {"Finance": ("the", "and"), "Academic": ("le", "que"), "Legal": ("der", "und"), "Personal": ("el", "los")}


@query(f"""WITH {_RULES}, m AS (SELECT doc_id, subject, ord, sum(CASE WHEN contains(lower(source), word) THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(text, '')), word) THEN 1 ELSE 0 END)::BIGINT AS score,
             bool_or(contains(lower(source), word)) AS in_name FROM documents, k GROUP BY ALL),
           b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM m)
           SELECT doc_id, CASE WHEN score > 0 THEN subject END AS subject, score, CASE WHEN score = 0 THEN 'low' WHEN in_name AND score >= 4 THEN 'high' WHEN in_name OR score >= 2 THEN 'medium' ELSE 'low' END AS confidence, least(0.99, score / 10) AS confidence_score
           FROM b WHERE r = 1""")
def rule_classify(spark, d):
    """Keyword classification: name hits count 3, body hits (anywhere in the text) 1; the first subject wins ties.

    The taxonomy is a handful of subjects, so it is part of the expression: no join, one pass."""
    docs = t(spark, d, "documents").select("doc_id", F.lower("source").alias("name"), F.lower(F.coalesce("text", F.lit(""))).alias("body"))
    hits = []
    for i, (subject, words) in enumerate(SUBJECTS.items()):
        score = sum((F.when(F.contains("name", F.lit(w)), 3).otherwise(0) + F.when(F.contains("body", F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
        named = F.lit(False)
        for w in words:
            named = named | F.contains("name", F.lit(w))
        hits.append(F.struct(score.cast("long").alias("score"), F.lit(-i).alias("o"), F.lit(subject).alias("subject"), named.alias("in_name")))
    best = docs.select("doc_id", F.array_max(F.array(*hits)).alias("b"))
    score, in_name = F.col("b.score"), F.col("b.in_name")
    level = F.when(score == 0, "low").when(in_name & (score >= 4), "high").when(in_name | (score >= 2), "medium").otherwise("low")
    return best.select("doc_id", F.when(score > 0, F.col("b.subject")).alias("subject"), score.alias("score"), level.alias("confidence"), F.least(F.lit(0.99), score / 10).alias("confidence_score"))


@query()
def version_stem(spark, d):
    """Stems and version numbers of part names with the marks that people add; no look-behind in the other dialect."""
    marks = F.array(*(F.lit(m) for m in ("", "_v2", " v3", "_version_2", " (2)", "_final", " - draft", "_rev4", " copy", "_latest")))
    name = F.concat("p_name", F.element_at(marks, (F.col("p_partkey") % 10 + 1).cast("int")), F.lit(".pdf"))
    named = t(spark, d, "part").select("p_partkey", "p_name", name.alias("filename"))
    plain = F.concat("p_name", F.lit(".pdf"))
    return named.select("p_partkey", "filename", X.version_stem(F.col("filename")).alias("stem"), X.version_number(F.col("filename")).alias("number"), X.filename_version_score(F.col("filename"), plain).alias("name_score"))


@query(r"""WITH n AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[\\/:*?"<>|]', '', 'g'), '\s+', '_', 'g'), '^_+|_+$', '', 'g') AS title, regexp_replace(p_brand, '[^\p{L}\p{N}]+', '', 'g') AS ident FROM part)
           SELECT p_partkey, title || CASE WHEN contains(lower(title), lower(p_brand)) THEN '' ELSE '_' || ident END || CASE WHEN p_size > 1 THEN '_v' || p_size ELSE '' END || '.pdf' AS canonical FROM n JOIN part USING (p_partkey)""")
def canonical_name(spark, d):
    none = F.lit(None).cast("string")
    name = X.canonical_name(F.col("p_name"), none, F.col("p_type"), none, none, F.col("p_brand"), F.lit("x"), F.lit(".pdf"), F.col("p_size"))
    return t(spark, d, "part").select("p_partkey", name.alias("canonical"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' OR (contains(lower(text), 'sale ends') AND turn % 2 = 0) THEN 'junk' WHEN role = 'user' AND turn = 0 THEN 'important' END AS class FROM conversations""")
def mail_triage(spark, d):
    """Messages with the provider's hints read off role and turn."""
    labels = F.when(F.col("role") == "system", F.array(F.lit("SPAM"))).when((F.col("role") == "user") & (F.col("turn") == 0), F.array(F.lit("IMPORTANT"))).otherwise(F.array().cast("array<string>"))
    subject = F.when(F.contains(F.lower("text"), F.lit("sale ends")), F.lit("sale ends"))
    return t(spark, d, "conversations").select("conv_id", "turn", X.mail_triage(subject, F.lit("a@example.com"), labels, F.col("turn") % 2 == 0).alias("class"))


@query(rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '{_SPACE}+', ' ', 'g')) AS plain FROM pages""")
def markup_to_text(spark, d):
    return t(spark, d, "pages").select("page_id", X.markup_to_text(F.col("html")).alias("plain"))


@query("""WITH j AS (SELECT user_id, max_by(event_type, event_id) AS last_type, max(event_id) AS e FROM events GROUP BY user_id),
          f AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic, j.last_type FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN j ON j.user_id = d.doc_id)
          SELECT reason, count(*) AS n, min(doc_id) AS first_doc, max(CASE WHEN reason = 'missing' THEN NULL WHEN reason = 'job_failed' THEN last_type WHEN doc_id % 7 = 0 THEN 'hash' ELSE 'extract_text' END) AS retry FROM (
            SELECT *, CASE WHEN n_chars < 60 THEN 'missing' WHEN last_type = 'error' THEN 'job_failed' WHEN toxic = 1 THEN 'extraction_failed' WHEN doc_id % 7 = 0 THEN 'stalled' WHEN quality = 1 THEN NULL WHEN n_chars < 200 THEN 'needs_ocr' WHEN quality = 0 THEN 'unreadable' END AS reason FROM f)
          WHERE reason IS NOT NULL GROUP BY reason""")
def triage_reasons(spark, d):
    """Why documents wait for a person, in order of severity; the facts are read off labels, sizes and events."""
    jobs = R.latest_wins(t(spark, d, "events"), ["user_id"], ["event_id"], ["event_type"]).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("last_type"))
    files = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left").join(jobs, "doc_id", "left")
    hash_ = F.when(F.col("doc_id") % 7 != 0, F.lit("h"))
    status, job = F.when(F.col("n_chars") < 60, "missing").otherwise("active"), F.when(F.col("last_type") == "error", "failed")
    reason = X.triage_reason(status, job, F.lit(3600), F.when(F.col("toxic") == 1, "failed"), F.lit("processing"), F.lit(None), hash_, F.lit(True), F.when(F.col("quality") == 1, F.lit("named")), F.col("n_chars") < 200, F.when(F.col("quality") == 0, F.lit("gibberish")))
    rows = files.select("doc_id", reason.alias("reason"), "last_type", hash_.alias("hash")).where("reason is not null")
    return rows.withColumn("retry", X.retry_job(F.col("reason"), F.col("last_type"), F.col("hash"))).groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("retry").alias("retry"))


_TERMS = ("the", "que", "der")


_BM25 = f"""w AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), p AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY 1, 2),
          l AS (SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents), s AS (SELECT count(*) AS n, avg(n_tokens) AS m FROM l), h AS (SELECT * FROM p WHERE token IN ('the', 'que', 'der')), df AS (SELECT token, count(*) AS df FROM h GROUP BY 1),
          bm AS (SELECT h.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / m))), 6) AS score FROM h JOIN df USING (token) JOIN l ON l.doc_id = h.doc_id, s GROUP BY 1)"""


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm")
def lexical_search(spark, d):
    """BM25 of every document that holds a search word."""
    words = t(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("w"))
    lengths = words.select("doc_id", F.size("w").alias("n_tokens"))
    wanted = F.filter("w", lambda x: x.isin(*_TERMS))
    index = words.select("doc_id", F.explode(wanted).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return S.bm25(index, lengths, _TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BM25}, c AS (SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE turn = 0 AND contains(lower(text), 'the')),
          f AS (SELECT d.doc_id, coalesce(contains(lower(source), 'src1'), false) AS fn, coalesce(l.quality = 1 AND starts_with(lower(text), 'the'), false) AS ti, coalesce(l.toxic = 0 AND lang = 'fr', false) AS ca, c.doc_id IS NOT NULL AS su, bm.score / 10 AS r
                FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN bm ON bm.doc_id = d.doc_id),
          g AS (SELECT *, greatest(CASE WHEN fn THEN 1.0 ELSE 0 END, CASE WHEN ti OR ca THEN 0.9 ELSE 0 END, CASE WHEN su THEN 0.6 ELSE 0 END, CASE WHEN r > 0 THEN 0.5 + least(r, 0.4) ELSE 0 END) AS rank FROM f)
          SELECT doc_id, rank, coalesce(r > 0, false) AS matched_content, fn AS matched_filename, ti OR ca OR su AS matched_ai FROM g WHERE rank > 0""")
def rank_ladder(spark, d):
    """The best of name, title, canonical name, summary and content hits, with flags; rows without any are left out."""
    said = t(spark, d, "conversations").where("turn = 0").where(F.contains(F.lower("text"), F.lit("the"))).select(F.col("conv_id").alias("doc_id"), F.lit(True).alias("summary")).distinct()
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", F.startswith(F.lower("text"), F.lit("the")).alias("the"))
    joined = docs.join(t(spark, d, "labels"), "doc_id", "left").join(said, "doc_id", "left").join(lexical_search(spark, d), "doc_id", "left")
    rank, flags = search.ladder(F.contains(F.lower("source"), F.lit("src1")), (F.col("quality") == 1) & F.col("the"), (F.col("toxic") == 0) & (F.col("lang") == "fr"), F.col("summary"), F.col("score") / 10)
    return joined.select("doc_id", rank.alias("rank"), flags.alias("f")).where("rank > 0").select("doc_id", "rank", "f.*")


_NEAREST = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
          n AS (SELECT query_id, vec_id, round(list_dot_product(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 100)"""


@query(f"WITH {_NEAREST} SELECT query_id, vec_id, score FROM n")
def cosine_topk(spark, d):
    """The hundred vectors nearest to each vector whose id is divisible by 100; unit vectors, so that the dot product is the cosine."""
    vectors = t(spark, d, "embeddings")
    return S.nearest(vectors, vectors.where("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")


@query(f"WITH {_NEAREST} SELECT query_id, vec_id, score FROM n WHERE score >= 0.62")
def semantic_floor(spark, d):
    """As cosine_topk, with the floor below which nothing is similar."""
    vectors = t(spark, d, "embeddings")
    return S.nearest(vectors, vectors.where("vec_id % 100 = 0"), floor=S.SEMANTIC_FLOOR).withColumnRenamed("id", "vec_id")


@query(f"""WITH {_NEAREST},
          a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
          b AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM n),
          u AS (SELECT query_id, id, 0 AS i, 'content' AS name, 1.0::DOUBLE / (60 + rank) AS part FROM a, q UNION ALL SELECT query_id, id, 1, 'semantic', 1.0::DOUBLE / (60 + rank) FROM b)
          SELECT query_id, id, round(sum(part), 9) AS score, string_agg(name, ',' ORDER BY i) AS matched_by FROM u GROUP BY query_id, id""")
def rrf_fusion(spark, d):
    """Two signals of a hundred rows each, fused by reciprocal ranks, for every query vector."""
    content = S.ranked(t(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), F.col("id")], 100)
    asked = t(spark, d, "embeddings").where("vec_id % 100 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"))
    by_query = asked.join(F.broadcast(content.agg(F.collect_list(F.struct("id", "rank")).alias("c")))).select("query_id", F.inline("c"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    semantic = cosine_topk(spark, d).select("query_id", F.col("vec_id").alias("id"), F.row_number().over(w).alias("rank"))
    return S.fused([("content", by_query), ("semantic", semantic)], ["query_id", "id"]).select("query_id", "id", F.round("score", 9).alias("score"), "matched_by")


@query(f"""WITH {_BM25}, fd AS (SELECT doc_id, source, lang, n_chars FROM documents WHERE source = 'src0' AND lower(lang) IN ('en', 'fr')),
          q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
          a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM fd WHERE contains(lower(lang), 'en') QUALIFY rank <= 100),
          b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm SEMI JOIN fd USING (doc_id) QUALIFY rank <= 100),
          v AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM fd)),
          c AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v WHERE score >= 0.62 QUALIFY rank <= 100),
          u AS (SELECT query_id, doc_id, 0 AS i, 'filename' AS name, 1.0::DOUBLE / (60 + rank) AS part FROM a, q UNION ALL SELECT query_id, doc_id, 1, 'content', 1.0::DOUBLE / (60 + rank) FROM b, q UNION ALL SELECT query_id, doc_id, 2, 'semantic', 1.0::DOUBLE / (60 + rank) FROM c),
          g AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, string_agg(name, ',' ORDER BY i) AS matched_by FROM u GROUP BY ALL)
          SELECT query_id, doc_id, score, matched_by, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place,
            'Found because ' || replace(replace(replace(replace(matched_by, 'filename', 'its name holds the words'), 'content', 'its text holds the words'), 'semantic', 'it is about the same'), ',', ' and ') || '.' AS why FROM g""")
def hybrid_search(spark, d):
    """Names, texts and vectors under one filter, fused; every vector whose id is divisible by 100 is a query."""
    docs, vectors = t(spark, d, "documents"), t(spark, d, "embeddings")
    wanted = Filter(owner="src0", extensions=["en", "fr"])
    allowed = wanted.apply(docs, DOCUMENTS).select("doc_id")
    asked = vectors.where("vec_id % 100 = 0 and embedding is not null")
    # The query set beside signals that don't depend on the vector: as many rows as the signal's best, for each query.
    each = lambda frame: S.ranked(frame.join(allowed, "doc_id", "left_semi"), [F.desc("rank_by"), F.col("doc_id")], search.SIGNAL_ROWS).agg(F.collect_list(F.struct("doc_id", "rank_by")).alias("c"))
    for_all = lambda frame: asked.select(F.col("vec_id").alias("query_id")).join(F.broadcast(each(frame))).select("query_id", F.inline("c"))
    names = for_all(docs.where(F.contains(F.lower("lang"), F.lit("en"))).select("doc_id", F.col("n_chars").cast("double").alias("rank_by")))
    texts = for_all(lexical_search(spark, d).select("doc_id", F.col("score").alias("rank_by")))
    near = S.nearest(vectors.join(allowed, F.col("vec_id") == F.col("doc_id"), "left_semi"), asked, floor=S.SEMANTIC_FLOOR).select("query_id", F.col("id").alias("doc_id"), F.col("score").alias("rank_by"))
    found = search.hybrid(docs, wanted, [("filename", names), ("content", texts), ("semantic", near)], DOCUMENTS, by=["query_id"])
    return found.withColumn("why", search.explained(F.col("matched_by")))


@query(r"""WITH w AS (SELECT doc_id, string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS w FROM documents),
           b AS (SELECT doc_id, w, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')) AS bare FROM w),
           m AS (SELECT doc_id, list_transform(list_zip(w, bare), lambda x: CASE WHEN x[2] IN ('the', 'que', 'der') THEN '<mark>' || x[1] || '</mark>' ELSE x[1] END) AS w, list_filter(range(1, len(w) + 1), lambda i: bare[i] IN ('the', 'que', 'der')) AS h FROM b),
           p AS (SELECT doc_id, w, h[1] AS a, list_filter(h, lambda i: i >= h[1] + 14)[1] AS z FROM m WHERE len(h) > 0)
           SELECT doc_id, array_to_string(w[greatest(a - 8, 1):a + 13], ' ') || CASE WHEN z IS NULL THEN '' ELSE ' … ' || array_to_string(w[greatest(z - 8, a + 14):z + 13], ' ') END AS snippet FROM p""")
def snippets(spark, d):
    """Documents without a search word are left out; as an explosion of nothing, so that no filter makes the fragments a second time."""
    found = F.array_compact(F.array(S.snippet(F.col("text"), _TERMS)))
    return t(spark, d, "documents").select("doc_id", F.explode(found).alias("snippet"))


@query()
def near_duplicate_components(spark, d):
    """Near-duplicates by five-word shingles at a similarity of 0.8: a row for each document, short ones too; comparable tells those of 40 words."""
    from lumenfold.operators.similarity import near_duplicates

    docs = t(spark, d, "documents")
    found = near_duplicates(docs, min_tokens=1).withColumnRenamed("id", "doc_id")
    # A beginning has no more words than the text, so only texts whose beginning has too few are read whole.
    enough = lambda text: F.size(X.tokens(text)) >= 40
    comparable = F.when(enough(F.substring("text", 1, 400)), True).otherwise(enough(F.col("text")))
    return found.join(docs.select("doc_id", comparable.alias("comparable")).groupBy("doc_id").agg(F.max("comparable").alias("comparable")), "doc_id", "left")


_SHINGLES = "w AS (SELECT doc_id, sha256(text) AS h, " + _TOKENS + """ AS w FROM documents),
    s AS (SELECT doc_id, h, len(w) >= 40 AS enough, list_distinct(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w)"""


@query(f"""WITH {_SHINGLES}, p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.h = b.h AS eq, a.enough AND b.enough AS enough, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS na, len(b.s) AS nb FROM s a JOIN s b ON b.doc_id = a.doc_id + 1),
           j AS (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN round(i / (na + nb - i), 6) ELSE 0 END AS similarity FROM p),
           v AS (SELECT *, CASE WHEN eq THEN 'exact' WHEN NOT enough THEN 'not_comparable' WHEN similarity >= 0.65 THEN 'probable' ELSE 'distinct' END AS verdict FROM j)
           SELECT doc_a, doc_b, verdict, similarity, CASE WHEN verdict = 'probable' THEN CASE WHEN similarity >= 0.85 THEN 'medium' ELSE 'low' END END AS confidence FROM v""")
def file_compare(spark, d):
    """Each document against the one with the next id."""
    from lumenfold.operators.similarity import compared

    docs = t(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("doc_a"), (F.col("doc_id") + 1).alias("doc_b"))
    return compared(pairs, docs, "doc_a", "doc_b")

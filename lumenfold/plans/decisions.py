"""Queries on decisions about files, each with its SQL: dates, repaired texts, gates, twins, capped lists, keywords, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import describe as D
from lumenfold.functions import text as X
from lumenfold.functions.filters import Filter
from lumenfold.operators import choices, search
from lumenfold.operators import proposals as P
from lumenfold.plans.relational import DOCUMENTS, t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'exif' WHEN 1 THEN 'pdf' WHEN 2 THEN 'ole' WHEN 3 THEN 'embedded' WHEN 4 THEN 'filesystem' WHEN 5 THEN 'embedded-modified' ELSE 'none' END AS source,
          CASE o_orderkey % 7 WHEN 0 THEN epoch(o_orderdate)::BIGINT + 3661 WHEN 1 THEN epoch(o_orderdate)::BIGINT - 7200 WHEN 6 THEN NULL ELSE epoch(o_orderdate)::BIGINT END AS at FROM orders""")
def document_dates(spark, d):
    """The most trustworthy plausible date of each order, written in the ways that cameras, PDF files and old office files write it."""
    key, at = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    when = lambda i, value: F.when(key == i, value)
    exif = F.when(key == 0, F.date_format(at + F.expr("INTERVAL 3661 SECONDS"), "yyyy:MM:dd HH:mm:ss")).when(key == 1, "0000:00:00 00:00:00")
    pdf = F.when(key == 1, F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("+02'00'"))).when(key == 3, "D:junk")
    ticks = when(2, (F.unix_seconds(at) + 11644473600) * 10_000_000)
    iso = lambda i: F.when(key == i, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(key == 6, "1601-01-01T00:00:00Z")
    file = when(4, at)
    date, source = X.document_date(exif, pdf, iso(3), ticks, iso(5), F.lit(0).cast("long"), file + F.expr("INTERVAL 1 DAY"), file, F.lit("2030-01-01").cast("timestamp"))
    return t(spark, d, "orders").select("o_orderkey", source.alias("source"), F.unix_seconds(date).alias("at"))


@query("""WITH m AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{80}-\\x{FFFF}]')) AS k FROM documents), f AS (SELECT *, k >= 2 OR (k = 1 AND strlen(text) <= 24) AS misread FROM m)
          SELECT doc_id, coalesce(misread, false) AS misread, CASE WHEN misread OR k = 0 THEN length(text) ELSE strlen(text) END AS n_chars, sha256(CASE WHEN misread OR k = 0 THEN text END) AS kept_sha256 FROM f""")
def repaired_texts(spark, d):
    """Texts whose bytes were read in the wrong code page, and what is made of them; a single odd pair in a longer text is left alone."""
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = t(spark, d, "documents").select("doc_id", wrong.alias("wrong"), "text")
    misread = D.looks_misread(F.col("wrong"))
    fixed = rows.select("doc_id", misread.alias("misread"), D.repaired(F.col("wrong")).alias("fixed"), "text")
    return fixed.select("doc_id", "misread", F.length("fixed").cast("long").alias("n_chars"), F.sha2(F.when(F.col("fixed") == F.col("text"), F.col("fixed")), 256).alias("kept_sha256"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 6000 THEN 'high' WHEN c_acctbal >= 2000 THEN 'medium' WHEN c_acctbal >= 0 THEN 'low' END AS level, c_nationkey % 2 = 0 AS read_only, c_mktsegment <> 'MACHINERY' AS opted FROM customer)
          SELECT c_custkey, opted AND read_only AND coalesce(level = 'high', false) AS high_only, opted AND read_only AND coalesce(level IN ('high', 'medium'), false) AS medium_too FROM c""")
def auto_apply_gate(spark, d):
    """Which proposals may be applied by themselves, for two settings of the least confidence."""
    level = F.when(F.col("c_acctbal") >= 6000, "high").when(F.col("c_acctbal") >= 2000, "medium").when(F.col("c_acctbal") >= 0, "low")
    opted, read_only = F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey") % 2 == 0
    gate = lambda least: P.auto_applies(opted, read_only, level, least)
    return t(spark, d, "customer").select("c_custkey", gate("high").alias("high_only"), gate("medium").alias("medium_too"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.75 AND c_mktsegment <> 'BUILDING' THEN 'approved' WHEN c_acctbal / 10000 < 0.25 AND c_mktsegment <> 'BUILDING' THEN 'rejected' WHEN c_mktsegment = 'BUILDING' THEN 'applied' ELSE 'pending' END AS status FROM customer""")
def band_decisions(spark, d):
    """Pending proposals above a confidence are approved and below another rejected; those that are applied already stay."""
    confidence = F.col("c_acctbal") / 10000
    history = t(spark, d, "customer").withColumn("status", F.when(F.col("c_mktsegment") == "BUILDING", "applied").otherwise("pending"))
    return P.reviewed(P.reviewed(history, confidence >= 0.75, "approved"), confidence < 0.25, "rejected").select("c_custkey", "status")


@query("""SELECT 'list' AS request, count(*) AS n FROM documents WHERE source = 'src0' UNION ALL SELECT 'status', count(*) FROM documents JOIN labels USING (doc_id) WHERE source = 'src0' AND toxic = 1
          UNION ALL SELECT 'filename', count(*) FROM documents WHERE source = 'src0' AND contains(lower(lang), 'en') UNION ALL SELECT 'content', count(*) FROM documents WHERE source = 'src0' AND contains(lower(text), 'en')""")
def routed_requests(spark, d):
    """What four requests for one owner's files come to: a list and a status have a count, and searches are counted from their rows."""
    docs, wanted = t(spark, d, "documents"), Filter(owner="src0")
    found = {
        search.route(): search.counted(docs, wanted, DOCUMENTS),
        search.route(status="toxic"): search.counted(docs.join(t(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi"), wanted, DOCUMENTS),
        search.route("en", "filename"): wanted.apply(docs, DOCUMENTS).where(F.contains(F.lower("lang"), F.lit("en"))).agg(F.count("*").alias("n")),
        search.route("en", "content"): wanted.apply(docs, DOCUMENTS).where(F.contains(F.lower("text"), F.lit("en"))).agg(F.count("*").alias("n")),
    }
    out = None
    for request, n in found.items():
        one = n.select(F.lit(request).alias("request"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_TWINS = """WITH f AS (SELECT d.doc_id, sha256(text) AS h, source, quality, toxic, n_chars FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(f"""{_TWINS} SELECT a.doc_id, (SELECT first(b.doc_id ORDER BY coalesce(b.quality = 1, false) DESC, coalesce(b.toxic = 0, false) DESC, b.doc_id) FROM f b WHERE b.h = a.h AND b.doc_id <> a.doc_id AND b.n_chars >= 20) AS processed,
          (SELECT first(b.doc_id ORDER BY b.doc_id DESC) FROM f b WHERE b.h = a.h AND b.doc_id <> a.doc_id AND b.toxic = 0) AS classified, (SELECT first(b.doc_id ORDER BY b.doc_id DESC) FROM f b WHERE b.h = a.h AND b.source = a.source AND b.doc_id <> a.doc_id AND b.quality IS NOT NULL) AS described FROM f a""")
def twin_picks(spark, d):
    """The three orders in which a twin is picked: named, then classified, then oldest; the latest classified; the latest described of the same owner."""
    files = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "n_chars").join(t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    named, sorted_ = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 0, F.lit(False))
    processed = choices.best_twins(files, ["h"], "doc_id", F.col("n_chars") >= 20, [named.desc(), sorted_.desc(), F.col("doc_id")], "processed")
    classified = choices.best_twins(files, ["h"], "doc_id", sorted_, [F.desc("doc_id")], "classified")
    described = choices.best_twins(files, ["h", "source"], "doc_id", F.col("quality").isNotNull(), [F.desc("doc_id")], "described")
    return processed.join(classified, "doc_id").join(described, "doc_id")


@query("""WITH v AS (SELECT source, doc_id, 0 AS i, 'visible' AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p FROM documents WHERE lang = 'en' QUALIFY p <= 200),
          r AS (SELECT source, doc_id, 1 AS i, 'triage' AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0 QUALIFY p <= 60),
          h AS (SELECT source, doc_id, 2 AS i, 'photos' AS list, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS p FROM documents WHERE n_chars < 2000 QUALIFY p <= 60),
          u AS (SELECT * FROM v UNION ALL SELECT * FROM r UNION ALL SELECT * FROM h), f AS (SELECT source, doc_id, i, list, p FROM u QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY i) = 1)
          SELECT source, doc_id, list, row_number() OVER (PARTITION BY source ORDER BY i, p)::INT AS place FROM f""")
def chat_backlog(spark, d):
    """What an assistant sees of each owner: the page, the triage queue and the photos, with their caps of 200, 60 and 60, each document once."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    waiting = docs.join(labels.where("toxic = 1 or quality = 0"), "doc_id", "left_semi")
    lists = [("visible", docs.where("lang = 'en'"), 200), ("triage", waiting, 60), ("photos", docs.where("n_chars < 2000"), 60)]
    return choices.capped_union(lists, "source", "doc_id", "n_chars")


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark),
           m AS (SELECT doc_id, item_id, (count(*) FILTER (WHERE contains(lower(name), word)) * 3 + count(*) FILTER (WHERE contains(lower(text), word)))::BIGINT AS score, count(*) FILTER (WHERE contains(lower(name), word)) > 0 AS named
                 FROM (SELECT doc_id, left(text, 60) AS name, text FROM documents), w GROUP BY ALL),
           b AS (SELECT * FROM m WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1)
           SELECT d.doc_id, item_id::VARCHAR AS subject, coalesce(score, 0) AS score, CASE WHEN named AND score >= 4 THEN 'high' WHEN named OR score >= 2 THEN 'medium' ELSE 'low' END AS confidence, least(0.99, coalesce(score, 0) / 10) AS confidence_score FROM documents d LEFT JOIN b USING (doc_id)""")
def keyword_classify(spark, d):
    """Documents by a taxonomy from a table: benchmark items as subjects with their longer words; the first letters of a text stand for its name."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)))
    taxonomy = t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("subject"), F.col("item_id").alias("ord"), F.explode(words).alias("word"))
    docs = t(spark, d, "documents").select("doc_id", F.left("text", F.lit(60)).alias("name"), "text")
    return choices.classified(docs, taxonomy, "doc_id", "name", "text")


@query(f"""{_TWINS}, s AS (SELECT a.doc_id, a.n_chars, a.quality, (SELECT first(b.doc_id ORDER BY b.doc_id) FROM f b WHERE b.h = a.h AND b.doc_id <> a.doc_id AND b.quality IS NOT NULL) AS twin FROM f a)
          SELECT doc_id, twin, CASE WHEN twin IS NOT NULL THEN 'inherited' WHEN doc_id % 10 = 0 THEN 'image' WHEN doc_id % 10 = 1 THEN 'media' WHEN n_chars >= 500 THEN 'text' WHEN quality = 0 THEN 'ocr' ELSE 'metadata' END AS source FROM s""")
def description_evidence(spark, d):
    """What each document's description rests on: a described twin first, then the best evidence that there is."""
    files = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "n_chars").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    kind = F.col("doc_id") % 10
    evidence = {"image": kind == 0, "media": kind == 1, "text": F.col("n_chars") >= 500, "ocr": F.col("quality") == 0}
    return choices.description_source(files, "h", "doc_id", F.col("quality").isNotNull(), evidence, [F.col("doc_id")])

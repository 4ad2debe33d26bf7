"""Queries on what happens to files over time, and on filters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import filters
from lumenfold.functions import text as X
from lumenfold.operators import lifecycle as L
from lumenfold.operators import proposals as P
from lumenfold.plans import corpus
from lumenfold.plans.relational import t
from lumenfold.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def at(moment: str):
    return F.lit(moment).cast("timestamp_ntz")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1996-03-01'""")
def filter_days(spark, d):
    """Calendar days, the last one included."""
    wanted = filters.Filter(owner="O", day_from=filters.parse_day("1995-03-01"), day_to=filters.parse_day("1996-02-29"))
    return wanted.apply(t(spark, d, "orders"), filters.Columns(owner="o_orderstatus", day="o_orderdate")).select("o_orderkey", "o_orderdate")


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%L_ w%' OR p_type ILIKE '%prom%'""")
def filter_substring(spark, d):
    """Wildcards in what the user types are alive here."""
    return t(spark, d, "part").where(F.col("p_name").ilike("%L_ w%") | F.col("p_type").ilike("%prom%")).select("p_partkey")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal / 10000 >= 0.25 AND c_acctbal / 10000 <= 0.75""")
def filter_confidence(spark, d):
    return t(spark, d, "customer").withColumn("confidence", F.col("c_acctbal") / 10000).where(filters.confidence_band("confidence", 0.25, 0.75)).select("c_custkey")


@query("""WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1)
          SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'revoked' WHEN c_mktsegment = 'MACHINERY' THEN 'online' WHEN last_seen IS NULL THEN 'never' WHEN last_seen > TIMESTAMP '2024-01-27 00:00:00' THEN 'online' ELSE 'offline' END AS state
          FROM customer LEFT JOIN s ON user_id = c_custkey""")
def device_liveness(spark, d):
    """Heartbeats are reduced to each device's last before the join."""
    seen = t(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("last_seen"))
    state = filters.liveness(F.col("c_acctbal") < 0, F.col("c_mktsegment") == "MACHINERY", F.col("last_seen"), at("2024-01-30 00:00:00"), 3 * 86400)
    return t(spark, d, "customer").join(seen, "c_custkey", "left").select("c_custkey", state.alias("state"))


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 100""")
def listing_page(spark, d):
    """A page of 500 is asked for and 200 is the most there is."""
    return filters.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 500, 100)


@query("""WITH h AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision FROM orders WHERE o_orderstatus = 'F'),
          l AS (SELECT o_custkey, max(revision) AS last FROM h GROUP BY 1)
          SELECT * FROM h UNION ALL SELECT o.o_custkey, o_orderkey, coalesce(last, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) FROM orders o LEFT JOIN l ON l.o_custkey = o.o_custkey WHERE o_orderstatus = 'P'""")
def append_history(spark, d):
    orders = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    history = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", place.alias("revision"))
    return L.appended(history, orders.where("o_orderstatus = 'P'").drop("o_orderstatus"), "o_custkey", "o_orderkey")


@query("""WITH h AS (SELECT o_custkey AS document_id, o_orderkey AS fact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_number, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F'),
          f AS (SELECT o_custkey AS document_id, max(o_orderkey) AS fact FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
          SELECT document_id, fact, version_number, version_number = n AND document_id NOT IN (SELECT document_id FROM f) AS is_current FROM h
          UNION ALL SELECT f.document_id, f.fact, coalesce((SELECT max(n) FROM h WHERE h.document_id = f.document_id), 0) + 1, true FROM f""")
def version_swap(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("fact"), "o_orderstatus")
    w = Window.partitionBy("document_id").orderBy("fact")
    held = orders.where("o_orderstatus = 'F'").select("document_id", "fact", F.row_number().over(w).cast("long").alias("version_number"), F.lead("fact").over(w).isNull().alias("is_current"))
    return sinks.swapped_version(held, orders.where("o_orderstatus = 'P'").groupBy("document_id").agg(F.max("fact").alias("fact")))


@query("""SELECT 'file' AS kind, c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status FROM customer
          UNION ALL SELECT 'proposal', o_orderkey, CASE WHEN o_orderstatus = 'P' AND c_acctbal < 0 THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def archive_cascade(spark, d):
    """Accounts in debt are archived, and what was pending for them is rejected."""
    customer = t(spark, d, "customer").withColumnRenamed("c_custkey", "file_id")
    gone = customer.where("c_acctbal < 0")
    files = L.archived(customer.select("file_id", F.lit("active").alias("status")), gone, "file_id")
    held = t(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"))
    changed = L.cascaded(held, gone, "file_id")
    return files.select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "status").unionByName(changed.select(F.lit("proposal").alias("kind"), F.col("o_orderkey").alias("id"), "status"))


@query("""SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'has_children' WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) THEN 'has_files' END AS guard FROM nation""")
def delete_guards(spark, d):
    children = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    held = t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"))
    return L.delete_guard(t(spark, d, "nation").select("n_nationkey"), children, held, "n_nationkey")


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id AND e.ts > TIMESTAMP '2024-01-29 12:00:00')
          AND TIMESTAMP '2024-01-01' + to_minutes((n_chars * 10)::BIGINT) < TIMESTAMP '2024-01-30 12:00:00'""")
def unprocessed_recovery(spark, d):
    """A job of the last 24 hours is still under way; a document's size stands for the time it was made."""
    made = F.timestamp_add("MINUTE", (F.col("n_chars") * 10).cast("int"), at("2024-01-01 00:00:00"))
    files = t(spark, d, "documents").select("doc_id", made.alias("created"))
    jobs = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("started"))
    return L.unprocessed(files, t(spark, d, "labels"), jobs, "doc_id", at("2024-01-30 12:00:00")).select("doc_id")


@query("""WITH w AS (SELECT l_orderkey, l_quantity * 3 - 40 AS c, l_returnflag || l_linestatus || l_linenumber AS word FROM lineitem),
          g AS (SELECT l_orderkey, coalesce(sum(length(word)), 0)::BIGINT AS chars, avg(c) FILTER (WHERE c >= 0) / 100 AS m FROM w GROUP BY 1)
          SELECT l_orderkey, chars, round(m, 6) AS confidence, CASE WHEN chars < 20 THEN 'too_short' WHEN m >= 0.55 THEN 'named' ELSE 'uncertain' END AS gate FROM g""")
def recognition_gate(spark, d):
    """An order's lines stand for the words of a scan; negative confidences are no words."""
    words = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") * 3 - 40).alias("c"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("word"))
    return L.recognition(words, "l_orderkey", "c", "word")


@query("""WITH j AS (SELECT user_id, count(*) AS jobs FROM events GROUP BY 1), f AS (SELECT coalesce(lang, '(none)') AS lang, text, n_chars, n_chars >= 500 AS ok, coalesce(jobs, 0) AS jobs FROM documents LEFT JOIN j ON user_id = doc_id)
          SELECT lang, count(*) AS files, count(*) FILTER (WHERE ok) AS readable, round(count(*) FILTER (WHERE ok) / count(*), 6) AS recall, round(avg(n_chars) FILTER (WHERE ok), 6) AS mean_chars,
          count(text) - count(DISTINCT text) AS copies, round(sum(jobs) / count(*), 6) AS jobs_per_file FROM f GROUP BY lang""")
def pilot_report(spark, d):
    files = t(spark, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("(none)")))
    jobs = t(spark, d, "events").select(F.col("user_id").alias("doc_id"))
    return L.progress_report(files, jobs, "doc_id", "lang", "text", "n_chars", F.col("n_chars") >= 500)


@query("""WITH f AS (SELECT doc_id AS file_id, text, source FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE coalesce(toxic, 0) = 0)
          SELECT file_id, 'metadata' AS stage, source || ':' || coalesce(length(text), 0) AS result FROM f UNION ALL SELECT file_id, 'text', sha256(trim(text)) FROM f""")
def reindex(spark, d):
    """Toxic documents are not active; the description stage is there and not asked for."""
    flags = t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    files = t(spark, d, "documents").join(flags, "doc_id", "left").select(F.col("doc_id").alias("file_id"), "text", "source", F.when(F.col("toxic") == 1, "archived").otherwise("active").alias("status"))
    stages = {"metadata": F.concat("source", F.lit(":"), F.coalesce(F.length("text"), F.lit(0)).cast("string")), "text": F.sha2(F.trim("text"), 256), "description": F.upper("source")}
    return L.replay(files, stages)


_REASONS = ("missing", "job_failed", "extraction_failed", "stalled", "needs_ocr", "unreadable", "needs_review")


@query(f"""WITH r AS ({corpus.SQL["triage_reasons"]}), k AS (SELECT unnest({list(_REASONS)}) AS reason)
          SELECT reason, coalesce(n, 0) AS n FROM k LEFT JOIN r USING (reason) UNION ALL SELECT 'in_flight', count(*) FROM (SELECT user_id FROM events GROUP BY 1 HAVING max_by(event_type, event_id) = 'signup')""")
def triage_counts(spark, d):
    """Every reason has its row, and so have the jobs under way."""
    counts = L.zero_filled(corpus.triage_reasons(spark, d).select("reason", "n"), _REASONS, "reason")
    last = t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("e"))
    return counts.unionByName(last.agg(F.count_if(F.col("e") == "signup").alias("n")).select(F.lit("in_flight").alias("reason"), "n"))


_FILES = """f AS (SELECT c_custkey AS file_id, '5-LOW' AS current_name, CASE c_custkey % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '5-LOW' END AS proposed_name, CASE WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS confidence, c_custkey % 10 <> 0 AS readable, c_custkey % 3 = 0 AS has_title FROM customer),
          h AS (SELECT o_custkey AS file_id, o_orderkey AS proposal_id, o_orderpriority AS proposed_name, CASE o_orderstatus WHEN 'F' THEN 'rejected' WHEN 'P' THEN 'pending' ELSE 'approved' END AS status FROM orders)"""


def _proposals(spark, d):
    key = F.col("c_custkey")
    name = F.when(key % 4 == 0, "1-URGENT").when(key % 4 == 1, "2-HIGH").when(key % 4 == 2, "5-LOW")
    files = t(spark, d, "customer").select(key.alias("file_id"), F.lit("5-LOW").alias("current_name"), name.alias("proposed_name"), F.when(F.col("c_acctbal") < 1000, "low").otherwise("high").alias("confidence"), (key % 10 != 0).alias("readable"), (key % 3 == 0).alias("has_title"))
    status = F.when(F.col("o_orderstatus") == "F", "rejected").when(F.col("o_orderstatus") == "P", "pending").otherwise("approved")
    return files, t(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("proposal_id"), F.col("o_orderpriority").alias("proposed_name"), status.alias("status"))


_DECIDED = f"""WITH {_FILES}, g AS (SELECT file_id, CASE WHEN NOT readable THEN 'unreadable' WHEN confidence = 'low' AND NOT has_title THEN 'uncertain' WHEN proposed_name IS NULL OR proposed_name = current_name THEN 'unchanged'
          WHEN EXISTS (SELECT 1 FROM h WHERE h.file_id = f.file_id AND h.proposed_name = f.proposed_name AND status = 'rejected') THEN 'rejected_before'
          WHEN EXISTS (SELECT 1 FROM h WHERE h.file_id = f.file_id AND h.proposed_name = f.proposed_name AND status = 'pending') THEN 'pending_already' ELSE 'propose' END AS decision FROM f)"""


@query(f"{_DECIDED} SELECT * FROM g")
def proposal_decisions(spark, d):
    return P.decided(*_proposals(spark, d)).select("file_id", "decision")


@query(f"{_DECIDED} SELECT proposal_id, CASE WHEN status = 'pending' AND file_id IN (SELECT file_id FROM g WHERE decision = 'propose') THEN 'superseded' ELSE status END AS status FROM h")
def proposals_superseded(spark, d):
    files, history = _proposals(spark, d)
    return P.superseded(history, P.decided(files, history)).select("proposal_id", "status")


@query(f"""WITH {_FILES}, a AS (SELECT file_id, max_by(proposed_name, proposal_id) AS name FROM h WHERE status = 'approved' GROUP BY 1)
          SELECT file_id, CASE WHEN name IS NOT NULL AND NOT readable THEN name END AS canonical_name, CASE WHEN name IS NOT NULL AND readable THEN name ELSE current_name END AS current_name,
          CASE WHEN name IS NULL THEN 'skipped' WHEN readable THEN 'renamed' ELSE 'named' END AS outcome FROM f LEFT JOIN a USING (file_id)""")
def apply_renames(spark, d):
    files, history = _proposals(spark, d)
    held = files.select("file_id", "current_name", F.lit(None).cast("string").alias("canonical_name"), (~F.col("readable")).alias("is_read_only"))
    return P.applied(held, history).select("file_id", "canonical_name", "current_name", "outcome")


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Con.txt' WHEN 1 THEN p_name || '.' WHEN 2 THEN p_name || ':x' WHEN 3 THEN repeat(p_name, 20) WHEN 4 THEN 'com' || (p_partkey % 12) || '.pdf' ELSE p_name || '.pdf' END AS name FROM part)
          SELECT p_partkey, name, NOT (name = '' OR regexp_matches(name, '[\\/<>:"|?*\x00-\x1f]') OR name IN ('.', '..') OR regexp_matches(lower(regexp_replace(name, '\.[^.]*$', '')), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') OR regexp_matches(name, '[. ]$') OR length(name) > 120) AS safe FROM n""")
def safe_names(spark, d):
    key, name = F.col("p_partkey"), F.col("p_name")
    given = F.when(key % 6 == 0, "Con.txt").when(key % 6 == 1, F.concat(name, F.lit("."))).when(key % 6 == 2, F.concat(name, F.lit(":x"))).when(key % 6 == 3, F.repeat(name, F.lit(20))).when(key % 6 == 4, F.concat(F.lit("com"), (key % 12).cast("string"), F.lit(".pdf"))).otherwise(F.concat(name, F.lit(".pdf")))
    return t(spark, d, "part").select("p_partkey", given.alias("name")).withColumn("safe", sinks.safe_name(F.col("name")))


@query(f"""WITH {corpus._SHINGLES}, n AS (SELECT doc_id, regexp_replace(left(text, 16), '[^a-z]', '', 'g') AS stem FROM documents), o AS (SELECT stem, min(doc_id) AS older FROM n WHERE stem <> '' GROUP BY 1),
          p AS (SELECT DISTINCT older, doc_id AS newer FROM n JOIN o USING (stem) WHERE doc_id <> older),
          c AS (SELECT older, newer, a.h = b.h OR (a.enough AND b.enough) AS ok, round(CASE WHEN len(a.s) + len(b.s) > 0 THEN len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) ELSE 0 END, 6) AS j FROM p JOIN s a ON a.doc_id = older JOIN s b ON b.doc_id = newer)
          SELECT older, newer, NOT ok OR j >= 0.65 AS candidate, round(CASE WHEN ok THEN 0.7 * j + 0.3 ELSE 0.5 END, 6) AS score, CASE WHEN NOT ok THEN 'low' WHEN j < 0.65 THEN NULL WHEN 0.7 * j + 0.3 >= 0.85 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def version_suggestions(spark, d):
    """Each document against the first of its stem: a document is called by the first letters of its text and its number as a version."""
    from lumenfold.operators.similarity import compared

    docs = t(spark, d, "documents")
    name = F.concat(F.regexp_replace(F.substring("text", 1, 16), "[^a-z]", ""), F.lit("_v"), F.col("doc_id").cast("string"), F.lit(".txt"))
    pairs = L.version_candidates(docs, "doc_id", X.version_stem(name))
    scored = compared(pairs, docs, "older", "newer")
    candidate, score, level = X.version_relationship(F.lit(1.0), F.col("similarity"), F.col("verdict") != "not_comparable")
    return scored.select("older", "newer", candidate.alias("candidate"), F.round(score, 6).alias("score"), level.alias("confidence"))

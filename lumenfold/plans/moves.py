"""Queries on moves, expiry, scoped searches and worklists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import moves, textindex
from lumenfold.operators import relational as R
from lumenfold.plans import corpus, textsearch
from lumenfold.plans.lifecycle import at
from lumenfold.plans.relational import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_MOVES = """WITH m AS (SELECT doc_id * 2 AS file_id, CASE WHEN doc_id % 5 = 0 THEN 'nowhere' ELSE 'src' || (doc_id % 20) END AS subject_id, quality = 1 AS by_person, toxic = 1 AS confirmed FROM labels),
          d AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id FROM d WHERE h IN (SELECT h FROM d GROUP BY h HAVING count(*) > 1)),
          o AS (SELECT m.*, CASE WHEN file_id NOT IN (SELECT doc_id FROM documents) THEN 'notFound' WHEN subject_id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) THEN 'failed'
                WHEN file_id IN (SELECT doc_id FROM b) AND NOT coalesce(confirmed, false) THEN 'needsConfirmation' ELSE 'moved' END AS outcome FROM m)"""


def _outcomes(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("subject_id"), F.sha2("text", 256).alias("h"))
    wanted = t(spark, d, "labels").select((F.col("doc_id") * 2).alias("file_id"), F.when(F.col("doc_id") % 5 == 0, "nowhere").otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))).alias("subject_id"), (F.col("quality") == 1).alias("by_person"), (F.col("toxic") == 1).alias("confirmed"))
    copies = docs.join(docs.groupBy("h").count().where("count > 1"), "h", "left_semi")
    return docs, moves.move_outcomes(wanted, docs, docs.where("subject_id is not null"), copies)


@query(f"{_MOVES} SELECT file_id, subject_id, outcome FROM o")
def bulk_move(spark, d):
    """Labelled documents' doubles moved to owners' folders: what became of each. Copies of a content stand against a move that nobody has confirmed."""
    return _outcomes(spark, d)[1].select("file_id", "subject_id", "outcome")


@query(f"{_MOVES} SELECT doc_id AS file_id, source AS subject_id, 'low' AS level, 0.5::DOUBLE AS confidence FROM documents UNION ALL SELECT file_id, subject_id, CASE WHEN by_person THEN 'high' ELSE 'medium' END, CASE WHEN by_person THEN 1.0 ELSE 0.75 END FROM o WHERE outcome = 'moved'")
def placement_history(spark, d):
    """Placements after the moves: earlier rows are never changed."""
    docs, outcomes = _outcomes(spark, d)
    return moves.placements(docs.select("file_id", "subject_id", F.lit("low").alias("level"), F.lit(0.5).alias("confidence")), outcomes)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'done' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'pending' END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' - INTERVAL 300 DAY""")
def expire_and_prune(spark, d):
    """Open orders past their time expire; what has been over for 300 days is pruned."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return moves.expire(rows, "o_orderdate", at("1996-01-01 00:00:00"), keep_days=300).select("o_orderkey", "status")


@query(f"""WITH l AS (SELECT user_id, max_by(event_type, event_id) AS subject FROM events GROUP BY user_id), w AS (SELECT doc_id, ' ' || array_to_string({corpus._TOKENS}, ' ') || ' ' AS x FROM documents)
          SELECT doc_id FROM w JOIN l ON user_id = doc_id WHERE subject = 'view' AND contains(x, ' the ') AND NOT contains(x, ' from ')""")
def scoped_search(spark, d):
    """A search inside one subject exactly: only documents whose latest placement is it, not those below."""
    placed = R.latest_wins(t(spark, d, "events"), ["user_id"], ["event_id"], ["event_type"])
    inside = placed.where("event_type = 'view'").select(F.col("user_id").alias("id"))
    return textindex.search(textsearch.indexed(spark, d, ["simple"]), "the -from", ["simple"], docs=inside).select(F.col("id").alias("doc_id"))


@query("""SELECT doc_id, CASE WHEN n_chars < 60 THEN 'missing' WHEN toxic = 1 THEN 'extraction_failed' WHEN quality = 0 THEN 'unreadable' END AS reason FROM documents LEFT JOIN labels USING (doc_id)
          WHERE n_chars < 60 OR toxic = 1 OR quality = 0 ORDER BY list_position(['missing', 'job_failed', 'extraction_failed', 'stalled', 'needs_ocr', 'unreadable'], reason), doc_id DESC LIMIT 40 OFFSET 10""")
def triage_page(spark, d):
    """A page of the worklist: by severity, then the newest."""
    reason = F.when(F.col("n_chars") < 60, "missing").when(F.col("toxic") == 1, "extraction_failed").when(F.col("quality") == 0, "unreadable")
    rows = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id", "left").select("doc_id", reason.alias("reason")).where("reason is not null")
    severity = F.array_position(F.array(*map(F.lit, X.TRIAGE_ORDER)), F.col("reason"))
    return rows.orderBy(severity, F.desc("doc_id")).offset(10).limit(40)


@query("""SELECT o_orderkey, o_orderstatus, c_name, n_name, min(p_name) AS primary_part, count(l_linenumber) AS lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
          LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4""")
def document_full(spark, d):
    """Orders with owner, place and their primary part; that it is the primary one stands in the join's condition, so that orders without it stay."""
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    owned = orders.join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    primary = owned.join(lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_linenumber") == 1), "left").join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return primary.groupBy("o_orderkey", "o_orderstatus", "c_name", "n_name").agg(F.min("p_name").alias("primary_part"), F.count("l_linenumber").alias("lines"))

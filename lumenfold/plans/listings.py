"""Further listings, write forms and name queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import describe as D
from lumenfold.functions import text as X
from lumenfold.operators import relational as R
from lumenfold.plans.relational import t
from lumenfold.sources import files, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT o_orderkey, c_name, n_name, r_name, count(l_linenumber) AS lines, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS parts FROM orders JOIN customer ON o_custkey = c_custkey
          LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2, 3, 4""")
def file_detail(spark, d):
    """A row with its owner, place and members: members are gathered before the join, each list bounded by its parent."""
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("parts"))
    orders = t(spark, d, "orders").where("o_orderstatus = 'P'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    placed = orders.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return placed.join(lines, "o_orderkey", "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("parts", F.lit("")).alias("parts"))


@query("""SELECT n_name, count(*) FILTER (WHERE o.k IS NOT NULL) AS in_flight, count(*) FILTER (WHERE o.k IS NULL) AS stalled FROM customer JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o ON o.k = c_custkey GROUP BY n_name""")
def backlog_by_location(spark, d):
    busy = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("busy")).distinct()
    joined = t(spark, d, "customer").join(busy, "c_custkey", "left").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count_if(F.col("busy").isNotNull()).alias("in_flight"), F.count_if(F.col("busy").isNull()).alias("stalled"))


@query("""SELECT coalesce(CAST(quality AS VARCHAR), '(none)') AS source, count(*) AS n, count(toxic) AS with_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def count_by_source(spark, d):
    joined = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"), F.count("toxic").alias("with_toxic"))


@query("""SELECT count(*) AS n, max(event_id) AS last_id, max(ts) AS last_ts FROM events""")
def watermark(spark, d):
    """What tells whether a cache is stale."""
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.max("ts").alias("last_ts"))


@query("""SELECT o_custkey, o_orderkey, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def newest_candidates(spark, d):
    """The newest few of each key; Spark cuts each partition's groups before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("""SELECT n_name, max(o_orderdate) AS used FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY used DESC, n_name LIMIT 6""")
def recent_destinations(spark, d):
    last = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("used"))
    joined = last.join(t(spark, d, "customer"), "c_custkey").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.max("used").alias("used")).orderBy(F.desc("used"), "n_name").limit(6)


@query(r"""SELECT p_partkey, CASE WHEN s = '' THEN 'subject' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)""")
def slugs(spark, d):
    return t(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("""WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'click') GROUP BY 1, 2)
          SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM b GROUP BY user_id""")
def counter_map(spark, d):
    """Retry counts by stage, merged key by key into a map."""
    counted = t(spark, d, "events").where("event_type in ('error', 'click')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    return counted.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["event_type"], e["n"].cast("string"))), ",").alias("counts"))


@query("""SELECT c_custkey, coalesce(l.p, c_mktsegment) AS segment, coalesce(l.v, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, max_by(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, o_orderkey) AS p, max(o_totalprice) AS v FROM orders GROUP BY 1) l ON c_custkey = o_custkey""")
def partial_update(spark, d):
    """A null argument keeps what is there."""
    best = t(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    worth = t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    joined = t(spark, d, "customer").join(worth.join(best, "o_custkey", "left"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("p", "c_mktsegment").alias("segment"), F.coalesce("v", "c_acctbal").alias("balance"))


@query("""WITH n AS (SELECT p_partkey, p_brand || '.pdf' AS path, row_number() OVER (PARTITION BY lower(p_brand || '.pdf') ORDER BY p_partkey) AS r FROM part)
          SELECT p_partkey, CASE WHEN r > 1 THEN regexp_replace(path, '\\.[^./]+$', '') || ' (' || r || ').pdf' ELSE path END AS path FROM n""")
def collision_suffix(spark, d):
    named = t(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(".pdf")).alias("path"))
    return sinks.disambiguated(named, "path", "p_partkey")


@query("""SELECT s_suppkey, CASE WHEN n_name IS NULL THEN '_Unsorted' ELSE replace(n_name, ' ', ' ') END || '/' || s_name AS path FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 3 <> 0""")
def mirror_paths(spark, d):
    nation = t(spark, d, "nation").where("n_nationkey % 3 <> 0")
    joined = t(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_suppkey", sinks.mirror_path(F.col("n_name"), F.col("s_name")).alias("path"))


@query("""WITH e AS (SELECT page_id, CASE WHEN regexp_matches(url, '\\.html') THEN 'txt' WHEN page_id % 3 = 0 THEN 'jpg' WHEN page_id % 3 = 1 THEN 'mp4' ELSE 'zzz' END AS ext FROM pages)
          SELECT ext, CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, CASE ext WHEN 'jpg' THEN 'image' WHEN 'mp4' THEN 'video' ELSE 'document' END AS route, count(*) AS n FROM e GROUP BY ALL""")
def media_routes(spark, d):
    ext = F.when(F.col("url").rlike(r"\.html"), "txt").when(F.col("page_id") % 3 == 0, "jpg").when(F.col("page_id") % 3 == 1, "mp4").otherwise("zzz")
    marked = t(spark, d, "pages").select(ext.alias("ext")).withColumn("mime", files.media_type(F.col("ext")))
    return marked.withColumn("route", files.media_route(F.col("mime"), F.col("ext"))).groupBy("ext", "mime", "route").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'pending' END AS status FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def band_review(spark, d):
    """Pending proposals inside a band change state, the others stay."""
    from lumenfold.operators.proposals import reviewed

    history = t(spark, d, "orders").where("o_orderstatus in ('F', 'O')").select("o_orderkey", F.lit("pending").alias("status"), (F.col("o_orderstatus") == "F").cast("double").alias("c"))
    return reviewed(history, F.col("c") >= 0.5, "superseded").select("o_orderkey", "status")


@query(f"""WITH w AS (SELECT doc_id, source, n_chars AS n, 'report ' || CASE WHEN doc_id BETWEEN 1900 AND 2099 THEN doc_id || ' ' ELSE '' END || '2019' AS name FROM documents),
          s AS (SELECT *, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024)::BIGINT || ' KB' ELSE round(n / 1048576, 1) || ' MB' END AS size FROM w)
          SELECT doc_id, 'PDF document: ' || name AS caption, 'PDF document, ' || size || coalesce(', stored in ' || source, '') || '. Its filename reads "' || name || '".{D.CAVEAT}' AS description FROM s""")
def descriptions(spark, d):
    """What can be said of a document from its facts alone."""
    name = F.concat(F.lit("report_"), F.col("doc_id").cast("string"), F.lit("_2019.pdf"))
    caption, text = D.situation(D.kind_of(F.lit("pdf"), F.lit("document")), F.col("n_chars"), name, F.concat(F.lit("stored in "), "source"), F.lit(None).cast("date"))
    return t(spark, d, "documents").select("doc_id", caption.alias("caption"), text.alias("description"))


@query("""SELECT user_id, first_type, last_type, n FROM (SELECT user_id, first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE r = 1""")
def first_and_last(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"), F.count("*").alias("n"))


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0""")
def needs_description(spark, d):
    """No result yet, or a failed one."""
    joined = t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left")
    return joined.where("quality is null or quality = 0").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""SELECT c_custkey, o_orderkey AS stale FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY 1) ON c_custkey = o_custkey""")
def expired(spark, d):
    """The oldest row that is past its time, by key."""
    old = R.earliest_wins(t(spark, d, "orders").where("o_orderdate < timestamp_ntz '1995-01-01'"), ["o_custkey"], ["o_orderkey"], ["o_orderkey"])
    return t(spark, d, "customer").join(old, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("stale"))


@query("""WITH f AS (SELECT doc_id AS file_id, source AS owner, sha256(text) AS k, CASE WHEN n_chars > 0 THEN left(text, 12) END AS stem, lang AS loc FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
          x AS (SELECT doc_id AS a, doc_id + 1 AS b FROM labels WHERE toxic = 1 UNION SELECT doc_id + 1, doc_id FROM labels WHERE toxic = 1),
          p AS (SELECT a.file_id, CASE WHEN a.k = b.k THEN 'exact' ELSE 'version' END AS kind, b.k, b.owner, b.stem, b.loc IS NOT DISTINCT FROM a.loc AS near FROM f a JOIN f b ON a.owner = b.owner AND a.file_id <> b.file_id AND (a.k = b.k OR a.stem = b.stem)
                WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.a = a.file_id AND x.b = b.file_id)),
          g AS (SELECT file_id, kind, owner, k, count(*) AS members, kind = 'exact' OR bool_or(near) AS blocking FROM p GROUP BY file_id, kind, owner, k),
          i AS (SELECT owner, k, min(file_id) AS group_id FROM f GROUP BY ALL),
          r AS (SELECT file_id, kind, group_id, members, blocking, CASE WHEN kind = 'exact' THEN 0 ELSE row_number() OVER (PARTITION BY file_id, kind ORDER BY group_id) END AS place FROM g JOIN i USING (owner, k))
          SELECT * FROM r WHERE place <= 10""")
def move_guard(spark, d):
    """Every document moved to its own language's folder; pairs of a toxic document and the next one are cleared."""
    from lumenfold.operators.guard import move_findings

    docs = t(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("file_id"), F.col("source").alias("owner"), F.sha2("text", 256).alias("content_key"), F.when(F.col("n_chars") > 0, F.substring("text", 1, 12)).alias("stem"), F.col("lang").alias("location"))
    moves = docs.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("destination"))
    cleared = t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return move_findings(moves, own, cleared)
